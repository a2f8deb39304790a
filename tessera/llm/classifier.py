"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics come from built-in functions in one pass over texts and are written as a slim table. Fitting: every partition
of labelled rows sums its part of the normal equations; entries are added up by a grouped sum, so the driver gets
FOLDS * (FEATURES + 1)(FEATURES + 4) / 2 numbers at any size. Sums are kept for FOLDS folds, so each fold can be scored by a model of the others. Calibration: on
these cross-fitted scores, counts and positives of BINS score bins, pooled by
adjacent violators on the driver. All labelled rows of the training side are used; none are sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, lookup, written

FEATURES = 128
RIDGE = 1e-3
SEED = 7
BINS = 1000
FOLDS = 4
LOW, HIGH = -0.5, 1.5

STATS = ["s_words", "s_length", "s_symbols", "s_digits", "s_upper", "s_distinct", "s_lines", "s_dup_lines", "s_stops", "s_marks"]


def statistics(docs: DataFrame) -> DataFrame:
    """Add the ten statistics STATS (doubles, never null) to the columns of docs other than text; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    words = F.array_remove(F.split(text, SPACE), "")
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("double").alias("n"), F.length(F.array_join(w, "")).cast("double").alias("c"), F.size(F.array_distinct(w)).cast("double").alias("d"))), 0)
    lines = F.get(F.transform(F.array(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("d"))), 0)
    rows = docs.select(*rest, sizes.alias("_w"), lines.alias("_l"), count(r"[#*$%&|<>]").alias("_s"), count("[0-9]").alias("_g"), count("[A-Z]").alias("_u"), count("[.!?]").alias("_p"), count("[,;:]").alias("_m"))
    n, c = F.greatest(F.col("_w.n"), F.lit(1.0)), F.greatest(F.col("_w.c"), F.lit(1.0))
    lined = F.greatest(F.col("_l.n"), F.lit(1.0))
    return rows.select(
        *rest,
        F.log1p("_w.n").alias("s_words"),
        F.log(c / n).alias("s_length"),
        F.log1p(F.col("_s") / n).alias("s_symbols"),
        F.sqrt(F.col("_g") / c).alias("s_digits"),
        F.sqrt(F.col("_u") / c).alias("s_upper"),
        (F.col("_w.d") / n).alias("s_distinct"),
        F.log(n / lined).alias("s_lines"),
        (1 - F.col("_l.d") / lined).alias("s_dup_lines"),
        F.sqrt(F.col("_p") / n).alias("s_stops"),
        F.sqrt(F.col("_m") / n).alias("s_marks"),
    )


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: non-decreasing rates of consecutive bins (bins without weight join their left neighbour)."""
    blocks: list[list[float]] = []
    for w, p in zip(weight.tolist(), positive.tolist(), strict=True):
        blocks.append([w, p, 1])
        while len(blocks) > 1 and (blocks[-1][0] == 0 or blocks[-2][0] == 0 or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.concatenate([np.full(int(k), p / w if w else 0.5) for w, p, k in blocks])


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((d, features)) / np.sqrt(d)
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.curve = np.full(BINS, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / len(self.b))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by linear interpolation between bin centres, so scores keep the order of the ridge scores."""
        centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return np.clip(np.interp(self.raw(x), centres, self.curve), 0.0, 1.0)


def bins_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS], axis=1).astype(np.float64)


def _solve(sums: np.ndarray, upper: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Ridge weights from the upper triangle of the normal matrix followed by the right-hand side."""
    a = np.zeros((size, size))
    a[upper] = sums[: len(upper[0])]
    a = a + np.triu(a, 1).T
    return np.linalg.solve(a + np.eye(size) * RIDGE * max(a[-1, -1], 1.0), sums[len(upper[0]) :])


def fit(rows: DataFrame) -> Model:
    """rows (STATS, label 0 or 1) -> model; without rows every score is 0.5."""
    q = rows.agg(*[F.avg(c).alias(c) for c in STATS], *[F.stddev_pop(c).alias(c + "_sd") for c in STATS]).first()
    if q[STATS[0]] is None:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    model = Model(np.array([q[c] for c in STATS]), np.maximum(np.array([q[c + "_sd"] for c in STATS]), 1e-3))
    size = len(model.beta)
    upper = np.triu_indices(size)
    # equal rows share a fold, so no row is calibrated by a model that saw its copy
    folded = rows.select(*STATS, "label", F.pmod(F.xxhash64(*STATS), F.lit(FOLDS)).cast("int").alias("fold"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, len(upper[0]) + size))
        for batch in batches:
            z, y = model.features(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                part = z[fold == k]
                total[k] += np.concatenate([(part.T @ part)[upper], part.T @ y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    got = np.zeros(FOLDS * (len(upper[0]) + size))
    for i, v in folded.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[i] = v
    got = got.reshape(FOLDS, -1)
    model.beta = _solve(got.sum(axis=0), upper, size)
    others = np.stack([_solve(got.sum(axis=0) - got[k], upper, size) for k in range(FOLDS)], axis=1)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, positive = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = (model.features(_matrix(batch)) @ others)[np.arange(len(fold)), fold]
            at = bins_of(raw)
            counts += np.bincount(at, minlength=BINS)
            positive += np.bincount(at, weights=batch.column("label").to_numpy(zero_copy_only=False), minlength=BINS).astype(np.int64)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full]), pa.array(positive[full])], names=["bin", "n", "p"])

    weight, positive = np.zeros(BINS), np.zeros(BINS)
    for b, w, p in folded.mapInArrow(binned, "bin long, n long, p long").groupBy("bin").agg(F.sum("n"), F.sum("p")).collect():
        weight[b], positive[b] = w, p
    model.curve = isotonic(weight, positive)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (STATS and others) -> the others with score."""
    rest = [c for c in rows.columns if c not in STATS]
    schema = rows.select(*rest).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got, pa.float64())], names=[*rest, "score"])

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, held_out, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted for every row of docs.

    Only rows that are not held out are fitted. Rows of docs that repeat an id count each. An id has one label, whether or
    not rows of labels repeat it: 1 if at least half of its labels are. Null labels and null ids have none. Empty texts are
    scored like any other; other columns of either table are ignored; an empty table gives no rows.
    """
    rows = written(statistics(docs.select("doc_id", "held_out", "text")), "classifier-statistics")
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # an id may hold any share of docs, so its one label is joined with salt or, where labels are few, broadcast
    learned = lookup(rows.where(~F.col("held_out")), written(marks, "classifier-labels"), ["doc_id"], F.xxhash64(*STATS))
    slim = written(learned.where(F.col("label").isNotNull()).select(*STATS, "label"), "classifier-learned")
    return score(rows, fit(slim)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
