"""Importance resampling of a table towards a target text distribution.

Weights. The features of a text (runs of one and two words) fall into BUCKETS hash buckets. Tasks count the buckets of
documents and of the target in one array each, summed by bucket; a bucket's gain is the logarithm of its two smoothed
frequencies' ratio, and a document's weight the mean gain of its features, looked up in the array of gains. Adding
Gumbel noise from a seeded hash of the id to a weight makes the highest scores a draw without replacement.

The draw. Each task that scores documents sorts those that may be drawn into runs of at most RUN_ROWS rows, in a written
table. Scores are whole numbers in a range that their logarithms bound (under 200,000 different ones for any corpus), so
counts by score say exactly which score the last draw has, and where every range of scores begins in the order; what lies
below is never moved. Ranges of about equal size go to a task each, which merges the runs that reach it by a tournament
tree, begins at the range's own rank, and stops at the exact number of draws. A score that more than RANGE_ROWS rows
share is cut into ranges of ids. Counts and runs are written, so a lost executor costs its tasks alone.

Defined cases. A null or empty text has no features and weight 0; a null id counts as the empty text in the noise and as
the smallest id in ties; repeated rows are drawn one by one. With no row to draw all ranks are null. An empty target has
T = 0. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
RUN_ROWS = 200_000
RANGE_ROWS = 200_000
#: A text is cut into words in pieces of about so many bytes.
PIECE = 1 << 20

#: A-Z in lower case; what is neither an ASCII letter or digit nor beyond ASCII separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LEAST = -(1 << 63)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size; a single word is never cut."""
    raw = (text or "").encode().translate(_LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def buckets_of(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of one and two words that end there) of each piece of a text."""
    last: int | None = None
    for words in words_of(text):
        if not words:
            continue
        alone = list(map(zlib.crc32, words))
        # a checksum goes on from that of the word before
        before = alone[:-1] if last is None else [last, *alone[:-1]]
        pairs = map(zlib.crc32, [b" " + w for w in (words[1:] if last is None else words)], before)
        last = alone[-1]
        yield len(words), np.fromiter([*alone, *pairs], np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts (column text) by bucket; each task sends at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in buckets_of(text.as_py(), buckets):
                    counts += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], names=["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of each bucket's smoothed frequency in the target to that in the corpus, rounded down."""
    s, t, size = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + size) / ((float(a) + 1) * (t + size)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandfold Gumbel noise of an id, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


ROWS = "n_features long, n_words long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, min_words: int = MIN_WORDS, seed: int = SEED, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score; what may be drawn stands in sorted runs. A written table."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select("doc_id").schema
    for c in ROWS.split(", "):
        schema = schema.add(*c.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, held = sent.value, []

        def sorted_run() -> pa.RecordBatch:
            cols = np.array([h[1:] for h in held], np.int64).reshape(-1, 4)
            ids = np.array([_LEAST if h[0] is None else h[0] for h in held], np.int64)
            order = np.lexsort((ids, -cols[:, 3], cols[:, 1] < min_words))
            keys = pa.array([held[k][0] for k in order], pa.int64())
            return pa.RecordBatch.from_arrays([keys, *(pa.array(cols[order, c]) for c in range(4))], names=["doc_id", "n_features", "n_words", "weight", "score"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = words = total = 0
                for count, found in buckets_of(text.as_py(), len(gain)):
                    words, n, total = words + count, n + len(found), total + int(gain[found].sum())
                weight = total // n if n else 0
                held.append((key, n, words, weight, weight + noise(key, seed)))
                if len(held) == run_rows:
                    yield sorted_run()
                    held = []
        yield sorted_run()

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "importance-runs")


# ---------------------------------------------------------------- the draw


class Tournament:
    """A tree of matches between the heads of sorted runs: every inner node keeps its loser, the least head of all wins."""

    def __init__(self, heads: list[tuple]):
        self.heads = heads
        self.losers = [0] * len(heads)
        self.winner = self._played(1)

    def _played(self, node: int) -> int:
        if node >= len(self.heads):
            return node - len(self.heads)
        a, b = self._played(2 * node), self._played(2 * node + 1)
        won, lost = (b, a) if self.heads[b] < self.heads[a] else (a, b)
        self.losers[node] = lost
        return won

    def advance(self, head: tuple) -> None:
        """The winner's run goes on with this head; only the matches on its way up are played again."""
        run = self.winner
        self.heads[run] = head
        node = (run + len(self.heads)) // 2
        while node:
            other = self.losers[node]
            if self.heads[other] < self.heads[run]:
                self.losers[node], run = run, other
            node //= 2
        self.winner = run


_OVER = (math.inf,)


def merged(runs: list[list[tuple]], most: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``most`` entries of sorted runs, in order, and what is left of the runs when the merge stops there."""
    if not runs:
        return [], []
    tree, at, found = Tournament([r[0] for r in runs]), [0] * len(runs), []
    for _ in range(min(most, sum(map(len, runs)))):
        run = tree.winner
        found.append(tree.heads[run])
        at[run] += 1
        tree.advance(runs[run][at[run]] if at[run] < len(runs[run]) else _OVER)
    return found, [e for r, k in zip(runs, at, strict=True) for e in r[k:]]


def natural_runs(entries: Iterable[tuple]) -> list[list[tuple]]:
    """Entries cut wherever they descend; sorted runs that arrive one after the other stay whole."""
    runs: list[list[tuple]] = []
    last = None
    for e in entries:
        if last is None or e < last:
            runs.append([])
        runs[-1].append(e)
        last = e
    return runs


class Ranges:
    """Ranges of the order (score descending, id ascending), each with the rank before it."""

    def __init__(self, counts: dict[int, int], splits: dict[int, list[tuple[int, int]]], draws: int, most: int):
        """counts by score; splits: of large scores the (first id, rows) of their parts; ``most`` rows of a range, if possible."""
        self.draws, self.first_of, self.splits, self.starts = draws, {}, {}, []
        place, size = 0, most
        for score in sorted(counts, reverse=True):
            if place >= draws:
                break
            for k, (_, rows) in enumerate(splits.get(score) or [(_LEAST, counts[score])]):
                if size + rows > most or k:
                    self.starts.append(place)
                    size = 0
                if not k:
                    self.first_of[score] = len(self.starts) - 1
                place, size = place + rows, size + rows
            if score in splits:
                self.splits[score] = np.array([first for first, _ in splits[score][1:]], np.int64)
                size = most
        self.lowest = min(self.first_of, default=None)

    def of(self, score: int, key: int | None) -> int:
        parts = self.splits.get(score)
        return self.first_of[score] + (0 if parts is None else int(np.searchsorted(parts, _LEAST if key is None else key, side="right")))


def _parts_of_large(rows: DataFrame, counts: dict[int, int], most: int) -> dict[int, list[tuple[int, int]]]:
    """Of scores with over ``most`` rows: ids that cut them into about equal parts, and the exact rows of each part."""
    large = [s for s, n in counts.items() if n > most]
    if not large:
        return {}
    key = F.coalesce("doc_id", F.lit(_LEAST))
    held = rows.where(F.col("score").isin(large)).select("score", key.alias("_key"))
    pieces = -(-max(counts[s] for s in large) // most)
    found = {r.score: sorted({_LEAST, *r.cuts}) for r in held.groupBy("score").agg(F.percentile_approx("_key", [k / pieces for k in range(1, pieces)]).alias("cuts")).collect()}
    cuts = rows.sparkSession.createDataFrame([(s, c, d) for s, at in found.items() for c, d in zip(at, [*at[1:], None], strict=True)], "score long, low long, high long")
    inside = (F.col("_key") >= F.col("low")) & (F.col("high").isNull() | (F.col("_key") < F.col("high")))
    # a row of cuts for every ``most`` rows of a large score
    sizes = held.join(F.broadcast(cuts), "score").where(inside).groupBy("score", "low").count().collect()
    return {s: sorted((r["low"], r["count"]) for r in sizes if r.score == s) for s in large}


def draw(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows of ``scored`` with rank: 1, 2, 3 ... of the highest scores among those with enough words, null for the others."""
    may = rows.where(F.col("n_words") >= min_words)
    counts = {r.score: r["count"] for r in may.groupBy("score").count().collect()}
    draws = percent * sum(counts.values()) // 100
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-draws // range_rows))
    ranges = Ranges(counts, _parts_of_large(may, counts, range_rows), draws, min(range_rows, max(1, -(-draws // tasks))))
    if ranges.lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    high = (F.col("n_words") >= min_words) & (F.col("score") >= ranges.lowest)
    names = rows.columns
    sent = spark.sparkContext.broadcast(ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [sent.value.of(s, k) for s, k in zip(batch.column("score").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int32())], names=[*names, "_range"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has about one range; its rows are numbers alone
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (*names, "_range")), strict=True)
            for key, n, words, weight, score, place in rows:
                held.setdefault(place, []).append((-score, _LEAST if key is None else key, n, words, weight, key is None))
        for place in sorted(held):
            start = sent.value.starts[place]
            first, rest = merged(natural_runs(held.pop(place)), sent.value.draws - start)
            found = first + rest
            ranks = [*range(start + 1, start + len(first) + 1), *[None] * len(rest)]
            cols = [[None if e[5] else e[1] for e in found], [e[2] for e in found], [e[3] for e in found], [e[4] for e in found], [-e[0] for e in found], ranks]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*names, "rank"])

    schema = rows.select(*names, F.lit(0).alias("_range")).schema
    dealt = rows.where(high).mapInArrow(deal, schema).repartitionById(tasks, F.pmod("_range", F.lit(tasks)).cast("int"))
    drawn = dealt.mapInArrow(merge, rows.select(*names, F.lit(None).cast("long").alias("rank")).schema)
    return rows.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words for every row of docs (doc_id, text), drawn towards target (text)."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(scored(docs, gain, min_words, seed), percent, min_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


RESAMPLE_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c FROM range(256) r(b))),
split AS (
  SELECT kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark)),
feature AS (
  SELECT kind, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM split),
counted AS (SELECT kind, id, f, count(*) AS n FROM feature GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::UBIGINT),
      lambda c, x: xor(c // 256, tab[(xor(c % 256, x) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS b
  FROM (SELECT DISTINCT f FROM counted), crc_table),
bucket AS (SELECT b, sum(n) FILTER (kind = 'd')::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (f) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM bucket) + 10000) / ((s + 1) * ((SELECT sum(t) FROM bucket) + 10000))))::BIGINT AS g FROM bucket WHERE s IS NOT NULL),
weighed AS (SELECT id, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (b) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, greatest(2 * len(words) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, len(words)::BIGINT AS n_words
  FROM split LEFT JOIN weighed USING (id) WHERE kind = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank, n_words FROM placed
"""
