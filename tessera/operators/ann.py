"""Approximate neighbours by cosine: inverted lists of trained centroids, product codes of residuals, exact scores last.

``train`` fits centroids and code books on a bounded sample and measures on it how many lists a query has to visit;
``index`` gives every row its list and code; ``search`` scores the codes of the visited lists, keeps WIDEN times k rows a
query, and ranks those by the exact cosine. ``retrieval.knn`` is the exact way, and ``recall`` compares the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.session import written

#: Vectors that the quantizer is trained on, chosen by a hash of their id; at most twice as many reach the driver.
SAMPLE = 20_000
#: Sampled vectors that are held out as queries when the number of lists to visit is measured.
TRIALS = 300
MAX_LISTS = 4_096
PARTS = 16
CODES = 256
ROUNDS = 12
#: Share of the true neighbours of held-out vectors that must lie in the lists that are visited.
TARGET = 0.97
#: Rows a query that are ranked by their exact score, as a multiple of k.
WIDEN = 4
#: Queries whose tables of partial scores are held at once: 16 KB each.
QUERY_BLOCK = 2_000
#: Candidates that may be broadcast to the vectors, 16 bytes each.
BROADCAST_CANDIDATES = 1_000_000
#: Candidates a task holds beyond the best so far before it drops the rest.
PENDING = 500_000


@dataclass(frozen=True)
class Quantizer:
    """Centroids (lists, d); per part of the dimensions a code book; probes, the lists that a query visits."""

    centroids: np.ndarray
    parts: list[np.ndarray]
    books: list[np.ndarray]
    probes: int

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def lists_of(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centroids.T, axis=1).astype(np.int32)

    def codes_of(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = unit - self.centroids[lists]
        return np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Partial scores (queries, parts, codes) of unit queries."""
        out = np.zeros((len(unit), len(self.parts), CODES), np.float32)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, j, : len(b)] = unit[:, p] @ b.T
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """k centres of x; a centre without rows takes the row farthest from its own. With unit, centres have length 1."""
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        size = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        empty = np.flatnonzero(size == 0)
        far = np.argsort(-((x - centres[at]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
        centres = total / np.maximum(size, 1)[:, None]
        centres[empty] = x[far]
        if unit:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 0, centres / np.where(length > 0, length, 1), centres)
    return centres


def _units(vectors: pd.Series, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of the dimension and a length, their unit vectors)."""
    at = np.flatnonzero([v is not None and len(v) == dimension for v in vectors])
    if not len(at):
        return at, np.zeros((0, dimension))
    x = np.stack(vectors.to_numpy()[at]).astype(np.float64)
    length = np.linalg.norm(x, axis=1)
    good = (length > 0) & np.isfinite(length)
    return at[good], x[good] / length[good, None]


def train(vectors: DataFrame, k: int = R.RECALL, lists: int | None = None, parts: int = PARTS, target: float = TARGET, seed: int = 0) -> Quantizer | None:
    """A quantizer for vectors (chunk_id, vector) of the dimension that most of them have; None where there are none.

    Without lists there are twice the square root of the rows, at most MAX_LISTS and a sixteenth of the sample. The lists
    that a query visits are the fewest in which held-out sampled vectors find target of their neighbours among the sample.
    """
    sizes = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    dimension, total = sizes[0]["d"], sizes[0]["count"]
    share = min(1.0, SAMPLE / total)
    rows = vectors.where(F.size("vector") == dimension)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    found = rows.select("chunk_id", "vector").limit(2 * SAMPLE).collect()
    found.sort(key=lambda r: (r["chunk_id"], tuple(r["vector"])))
    _, unit = _units(pd.Series([r["vector"] for r in found], dtype=object), dimension)
    if not len(unit):
        return None
    rng = np.random.default_rng(seed)
    count = lists or int(min(MAX_LISTS, 2 * np.sqrt(total)))
    centroids = _means(unit, max(1, min(count, max(1, len(unit) // 16))), rng, unit=True)
    rest = unit - centroids[np.argmax(unit @ centroids.T, axis=1)]
    split = [p for p in np.array_split(np.arange(dimension), min(parts, dimension)) if len(p)]
    books = [_means(rest[:, p], CODES, rng) for p in split]
    return Quantizer(centroids, split, books, _probes(unit, centroids, max(1, round(k * len(unit) / total)), target, rng))


def _probes(unit: np.ndarray, centroids: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
    trials = unit[rng.choice(len(unit), min(TRIALS, len(unit)), replace=False)]
    home = np.argmax(unit @ centroids.T, axis=1)
    order = np.argsort(-(trials @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    k = min(k + 1, len(unit))  # a trial finds itself too
    near = np.argpartition(-(trials @ unit.T), k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def index(vectors: DataFrame, quantizer: Quantizer, name: str = "ann-index") -> DataFrame:
    """vectors (chunk_id, vector and any others) with list and code, written in order of list.

    Ranges are cut by (list, hash of id), so a list of any size is dealt over tasks, and a scan can skip row groups. Rows
    of another dimension have a null list and are searched exactly; so do null vectors and those of length 0, which have
    no neighbours.
    """
    schema = "list int, code binary"

    @F.pandas_udf(schema)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, unit = _units(batch, quantizer.dimension)
            lists = quantizer.lists_of(unit)
            out = pd.DataFrame({"list": pd.array([None] * len(batch), dtype="Int32"), "code": [None] * len(batch)})
            out.loc[at, "list"] = lists
            out.loc[at, "code"] = pd.Series([c.tobytes() for c in quantizer.codes_of(unit, lists)], index=at, dtype=object)
            yield out

    rows = vectors.withColumn("_c", coded("vector")).select("*", "_c.*").drop("_c").withColumn("_h", F.xxhash64("chunk_id"))
    return written(rows.repartitionByRange("list", "_h").sortWithinPartitions("list").drop("_h"), name)


class _Best:
    """The best ``width`` candidates of each query seen by a task; pending ones are cut down when they are many."""

    def __init__(self, queries: int, width: int):
        self.width = width
        self.least = np.full(queries, -np.inf, np.float32)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def see(self, asked: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        """score (asked, rows) of queries ``asked`` (numbers) and the rows with ids ``chunk``."""
        q, r = np.nonzero(score > self.least[asked][:, None])
        if len(q):
            self.rows.append((asked[q], score[q, r], chunk[r]))
            self.pending += len(q)
            if self.pending > PENDING:
                self.cut()

    def cut(self) -> None:
        if not self.rows:
            return
        q, score, chunk = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((chunk, -score, q))
        q, score, chunk = q[order], score[order], chunk[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < self.width
        last = np.arange(len(q)) - first == self.width - 1
        self.least[q[last]] = score[last]
        self.rows, self.pending = [(q[kept], score[kept], chunk[kept])], 0


def _scan(quantizer: Quantizer, ids: np.ndarray, unit: np.ndarray, askers: dict[tuple, list[int]], width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = unit @ quantizer.centroids.T
        visits = np.argsort(-near, axis=1, kind="stable")[:, : quantizer.probes]
        # the queries of each list
        order = np.argsort(visits.ravel(), kind="stable")
        cuts = np.searchsorted(visits.ravel()[order], np.arange(len(quantizer.centroids) + 1))
        of_list = order // visits.shape[1]
        tables = quantizer.tables(unit)
        best = _Best(len(ids), width)
        for whole in batches:
            for at in range(0, len(whole), R.BATCH_ROWS):
                pdf = whole.iloc[at : at + R.BATCH_ROWS]
                chunk = pdf["chunk_id"].to_numpy().astype(np.int64)
                lists = pdf["list"].to_numpy()
                codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
                for which in np.unique(lists):
                    asked, rows = of_list[cuts[which] : cuts[which + 1]], np.flatnonzero(lists == which)
                    if not len(asked):
                        continue
                    score = np.repeat(near[asked, which].astype(np.float32)[:, None], len(rows), axis=1)
                    for j in range(codes.shape[1]):
                        score += tables[asked, j][:, codes[rows, j]]
                    if askers:
                        _hide(score, asked, pdf.iloc[rows], askers)
                    best.see(asked, score, chunk[rows])
        best.cut()
        for q, score, chunk in best.rows:
            yield pd.DataFrame({"query_id": ids[q], "chunk_id": chunk, "score": score.astype(np.float64)})

    return run


def _hide(score: np.ndarray, asked: np.ndarray, pdf: pd.DataFrame, askers: dict[tuple, list[int]]) -> None:
    owner, public, tag = pdf["owner_id"].to_numpy(), pdf["is_public"].to_numpy().astype(bool), pdf["org_tag"].to_numpy()
    for (user, tags), queries in askers.items():
        mine = np.flatnonzero(np.isin(asked, queries))
        if len(mine):
            held = np.fromiter((t in tags for t in tag), bool, len(tag))
            score[np.ix_(mine, np.flatnonzero(~(public | (owner == user) | held)))] = -np.inf


def search(indexed: DataFrame, quantizer: Quantizer, queries: DataFrame, k: int = R.RECALL, permissions: bool = False, widen: int = WIDEN) -> DataFrame:
    """indexed (of ``index``), queries (query_id, vector) -> (query_id, chunk_id, score, rank), scores exact.

    The scan reads ids, lists and codes only; vectors are read for the candidates, at most widen times k a query. Queries
    are collected in blocks of QUERY_BLOCK. Queries of another dimension than the quantizer's are searched exactly among
    the rows of their dimension. Null vectors and those of length 0 have no neighbours. With permissions as in
    ``retrieval.knn``: rows that an asker may not see take none of the asker's candidates.
    """
    held = ["owner_id", "is_public", "org_tag"] if permissions else []
    asked = ["query_id", "vector"] + (["user_id", "tags"] if permissions else [])
    usual = queries.where(F.size("vector") == quantizer.dimension)
    odd = R.knn(indexed.where(F.col("list").isNull()), queries.where(F.size("vector") != quantizer.dimension), k, permissions)
    blocks = max(1, -(-usual.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = (usual if blocks == 1 else usual.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select(*asked).collect()
        at, unit = _units(pd.Series([r["vector"] for r in rows], dtype=object), quantizer.dimension)
        kept = [rows[i] for i in at]
        askers: dict[tuple, list[int]] = {}
        for n, r in enumerate(kept if permissions else []):
            askers.setdefault((r["user_id"], frozenset(r["tags"] or ())), []).append(n)
        scan = _scan(quantizer, np.array([r["query_id"] for r in kept], np.int64), unit, askers, widen * k)
        part = indexed.where(F.col("list").isNotNull()).select("chunk_id", "list", "code", *held).mapInPandas(scan, "query_id long, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    candidates = written(R.top(found, widen * k).select("query_id", "chunk_id").distinct(), "ann-candidates")
    small = F.broadcast(candidates) if candidates.count() <= BROADCAST_CANDIDATES else candidates
    vectors = indexed.where(F.col("list").isNotNull()).select("chunk_id", F.col("vector").alias("_v"), *held)
    pairs = vectors.join(small, "chunk_id").join(usual.select(*asked), "query_id")
    if permissions:
        pairs = pairs.where(R._may_see())

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    score = F.round(dot("_v", "vector") / F.sqrt(dot("_v", "_v") * dot("vector", "vector")), 9)
    exact = R.top(pairs.select("query_id", "chunk_id", score.alias("score")), k)
    return exact.unionByName(odd.select(*exact.columns))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Two ranked lists -> (query_id, wanted, found): of the exact neighbours of each query, how many were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")).distinct(), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("_hit").alias("found"))
