"""The best k passages of many queries under BM25, by block-max pruning: most postings are never scored.

Passages are analyzed once, by built-in functions; in the same stage their words are matched with the words of all queries by
an Arrow dictionary, and what is left of a passage, the codes and counts of query words, is written as one row. Nothing is
shuffled for it. Document frequencies and lengths are counted from those rows, over all passages.

A task then takes its rows in shards. In a shard, ordered by length, BLOCK passages in turn are a block, and the posting list
of a word keeps for each block where its postings stand and the highest of their weights. A query's words are taken by their
highest weight, until what the remaining ones can add is below the query's k-th score so far: passages that have none of the
words taken are never seen. Of the passages that have, those stay whose score and the highest weights of the remaining words
in their block reach the k-th score; only they are looked up in the remaining, long lists, and fewer from word to word. A
task's k-th scores go on from shard to shard, and its k best are its only rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import retrieval
from tessera.session import written

BLOCK = 16
#: Passages of a shard.
SHARD = 20_000
#: Scores are compared after rounding; a bound counts as reached within this.
SLACK = 1e-8


def forward_index(chunks: DataFrame, terms: list[str], han: bool = False) -> DataFrame:
    """chunks (chunk_id, text, ...) -> chunk_id, dl, codes (places in terms, ascending), counts, and the other columns; written."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "text")]
    ready = chunks.select("chunk_id", retrieval.analyze(F.coalesce("text", F.lit("")), han).alias("tokens"), *rest)
    fields = StructType.fromDDL("dl long, codes array<int>, counts array<int>").fields
    schema = StructType([chunks.schema["chunk_id"], *fields, *(chunks.schema[c] for c in rest)])
    sent = ready.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            tokens = batch.column(1)
            dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.index_in(tokens.flatten(), value_set=known)
            row = np.repeat(np.arange(batch.num_rows), dl)
            hit = code.is_valid().to_numpy(zero_copy_only=False)
            pair, count = np.unique(row[hit] * len(known) + code.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(known))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % max(1, len(known)), count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), *lists, *batch.columns[2:]], names=["chunk_id", "dl", "codes", "counts", *rest])

    return written(ready.mapInArrow(run, schema), "forward-index")


class Shard:
    """Posting lists of some passages, cut in blocks with the highest weight of each."""

    def __init__(self, dl: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float):
        """dl and sizes (query words) by passage; codes and counts of all passages, one after the other."""
        self.n, self.blocks = len(dl), -(-len(dl) // BLOCK)
        doc = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(codes, kind="stable")
        codes, self.doc, tf = codes[order], doc[order], counts[order]
        self.weight = idf[codes] * tf / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl[self.doc] / mean))
        # entries: runs of postings of one word in one block
        key = codes * self.blocks + self.doc // BLOCK
        self.start = np.flatnonzero(np.diff(key, prepend=-1))
        self.end = np.append(self.start[1:], len(key))
        self.block = (key[self.start] % max(1, self.blocks)) if len(key) else np.zeros(0, np.int64)
        self.highest = np.maximum.reduceat(self.weight, self.start) if len(key) else np.zeros(0)
        every = np.arange(len(idf) + 1)
        self.first, self.post = np.searchsorted(codes[self.start] if len(key) else codes, every), np.searchsorted(codes, every)
        self.most = np.zeros(len(idf))
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.highest, self.first[there])
        #: Postings of the queries asked so far, and those of them that were scored.
        self.held = self.scored = 0

    def search(self, words: np.ndarray, k: int, floor: float, visible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(passages, rounded scores) that may be among the k best, if those found before have floor as their k-th score."""
        words = words[self.first[words + 1] > self.first[words]]
        words = words[np.argsort(-self.most[words], kind="stable")]
        #: What the words from here on can add at most.
        rest = np.append(np.cumsum(self.most[words][::-1])[::-1], 0.0)
        self.held += int((self.post[words + 1] - self.post[words]).sum())
        score = np.zeros(self.n)
        at = 0
        # words of high weight, until a passage without any of them cannot reach the floor
        while at < len(words) and rest[at] >= floor - SLACK:
            low, high = self.post[words[at]], self.post[words[at] + 1]
            score[self.doc[low:high]] += self.weight[low:high]
            self.scored += int(high - low)
            at += 1
            floor = max(floor, self._kth(score if visible is None else score * visible, k))
        # of the others, by what the remaining words weigh at most in a passage's block
        entry = np.concatenate([np.arange(self.first[w], self.first[w + 1]) for w in words[at:]] or [np.zeros(0, np.int64)])
        bound = np.bincount(self.block[entry], weights=self.highest[entry], minlength=self.blocks)
        may = (score > 0) & (score + np.repeat(bound, BLOCK)[: self.n] >= floor - SLACK)
        docs = np.flatnonzero(may if visible is None else may & visible)
        for n, w in enumerate(words[at:], at):
            low, high = self.post[w], self.post[w + 1]
            place = np.minimum(low + np.searchsorted(self.doc[low:high], docs), high - 1)
            hit = self.doc[place] == docs
            score[docs[hit]] += self.weight[place[hit]]
            self.scored += int(hit.sum())
            floor = max(floor, self._kth(score[docs], k))
            docs = docs[score[docs] + rest[n + 1] >= floor - SLACK]
        return docs, np.round(score[docs], 9)

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> float:
        return float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0


class _Best:
    """The k best passages so far of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def floor(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) >= self.k else 0.0

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]


def _visible(rows: pa.Table, principals: list[tuple], order: np.ndarray) -> dict[tuple, np.ndarray]:
    """For each asker which passages they may see."""
    owner, public = (rows.column(c).to_numpy()[order] for c in ("owner_id", "is_public"))
    tag = np.array(["" if t is None else f"={t}" for t in rows.column("org_tag").to_pylist()], object)[order]
    classes, which = np.unique(tag.astype(str), return_inverse=True)
    out = {}
    for user, tags in set(principals):
        own = {f"={t}" for t in tags}
        out[user, tags] = (public == True) | (owner == user) | np.array([c in own for c in classes])[which]  # noqa: E712  null is not public
    return out


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int, principals: DataFrame | None = None, access: DataFrame | None = None, han: bool = False) -> DataFrame:
    """The k best rows of ``retrieval.bm25`` per query: query_id, chunk_id, score, rank; ties in order of chunk_id.

    With principals (query_id, user_id, tags), access has chunk_id, owner_id, is_public and org_tag, which chunks have
    themselves if it is None; only the rows that are left of passages are joined with it, and only what the asker may see is
    ranked. A query without words, or with words that no passage has, has no rows. Queries are collected in blocks of
    QUERY_BLOCK; each block takes a pass over chunks.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.array_distinct(retrieval.analyze(F.coalesce("query_text", F.lit("")), han)).alias("words"))
    if principals is not None:
        asked = asked.join(principals.select("query_id", "user_id", "tags"), "query_id")
    asked = written(asked, "asked")
    total = asked.count()
    own = ["owner_id", "is_public", "org_tag"]
    held = chunks.select("chunk_id", "text", *(own if principals is not None and access is None else []))
    found = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    blocks = -(-total // retrieval.QUERY_BLOCK)
    for part in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == part)).collect()
        terms = sorted({w for r in rows for w in r.words})
        index = forward_index(held, terms, han)
        sizes = index.agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        if not sizes.n or not terms:
            continue
        # a row a query word
        df = np.zeros(len(terms))
        for r in index.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
            df[r.code] = r["count"]
        if principals is not None and access is not None:
            index = index.join(access.select("chunk_id", *own), "chunk_id")
        place = {t: i for i, t in enumerate(terms)}
        words = [np.array([place[w] for w in r.words], np.int64) for r in rows]
        who = [(r.user_id, tuple(sorted(t for t in r.tags or () if t is not None))) for r in rows] if principals is not None else None
        idf = np.log(1 + (sizes.n - df + 0.5) / (df + 0.5))
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], words, who, idf, max(1, sizes.dl or 0) / sizes.n))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, words, who, idf, mean = sent.value
            best = _Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, SHARD):
                    rows = pa.Table.from_batches([batch.slice(at, SHARD)])
                    shard, chunk, order = shard_of(rows, idf, mean)
                    seen = _visible(rows, who, order) if who else None
                    for q, w in enumerate(words):
                        docs, scores = shard.search(w, k, best.floor(q), seen[who[q]] if seen else None)
                        if len(docs):
                            best.add(q, chunk[docs], scores)
            count = [len(x) for x in best.ids]
            cols = [np.repeat(np.array(ids, np.int64), count), np.concatenate([*best.ids, np.zeros(0, np.int64)]), np.concatenate([*best.scores, np.zeros(0)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "chunk_id", "score"])

        found = found.unionByName(index.mapInArrow(run, "query_id long, chunk_id long, score double"))
    return retrieval.top(found, k)


def shard_of(rows: pa.Table, idf: np.ndarray, mean: float) -> tuple[Shard, np.ndarray, np.ndarray]:
    """A shard of rows of the forward index, with the ids of its passages and their order by length."""
    dl = rows.column("dl").to_numpy()
    order = np.argsort(dl, kind="stable")
    sorted_rows = rows.select(["chunk_id", "dl", "codes", "counts"]).take(pa.array(order)).combine_chunks()
    codes = sorted_rows.column("codes")
    sizes = pc.list_value_length(codes).to_numpy()
    values = [pc.list_flatten(c).to_numpy().astype(np.int64) for c in (codes, sorted_rows.column("counts"))]
    return Shard(dl[order], sizes, *values, idf, mean), sorted_rows.column("chunk_id").to_numpy(), order
