"""Retrieval over many queries at once: BM25, exact cosine neighbours, weighted rank fusion, neighbours under a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
RECALL = 100
RERANK_WINDOW = 30
KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.1, 0.9
MIN_SCORE = 0.3
PRIMARY_HITS = 5
CONTEXT_TOKENS = 3500
#: Query terms and query vectors are broadcast in blocks of at most so many queries; more queries take more passes.
QUERY_BLOCK = 5_000
#: Vectors that are multiplied with a block of queries at once.
BATCH_ROWS = 2_000


def analyze(text: Column, han: bool = False) -> Column:
    """Lower-cased runs of letters and digits. With han, runs of Han characters are terms of their own, as bigrams: no
    dictionary of words is needed, and a query's bigrams are found in any sentence that holds them."""
    if not han:
        return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{IsHan}]+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    return cjk_bigrams(runs)


def cjk_bigrams(tokens: Column) -> Column:
    """Tokens in Han script of over two characters replaced by their bigrams; others stay."""
    def grams(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))

    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{IsHan}{3,}$"), grams(t)).otherwise(F.array(t))))


def postings(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) -> (chunk_id, term, tf)."""
    return chunks.select("chunk_id", F.explode(analyze(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, text) -> (chunk_id, dl), the number of terms."""
    return chunks.select("chunk_id", F.size(analyze(F.col("text"))).cast("long").alias("dl"))


def bm25(chunks: DataFrame, queries: DataFrame, principals: DataFrame | None = None, han: bool = False) -> DataFrame:
    """chunks (chunk_id, text), queries (query_id, query_text) -> (query_id, chunk_id, score), rounded to 9 decimals.

    With principals (query_id, user_id, tags), chunks also have owner_id, is_public and org_tag. These travel with the terms
    of a chunk, and a pair that the asker may not see is dropped before its terms are summed.

    chunk_id is unique. One pass over the chunks prunes tokens to query terms and shuffles them once, by chunk; the term
    frequencies there serve the chunks a term is in and the sums per query alike. A chunk also has the empty term, once, which
    stands for all chunks and their lengths. Frequencies and mean length cover all chunks, whoever asks. han: see ``analyze``.
    """
    access = [] if principals is None else ["owner_id", "is_public", "org_tag"]
    asked = queries.select("query_id", F.explode_outer(F.array_distinct(analyze(F.col("query_text"), han))).alias("term")).where(F.col("term").isNotNull())
    terms = asked.select("term").distinct()
    everything = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    sized = chunks.select("chunk_id", *access, analyze(F.coalesce("text", F.lit("")), han).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    wanted = terms.unionByName(everything)
    # explode_outer: explode would be preceded by a test for emptiness that analyzes every text again
    held = sized.select("chunk_id", "dl", *access, F.explode_outer(F.array_append("tokens", F.lit(""))).alias("term"))
    hits = held.join(wanted, "term", "left_semi").repartition("chunk_id")
    tf = hits.groupBy("term", "chunk_id", "dl", *access).agg(F.count("*").alias("tf"))
    counts = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("_length"))
    # one row per query term; the row of the empty term meets no query below, and a filter on it here would be inferred for tf,
    # whose shuffle could then not be read twice
    whole = Window.partitionBy()
    of_all = lambda c: F.max(F.when(F.col("term") == "", F.col(c))).over(whole)
    stats = counts.select("term", "df", of_all("df").alias("n"), (of_all("_length") / of_all("df")).alias("avgdl"))
    idf = stats.select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = tf.join(idf, "term").withColumn("w", F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    pairs = weighted.join(asked if principals is None else asked.join(principals.select("query_id", "user_id", "tags"), "query_id"), "term")
    if principals is not None:
        pairs = pairs.where(_may_see())
    return pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 9).alias("score"))


def _may_see() -> Column:
    """The asker (user_id, tags) owns the chunk, or it is public, or it has one of the asker's effective tags."""
    return F.col("is_public") | (F.col("owner_id") == F.col("user_id")) | F.coalesce(F.array_contains("tags", F.col("org_tag")), F.lit(False))


def valid_hits(hits: DataFrame) -> DataFrame:
    """Hits of an index that have an id and a source; others are not results."""
    return hits.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())


def permitted_hits(scored: DataFrame, files: DataFrame, principals: DataFrame) -> DataFrame:
    """Hits that the asker may see: own, public, or tagged with one of the asker's effective tags.

    files (chunk_id, owner_id, is_public, org_tag), principals (query_id, user_id, tags): no table of visible pairs is
    built, only hits are joined with the columns that decide.
    """
    rows = scored.join(files.select("chunk_id", "owner_id", "is_public", "org_tag"), "chunk_id").join(principals, "query_id")
    return rows.where(_may_see()).select(*scored.columns)


def top(scored: DataFrame, k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best rows per query with their rank; ties in order of key. Spark limits groups before it shuffles them."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = RECALL, permissions: bool = False) -> DataFrame:
    """vectors (chunk_id, vector), queries (query_id, vector) -> (query_id, chunk_id, score, rank), exact cosine.

    A matrix product per Arrow batch; a partition keeps its k best so far per query and gives them once, at its end, so only
    k rows a query and partition cross to the JVM. Queries are collected in
    blocks of QUERY_BLOCK. A query meets the vectors of its own dimension; null vectors and those of length 0 have no neighbours. With permissions, vectors also
    have owner_id, is_public and org_tag, and queries user_id and tags: the filter applies before the k best are taken.
    """
    total = queries.count()
    asked = ["query_id", "vector"] + (["user_id", "tags"] if permissions else [])
    held = ["chunk_id", "vector"] + (["owner_id", "is_public", "org_tag"] if permissions else [])
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        rows = part.select(*asked).where(F.size("vector") > 0).collect()
        scored = vectors.select(*held).mapInPandas(_nearest(rows, k, permissions), "query_id long, chunk_id long, score double")
        found = scored if found is None else found.unionByName(scored)
    return top(found.withColumn("score", F.round("score", 9)), k)


class _Nearest:
    """The k best so far of the queries of one dimension, as two arrays with a row a query: scores descending, ids."""

    def __init__(self, rows: list, k: int, permissions: bool):
        matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        kept = [r for r, n in zip(rows, norms, strict=True) if n > 0]
        self.unit, self.ids, self.k = matrix[norms > 0] / norms[norms > 0, None], np.array([r["query_id"] for r in kept]), k
        #: Rows of the queries of each asker.
        self.askers: dict[tuple, list[int]] = {}
        for at, r in enumerate(kept if permissions else []):
            self.askers.setdefault((r["user_id"], frozenset(r["tags"] or ())), []).append(at)
        self.score, self.chunk = np.full((len(kept), k), -np.inf), np.zeros((len(kept), k), np.int64)

    def see(self, pdf: pd.DataFrame, vectors: np.ndarray) -> None:
        score = np.round(self.unit @ vectors.T, 9)
        if self.askers:
            owner, public, tag = (pdf[c].to_numpy() for c in ("owner_id", "is_public", "org_tag"))
            classes, which = np.unique(tag.astype(str), return_inverse=True)
            for (user, tags), rows in self.askers.items():
                held = np.fromiter((t in tags for t in classes), bool, len(classes))
                score[np.ix_(rows, np.flatnonzero(~(public.astype(bool) | (owner == user) | held[which])))] = -np.inf
        # only what reaches a query's k-th score so far can change its k best
        reach = (score >= self.score[:, -1:]) & (score > -np.inf)
        count = reach.sum(axis=1)
        rows = np.flatnonzero(count)
        if not len(rows):
            return
        width = min(int(count.max()), score.shape[1])
        near = score[rows]
        at = np.argpartition(-near, width - 1, axis=1)[:, :width]
        chunk = pdf["chunk_id"].to_numpy().astype(np.int64)
        near, chunk = np.concatenate([self.score[rows], np.take_along_axis(near, at, axis=1)], axis=1), np.concatenate([self.chunk[rows], chunk[at]], axis=1)
        order = np.lexsort((chunk, -near), axis=1)[:, : self.k]
        self.score[rows], self.chunk[rows] = np.take_along_axis(near, order, axis=1), np.take_along_axis(chunk, order, axis=1)

    def found(self) -> pd.DataFrame:
        good = self.score > -np.inf
        return pd.DataFrame({"query_id": np.repeat(self.ids, good.sum(axis=1)), "chunk_id": self.chunk[good], "score": self.score[good]})


def _nearest(rows: list, k: int, permissions: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(len(r["vector"]), []).append(r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {size: _Nearest(group, k, permissions) for size, group in groups.items()}
        for whole in batches:
            for at in range(0, len(whole), BATCH_ROWS):
                pdf = whole.iloc[at : at + BATCH_ROWS]
                sizes = pdf["vector"].map(lambda v: -1 if v is None else len(v)).to_numpy()
                for size, near in best.items():
                    fits = pdf[sizes == size]
                    if not len(fits) or not len(near.ids):
                        continue
                    v = np.stack(fits["vector"].to_numpy()).astype(np.float64)
                    length = np.linalg.norm(v, axis=1)
                    if (length > 0).any():
                        near.see(fits[length > 0], v[length > 0] / length[length > 0, None])
        for near in best.values():
            yield near.found()

    return run


def fuse(keyword: DataFrame, vector: DataFrame, keyword_weight: float, vector_weight: float, k: int, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (query_id, key, rank) -> (query_id, key, rrf, rank).

    Ties: keyword hits first, in their order, then vector hits, then the key. k <= 0 gives nothing; negative or all-zero
    weights are refused. A union and one grouped sum replace the full outer join.
    """
    if keyword_weight < 0 or vector_weight < 0 or keyword_weight + vector_weight == 0:
        raise ValueError("fusion weights must not be negative, and not both zero")
    n = F.lit(1_000_000_000)
    both = keyword.select("query_id", key, (F.lit(keyword_weight) / (RRF_K + F.col("rank"))).alias("part"), F.col("rank").cast("long").alias("seen")).unionByName(
        vector.select("query_id", key, (F.lit(vector_weight) / (RRF_K + F.col("rank"))).alias("part"), (n + F.col("rank")).cast("long").alias("seen"))
    )
    fused = both.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("rrf"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "seen", key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(k, 0)).drop("seen")


def fuse_variants(keyword: DataFrame, vector: DataFrame, variants: dict[str, tuple[float, float]], k: int) -> DataFrame:
    """Several fusions of the same two lists in one pass: (method, query_id, chunk_id, rrf, rank).

    A weight of 0 leaves a list out, so (1, 0) and (0, 1) are the lists themselves.
    """
    n = 1_000_000_000
    weights = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(float(a)).alias("wk"), F.lit(float(b)).alias("wv")) for m, (a, b) in variants.items()])
    both = keyword.select("query_id", "chunk_id", "rank", F.lit(True).alias("_kw")).unionByName(vector.select("query_id", "chunk_id", "rank", F.lit(False).alias("_kw")))
    wide = both.select("query_id", "chunk_id", "rank", "_kw", F.inline(weights)).withColumn("w", F.when(F.col("_kw"), F.col("wk")).otherwise(F.col("wv"))).where("w > 0")
    seen = F.when(F.col("_kw"), F.col("rank")).otherwise(n + F.col("rank"))
    fused = wide.groupBy("method", "query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.min(seen).alias("seen"))
    order = Window.partitionBy("method", "query_id").orderBy(F.col("rrf").desc(), "seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("seen")


def fusion_limit(k: int, reranked: bool) -> int:
    return max(k, RERANK_WINDOW) if reranked else k


def rerank(hits: DataFrame, k: int, score: Callable[[Column, Column], Column] | None) -> DataFrame:
    """hits (query_id, chunk_id, rank, query_text, text) -> k hits per query in the order of a score function.

    Queries with at most k candidates keep their order, as does every query where no function is given.
    """
    if score is None:
        return hits.where(F.col("rank") <= k)
    counted = hits.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    scored = counted.withColumn("_s", F.when(F.col("_n") > k, score(F.col("query_text"), F.col("text"))).otherwise(-F.col("rank").cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.col("_s").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("_n", "_s")


def rerank_by_answers(hits: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """hits (query_id, rank, ...), answers (query_id, seq, position, score) of a rerank service -> k hits per query.

    position counts from 0 along the ranks; the first answer for a position counts. Queries with at most k candidates,
    with a position out of bounds, or with fewer than k positions answered keep their order. The score of a hit that was
    reranked is the answer's, and null otherwise.
    """
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    first = answers.groupBy("query_id", "position").agg(F.min_by("score", "seq").alias("_score"), F.min("seq").alias("_seq"))
    bounded = first.join(sizes, "query_id")
    inside = (F.col("position") >= 0) & (F.col("position") < F.col("_n"))
    usable = bounded.groupBy("query_id", "_n").agg(F.count("*").alias("_m"), F.bool_and(inside).alias("_in")).where(f"_in and _m >= {int(k)} and _n > {int(k)}")
    scored = bounded.join(usable.select("query_id"), "query_id", "left_semi").select("query_id", (F.col("position") + 1).cast("long").alias("rank"), "_score", "_seq")
    rows = hits.join(usable.select("query_id", F.lit(True).alias("_used")), "query_id", "left").join(scored, ["query_id", "rank"], "left")
    rows = rows.where(F.col("_used").isNull() | F.col("_score").isNotNull())
    order = Window.partitionBy("query_id").orderBy(F.col("_score").desc(), F.col("_seq"), "rank")
    rows = rows.withColumn("_k", F.row_number().over(order).cast("long")).where(F.col("_k") <= k)
    return rows.withColumns({"rank": F.col("_k"), "score": F.col("_score")}).drop("_k", "_score", "_seq", "_used")


def fill_file_names(hits: DataFrame, files: DataFrame) -> DataFrame:
    """hits (file_id, file_name, ...) with missing names taken from files (file_id, file_name); other names stay."""
    named = files.select("file_id", F.col("file_name").alias("_name"))
    return hits.join(named, "file_id", "left").withColumn("file_name", F.coalesce("file_name", "_name")).drop("_name")


def index_rows(chunks: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """chunks (file_id, ordinal, text) with the columns of their file that searches filter on, and a deterministic id."""
    rows = chunks.join(files.select("file_id", "file_name", "md5", "owner_id", "org_tag", "is_public"), "file_id")
    return rows.withColumn("index_id", F.concat_ws(":", F.col("file_id").cast("string"), F.lit(version), F.col("ordinal").cast("string")))


def unique_ranks(ranked: DataFrame, key: str) -> DataFrame:
    """The first row of each key per query; later repeats do not take a rank."""
    first = ranked.groupBy("query_id", key).agg(F.min("rank").alias("_first"))
    order = Window.partitionBy("query_id").orderBy("_first", key)
    return first.withColumn("rank", F.row_number().over(order).cast("long")).drop("_first")


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks next to the first PRIMARY_HITS hits in their section that are not hits themselves.

    hits (query_id, rank, section_id, ordinal), chunks (section_id, ordinal, tokens) -> (query_id, hit_rank, section_id,
    ordinal, tokens), each once, with the smallest rank that asks for it.
    """
    wanted = hits.where(F.col("rank") <= PRIMARY_HITS).select("query_id", F.col("rank").alias("hit_rank"), "section_id", F.explode(F.array(F.greatest(F.lit(1).cast("long"), F.col("ordinal") - 1), F.col("ordinal"), F.col("ordinal") + 1)).alias("ordinal"))
    wanted = wanted.groupBy("query_id", "section_id", "ordinal").agg(F.min("hit_rank").alias("hit_rank"))
    free = wanted.join(hits.select("query_id", "section_id", "ordinal"), ["query_id", "section_id", "ordinal"], "left_anti")
    return free.join(chunks.select("section_id", "ordinal", "tokens"), ["section_id", "ordinal"])


def within_budget(hits: DataFrame, around: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Neighbours that fit: from the tokens of the primary hits on, a neighbour that would pass the budget is skipped, and
    later smaller ones may still be added. Per query a fold over at most 3 * PRIMARY_HITS rows."""
    base = hits.where(F.col("rank") <= PRIMARY_HITS).groupBy("query_id").agg(F.sum("tokens").alias("_base"))
    lists = around.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "ordinal", "section_id", "tokens"))).alias("_list"))
    joined = lists.join(base, "query_id")
    start = F.struct(F.col("_base").alias("used"), F.expr("cast(array() as array<struct<hit_rank:bigint,ordinal:bigint,section_id:bigint,tokens:bigint>>)").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + item["tokens"] <= budget
        return F.struct(F.when(fits, state["used"] + item["tokens"]).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["kept"], item)).otherwise(state["kept"]).alias("kept"))

    folded = joined.select("query_id", F.aggregate("_list", start, step)["kept"].alias("kept"))
    return folded.select("query_id", F.inline("kept"))
