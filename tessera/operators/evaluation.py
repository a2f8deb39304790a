"""Retrieval metrics over ranked lists and relevance judgements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def query_metrics(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """run (method, query_id, chunk_id, rank), qrels (query_id, chunk_id) -> per method and query hit, recall, precision and
    nDCG at each cut, and the reciprocal rank within 10.

    Every relevant document is credited once, at its first rank; the ideal list is cut at k. Queries that a method returned
    nothing for count with zeros.
    """
    first = run.groupBy("method", "query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    found = first.join(qrels.distinct(), ["query_id", "chunk_id"], "left_semi")
    relevant = qrels.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    grid = run.select("method").distinct().join(relevant, how="cross")
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    sums = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"_n{k}") for k in cuts] + [F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"_g{k}") for k in cuts]
    got = found.groupBy("method", "query_id").agg(F.min("rank").alias("_first"), *sums)
    rows = grid.join(got, ["method", "query_id"], "left")
    # the ideal gain of r relevant documents at k, from a literal table of its k possible values
    ideal = lambda k: F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 1) for i in range(1, r + 1))) for r in range(1, k + 1)]), F.least(F.lit(k), F.col("relevant")).cast("int"))
    columns = {"mrr10": F.when(F.col("_first") <= 10, 1.0 / F.col("_first")).otherwise(0.0)}
    for k in cuts:
        n = F.coalesce(F.col(f"_n{k}"), F.lit(0))
        columns |= {f"hit{k}": (n > 0).cast("double"), f"recall{k}": n / F.col("relevant"), f"precision{k}": n / F.lit(float(k)), f"ndcg{k}": F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / ideal(k)}
    return rows.withColumns(columns).select("method", "query_id", "relevant", *columns)


def method_report(metrics: DataFrame) -> DataFrame:
    """Means over queries per method, rounded to 6 decimals."""
    names = [c for c in metrics.columns if c not in ("method", "query_id", "relevant")]
    return metrics.groupBy("method").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def selected_corpus(claims: DataFrame, corpus: DataFrame, distractors: int) -> DataFrame:
    """corpus (position, doc_id) -> evidence of the claims and the first distractors in file order; missing evidence is an error."""
    evidence = claims.select(F.explode("relevant").alias("doc_id")).distinct()
    if not evidence.join(corpus, "doc_id", "left_anti").isEmpty():
        raise ValueError("evidence that is not in the corpus")
    chosen = corpus.join(evidence, "doc_id", "left_semi").withColumn("evidence", F.lit(True))
    others = corpus.join(evidence, "doc_id", "left_anti").orderBy("position").limit(distractors).withColumn("evidence", F.lit(False))
    return chosen.unionByName(others)


def write_report(report: DataFrame, path: str) -> None:
    """A report or manifest as JSON lines; reports have a row per method or corpus, so one file holds them."""
    report.coalesce(1).write.mode("overwrite").json(path)


#: Words of a passage that a document is looked up by before it is searched for the whole passage.
ANCHOR = 3


def holders(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks (chunk_id, text) that hold a passage (query_id, passage) verbatim.

    An equality join instead of every chunk against every passage: the words of a passage without its first and last, which
    a chunk may hold as parts of longer ones, stand whole in every chunk that holds it, so the first ANCHOR of them are
    looked up among the runs of words of the chunks, and only what is found is searched for the passage. Shorter passages
    have no anchor and are compared with every chunk. Chunk ids are unique.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    cut = passages.withColumn("_w", words(F.col("passage")))
    long = F.size("_w") >= ANCHOR + 2
    anchored = cut.where(long).select("query_id", "passage", F.xxhash64(*[F.get("_w", k) for k in range(1, ANCHOR + 1)]).alias("_a"))
    split = chunks.where(F.col("text").isNotNull()).select("chunk_id", words(F.col("text")).alias("_w")).where(F.size("_w") >= ANCHOR)
    runs = split.select("chunk_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - ANCHOR), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(ANCHOR)])))).alias("_a"))
    pairs = runs.join(anchored.select("query_id", "_a"), "_a").select("query_id", "chunk_id").distinct()
    texts = chunks.select("chunk_id", "text")
    found = pairs.join(anchored.select("query_id", "passage"), "query_id").join(texts, "chunk_id").where(F.expr("contains(text, passage)"))
    short = cut.where(~long).select("query_id", "passage").join(texts, F.expr("contains(text, passage)"))
    return found.select("query_id", "chunk_id").unionByName(short.select("query_id", "chunk_id"))
