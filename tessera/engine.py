"""The engine's calls: ingest files, search for many queries, and prepare contexts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversation, documents, pruned, retrieval
from tessera.operators.embedding import Embedder, embed_chunks
from tessera.session import written
from tessera.sources import files as sources

log = logging.getLogger(__name__)


def ingest(files: DataFrame, embedder: Embedder | None = None, dimension: int = 64) -> tuple[DataFrame, DataFrame]:
    """files (doc_id, file_name, content) -> chunks, and rejects (doc_id, reason).

    Names are validated first; a file that cannot be read, or gives no section, is a reject. With an embedder, chunks have
    a vector of the file name, title path and text.
    """
    checked = sources.validate(files)
    refused = checked.where(~F.col("valid")).select("doc_id", "reason")
    parsed = sources.parse_files(checked.where("valid").select("doc_id", "file_name", "content"))
    chunks = documents.chunk_documents(parsed)
    failed = parsed.where(F.col("error").isNotNull()).select("doc_id", F.col("error").alias("reason"))
    empty = parsed.where(F.col("error").isNull()).join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no section").alias("reason"))
    rejects = refused.unionByName(failed).unionByName(empty)
    if embedder is not None:
        named = chunks.join(parsed.select("doc_id", "file_name"), "doc_id")
        named = named.withColumn("_body", T.embedding_text(F.col("file_name"), F.col("title_path"), F.col("text")))
        chunks = embed_chunks(named, embedder, dimension, "_body").drop("_body", "file_name")
    return chunks, rejects


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    principals: DataFrame | None = None,
    weights: tuple[float, float] = (retrieval.KEYWORD_WEIGHT, retrieval.VECTOR_WEIGHT),
    reranker: Callable[[Column, Column], Column] | None = None,
    han: bool = False,
) -> DataFrame:
    """chunks (chunk_id, text[, vector][, owner_id, is_public, org_tag]), queries (query_id, query_text[, vector]) ->
    (query_id, chunk_id, rank).

    With principals (query_id, user_id, tags) both searches are filtered before their best are taken. Where chunks or
    queries have no vector column the search is text-only; under principals such hits need a score of MIN_SCORE. han: Han
    text is searched by bigrams.
    """
    if "vector" not in chunks.columns or "vector" not in queries.columns:
        # the best are a prefix, so those of a least score among them are too
        keyword = pruned.bm25_top(chunks, queries, k, principals, han=han)
        return keyword.where(F.col("score") >= (0.0 if principals is None else retrieval.MIN_SCORE)).select("query_id", "chunk_id", "rank")
    keyword = pruned.bm25_top(chunks, queries, max(k, retrieval.RECALL), principals, han=han)
    asked = queries if principals is None else queries.join(principals, "query_id")
    vector = retrieval.knn(chunks, asked, max(k, retrieval.RECALL), permissions=principals is not None)
    limit = retrieval.fusion_limit(k, reranker is not None)
    fused = retrieval.fuse(keyword, vector, *weights, limit)
    if reranker is None:
        return fused.select("query_id", "chunk_id", "rank")
    texts = fused.join(queries.select("query_id", "query_text"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return retrieval.rerank(texts, k, reranker).select("query_id", "chunk_id", "rank")


def hybrid_search_or_less(chunks: DataFrame, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 10, principals: DataFrame | None = None, **options) -> tuple[DataFrame, str]:
    """hybrid_search with query vectors from a service that may fail, and how far it came: the rows and the step.

    embed adds a vector to queries. Where it raises, or leaves out all vectors, the search is text-only; where it leaves out
    some, those queries alone are. Each step's rows are written
    before they are returned, so a step that fails while it runs gives way to the next one. Where the text-only search
    fails as well, an asker with permissions gets no rows, and one without the error.
    """
    try:
        asked = embed(queries)
        if "vector" in asked.columns and not asked.where(F.col("vector").isNotNull()).isEmpty():
            rows = hybrid_search(chunks, asked.where(F.col("vector").isNotNull()), k, principals, **options)
            without = asked.where(F.col("vector").isNull()).drop("vector")
            if not without.isEmpty():
                rows = rows.unionByName(hybrid_search(chunks, without, k, principals, **options))
            return written(rows, "hybrid"), "hybrid"
    except (PySparkException, Py4JError, RuntimeError, OSError) as e:
        log.warning("no query vectors, the search is text-only: %s", e)
    try:
        return written(hybrid_search(chunks, queries.drop("vector"), k, principals, **options), "text"), "text"
    except (PySparkException, Py4JError):
        if principals is None:
            raise
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, rank long"), "nothing"


def enrich(hits: DataFrame, chunks: DataFrame, budget: int = retrieval.CONTEXT_TOKENS) -> DataFrame:
    """hits (query_id, rank, chunk_id), chunks (chunk_id, section_id, ordinal, tokens, text, file_name, title_path,
    page_start, page_end) -> hits and, after them, neighbours within the budget, with source labels."""
    rows = hits.join(chunks, "chunk_id")
    around = retrieval.within_budget(rows, retrieval.neighbours(rows, chunks), budget).join(chunks.drop("tokens"), ["section_id", "ordinal"])
    last = hits.groupBy("query_id").agg(F.max("rank").alias("_last"))
    order = F.row_number().over(_by_query("hit_rank", "ordinal", "section_id"))
    extra = around.join(last, "query_id").withColumn("rank", (F.col("_last") + order).cast("long"))
    names = ["query_id", "rank", "chunk_id", "text", "file_name", "title_path", "page_start", "page_end"]
    both = rows.withColumn("is_hit", F.lit(True)).select(*names, "is_hit").unionByName(extra.withColumn("is_hit", F.lit(False)).select(*names, "is_hit"))
    c = F.col
    return both.withColumn("source_label", T.source_label(c("file_name"), c("title_path"), c("page_start"), c("page_end"), c("text")))


def _by_query(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


build_context = conversation.prompt_context
validate_citations = conversation.validate_citations
