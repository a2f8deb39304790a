"""Queries of retrieval, fusion, neighbours, contexts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import engine
from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import ann as N
from tessera.operators import conversation as C
from tessera.operators import evaluation as E
from tessera.operators import pruned as P
from tessera.operators import retrieval as R
from tessera.plans import roles as X
from tessera.plans.registry import query
from tessera.session import table, written

S = SparkSession
#: Each benchmark query is asked by the user with id item_id % 20 + 1.
ASKER = "(item_id % 20) + 1"


def _keyword(spark: S, sf: str, k: int = R.RECALL) -> DataFrame:
    return P.bm25_top(X.chunks(spark, sf), X.text_queries(spark, sf), k)


def _vector(spark: S, sf: str, k: int = R.RECALL) -> DataFrame:
    return R.knn(X.vectors(spark, sf), X.vector_queries(spark, sf), k)


@query("bm25_topk", f"WITH {X.ANALYZED} SELECT * FROM {X.ranked_sql('bm', 10)}")
def bm25_topk(spark: S, sf: str) -> DataFrame:
    return _keyword(spark, sf, 10).select("query_id", "chunk_id", "score", "rank")


@query("bm25_document_stats", r"""
SELECT doc_id AS chunk_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS BIGINT) AS dl FROM documents""")
def document_stats(spark: S, sf: str) -> DataFrame:
    return R.document_stats(X.chunks(spark, sf))


@query("bm25_postings_by_term", r"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL)
GROUP BY term""")
def postings_by_term(spark: S, sf: str) -> DataFrame:
    return R.postings(X.chunks(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("knn_cosine_topk", f"WITH {X.VECTORS} SELECT * FROM {X.ranked_sql('kn', 10)}")
def knn_cosine_topk(spark: S, sf: str) -> DataFrame:
    return _vector(spark, sf, 10)


def _approximate(spark: S, sf: str, k: int) -> DataFrame:
    vectors = X.vectors(spark, sf)
    quantizer = N.train(vectors, k)
    if quantizer is None:
        return R.knn(vectors, X.vector_queries(spark, sf), k)
    return N.search(N.index(vectors, quantizer), quantizer, X.vector_queries(spark, sf), k)


@query("knn_lists_topk")
def knn_lists_topk(spark: S, sf: str) -> DataFrame:
    """The 100 nearest by inverted lists and product codes, with exact scores."""
    return _approximate(spark, sf, R.RECALL)


@query("knn_lists_recall")
def knn_lists_recall(spark: S, sf: str) -> DataFrame:
    """Of the 100 exact neighbours of each query, how many the inverted lists find."""
    return N.recall(_approximate(spark, sf, R.RECALL), _vector(spark, sf))


def _fused(spark: S, sf: str, wk: float, wv: float, k: int) -> DataFrame:
    return R.fuse(_keyword(spark, sf), _vector(spark, sf), wk, wv, k)


def _fusion_sql(wk: float, wv: float, k: int) -> str:
    return f"WITH {X.ANALYZED}, {X.VECTORS} SELECT * FROM {X.fused_sql(X.ranked_sql('bm', 100), X.ranked_sql('kn', 100), wk, wv, k)}"


@query("rrf_equal", _fusion_sql(1.0, 1.0, 10))
def rrf_equal(spark: S, sf: str) -> DataFrame:
    return _fused(spark, sf, 1.0, 1.0, 10)


@query("rrf_weighted", _fusion_sql(0.1, 0.9, 10))
def rrf_weighted(spark: S, sf: str) -> DataFrame:
    return _fused(spark, sf, R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT, 10)


@query("rrf_rerank_candidates", _fusion_sql(0.1, 0.9, 30))
def rrf_rerank_candidates(spark: S, sf: str) -> DataFrame:
    return _fused(spark, sf, R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT, R.fusion_limit(10, True))


def _principals(spark: S, sf: str) -> DataFrame:
    """(query_id, user_id, tags): who asks each query, with the effective tags."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20 + 1).alias("user_id"))
    who = X.users(spark, sf).join(asked.select("user_id").distinct(), "user_id", "left_semi")
    held = A.effective_tags(who, X.tags(spark, sf)).groupBy("user_id").agg(F.collect_set("tag").alias("tags"))
    return asked.join(held, "user_id", "left").select("query_id", "user_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def _chunk_access(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).select(F.col("file_id").alias("chunk_id"), "file_name", "owner_id", "is_public", "org_tag")


_ALLOWED_SQL = f"""{X.FILES}, {X.USERS}, {X.TAGS}, {X.CLOSURE}, {X.EFFECTIVE},
allowed AS (
  SELECT DISTINCT b.item_id AS query_id, f.file_id AS chunk_id FROM benchmark b CROSS JOIN files f
  WHERE f.is_public OR f.owner_id = (b.item_id % 20) + 1 OR f.org_tag IN (SELECT tag FROM effective e WHERE e.user_id = (b.item_id % 20) + 1))"""
_MAY = "SEMI JOIN allowed USING (query_id, chunk_id)"


@query("hybrid_search_topk", f"""WITH RECURSIVE {_ALLOWED_SQL}, {X.ANALYZED}, {X.VECTORS},
fused AS {X.fused_sql(X.ranked_sql('bm', 100, _MAY), X.ranked_sql('kn', 100, _MAY), 0.1, 0.9, 10)}
SELECT query_id, chunk_id, rrf, rank, '《doc-' || chunk_id || '》｜原文片段：“' || CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 40) || '…' END || '”' AS source_label
FROM fused JOIN (SELECT doc_id AS chunk_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ' || chr(10)) AS t FROM documents) USING (chunk_id)""")
def hybrid_search_topk(spark: S, sf: str) -> DataFrame:
    """Permission-filtered BM25 and cosine top 100, weighted fusion, top 10, with source labels."""
    access, principals = _chunk_access(spark, sf), _principals(spark, sf)
    keyword = P.bm25_top(X.chunks(spark, sf), X.text_queries(spark, sf), R.RECALL, principals, access)
    asked = X.vector_queries(spark, sf).join(principals, "query_id")
    vector = R.knn(X.vectors(spark, sf).join(access, "chunk_id"), asked, R.RECALL, permissions=True)
    fused = R.fuse(keyword, vector, R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT, 10)
    names = access.select("chunk_id", "file_name")
    rows = fused.join(X.chunks(spark, sf), "chunk_id").join(names, "chunk_id")
    none = F.lit(None).cast("int")
    return rows.select("query_id", "chunk_id", "rrf", "rank", T.source_label(F.col("file_name"), F.lit(None).cast("string"), none, none, F.col("text")).alias("source_label"))


@query("hybrid_search_unfiltered", _fusion_sql(0.1, 0.9, 5))
def hybrid_search_unfiltered(spark: S, sf: str) -> DataFrame:
    return _fused(spark, sf, R.KEYWORD_WEIGHT, R.VECTOR_WEIGHT, 5)


@query("text_only_min_score", f"WITH RECURSIVE {_ALLOWED_SQL}, {X.ANALYZED} SELECT * FROM {X.ranked_sql('bm', 10, _MAY + ' WHERE score >= 0.3')}")
def text_only_min_score(spark: S, sf: str) -> DataFrame:
    hits = P.bm25_top(X.chunks(spark, sf), X.text_queries(spark, sf), 10, _principals(spark, sf), _chunk_access(spark, sf))
    return hits.where(F.col("score") >= R.MIN_SCORE).select("query_id", "chunk_id", "score", "rank")


@query("text_only_unfiltered", f"WITH {X.ANALYZED} SELECT query_id, chunk_id, rank FROM {X.ranked_sql('bm', 10)}")
def text_only_unfiltered(spark: S, sf: str) -> DataFrame:
    """Without vectors the search degrades to text only."""
    return engine.hybrid_search(X.chunks(spark, sf), X.text_queries(spark, sf), 10)


@query("engine_hybrid_search", f"SELECT query_id, chunk_id, rank FROM ({_fusion_sql(0.1, 0.9, 10)})")
def engine_hybrid_search(spark: S, sf: str) -> DataFrame:
    chunks = X.chunks(spark, sf).join(X.vectors(spark, sf), "chunk_id", "left")
    asked = X.text_queries(spark, sf).join(X.vector_queries(spark, sf), "query_id")
    return engine.hybrid_search(chunks, asked, 10)


@query("vector_dimension_check", "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimension_check(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ evaluation

_QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def qrels_of(spark: S, sf: str) -> DataFrame:
    """Documents that hold a passage verbatim."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return E.holders(X.chunks(spark, sf), items)


@query("qrels", f"WITH {_QRELS} SELECT * FROM qrels")
def qrels(spark: S, sf: str) -> DataFrame:
    return qrels_of(spark, sf)


def _runs(spark: S, sf: str) -> DataFrame:
    variants = {"bm25": (1, 0), "vector": (0, 1), "rrf_1_1": (1, 1), "rrf_3_7": (0.3, 0.7), "rrf_1_9": (0.1, 0.9)}
    return R.fuse_variants(_keyword(spark, sf), _vector(spark, sf), variants, 10)


def _runs_sql() -> str:
    kw, vec = X.ranked_sql("bm", 100), X.ranked_sql("kn", 100)
    fused = " UNION ALL ".join(f"SELECT '{n}', query_id, chunk_id, rank FROM {X.fused_sql('kw', 've', a, b, 10)}" for n, a, b in (("rrf_1_1", 1.0, 1.0), ("rrf_3_7", 0.3, 0.7), ("rrf_1_9", 0.1, 0.9)))
    return f"""{X.ANALYZED}, {X.VECTORS}, {_QRELS}, kw AS {kw}, ve AS {vec},
runs AS (SELECT 'bm25' AS method, query_id, chunk_id, rank FROM kw WHERE rank <= 10 UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM ve WHERE rank <= 10 UNION ALL {fused})"""


def _metrics_sql() -> str:
    per_cut = ", ".join(
        f"CASE WHEN n{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit{k}, n{k}::DOUBLE / relevant AS recall{k}, n{k}::DOUBLE / {k} AS precision{k}, "
        f"g{k} / list_sum(list_transform(range(1, least({k}, relevant) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg{k}"
        for k in E.CUTS
    )
    sums = ", ".join(f"count(*) FILTER (f.rank <= {k}) AS n{k}, coalesce(sum(1.0::DOUBLE / log2(f.rank + 1)) FILTER (f.rank <= {k}), 0) AS g{k}" for k in E.CUTS)
    return f"""{_runs_sql()},
rel AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY 1),
got AS (
  SELECT m.method, r.query_id, r.relevant, min(f.rank) AS first, {sums}
  FROM (SELECT DISTINCT method FROM runs) m CROSS JOIN rel r
  LEFT JOIN (SELECT method, query_id, chunk_id, min(rank) AS rank FROM runs SEMI JOIN qrels USING (query_id, chunk_id) GROUP BY ALL) f ON f.method = m.method AND f.query_id = r.query_id
  GROUP BY ALL),
metrics AS (SELECT method, query_id, relevant, CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0.0::DOUBLE END AS mrr10, {per_cut} FROM got)"""


_NAMES = ["mrr10"] + [f"{m}{k}" for k in E.CUTS for m in ("hit", "recall", "precision", "ndcg")]


@query("metrics_by_query", f"WITH {_metrics_sql()} SELECT method, query_id, relevant, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM metrics")
def metrics_by_query(spark: S, sf: str) -> DataFrame:
    rows = E.query_metrics(_runs(spark, sf), qrels_of(spark, sf))
    return rows.select("method", "query_id", "relevant", *[F.round(n, 6).alias(n) for n in _NAMES])


@query("metrics_by_method", f"WITH {_metrics_sql()} SELECT method, count(*) AS queries, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM metrics GROUP BY method")
def metrics_by_method(spark: S, sf: str) -> DataFrame:
    return E.method_report(E.query_metrics(_runs(spark, sf), qrels_of(spark, sf)))


@query("distinct_first", f"""WITH {X.ANALYZED}, kw AS {X.ranked_sql('bm', 100)}
SELECT query_id, locator, row_number() OVER (PARTITION BY query_id ORDER BY first, locator) AS rank FROM (
  SELECT query_id, md5(text) AS locator, min(rank) AS first FROM kw JOIN documents ON doc_id = chunk_id GROUP BY ALL)""")
def distinct_first(spark: S, sf: str) -> DataFrame:
    """Ranks over distinct contents: the best chunk of each stands for it."""
    named = X.chunks(spark, sf).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("locator"))
    return R.unique_ranks(_keyword(spark, sf).join(named, "chunk_id"), "locator")


@query("evidence_plus_distractors", f"""WITH {_QRELS}, ev AS (SELECT DISTINCT chunk_id AS doc_id FROM qrels)
SELECT doc_id, TRUE AS evidence FROM documents SEMI JOIN ev USING (doc_id)
UNION ALL SELECT * FROM (SELECT doc_id, FALSE FROM documents ANTI JOIN ev USING (doc_id) ORDER BY doc_id LIMIT 200)""")
def evidence_plus_distractors(spark: S, sf: str) -> DataFrame:
    claims = qrels_of(spark, sf).groupBy("query_id").agg(F.collect_set("chunk_id").alias("relevant"))
    corpus = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("position"))
    return E.selected_corpus(claims, corpus, 200).select("doc_id", "evidence")


# ------------------------------------------------------------------ neighbours and contexts

_HITS = f"""{X.ANALYZED}, {X.LINE_CHUNKS}, found AS {X.ranked_sql('bm', 10)},
longest AS (SELECT * FROM line_chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) = 1),
hits AS (SELECT f.query_id, l.section_id, l.ordinal, l.doc_id, l.text, l.tokens, f.rank FROM found f JOIN longest l ON l.doc_id = f.chunk_id)"""


def _line_hits(spark: S, sf: str) -> DataFrame:
    """The ten best documents of each benchmark query, each by its longest line; written, as they are read several times."""
    rows = X.lines(spark, sf)
    longest = rows.groupBy("doc_id").agg(F.max_by(F.struct("ordinal", "text"), F.struct(F.length("text"), -F.col("ordinal"))).alias("_l")).select("doc_id", "_l.*")
    found = _keyword(spark, sf, 10).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    return written(X.as_line_chunks(found.join(longest, "doc_id")), "line-hits")


_AROUND = f"""{_HITS},
wanted AS (
  SELECT query_id, section_id, o AS ordinal, min(rank) AS hit_rank FROM (
    SELECT query_id, section_id, rank, unnest([greatest(1, ordinal - 1), ordinal, ordinal + 1]) AS o FROM hits WHERE rank <= 5) GROUP BY ALL),
around AS (
  SELECT w.query_id, w.hit_rank, w.section_id, w.ordinal, l.tokens FROM wanted w JOIN line_chunks l USING (section_id, ordinal)
  ANTI JOIN hits h USING (query_id, section_id, ordinal))"""


@query("neighbor_expand", f"WITH {_AROUND} SELECT * FROM around")
def neighbor_expand(spark: S, sf: str) -> DataFrame:
    around = R.neighbours(_line_hits(spark, sf), X.line_chunks(spark, sf))
    return around.select("query_id", "hit_rank", "section_id", "ordinal", "tokens")


@query("neighbor_budget", f"""WITH RECURSIVE {_AROUND},
base AS (SELECT query_id, CAST(sum(tokens) AS BIGINT) AS b FROM hits WHERE rank <= 5 GROUP BY 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, ordinal, section_id) AS n FROM around),
fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS n, b AS used, FALSE AS took, CAST(NULL AS BIGINT) AS hit_rank, CAST(NULL AS BIGINT) AS section_id, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS BIGINT) AS tokens FROM base
  UNION ALL SELECT f.query_id, s.n, CASE WHEN f.used + s.tokens <= 3500 THEN f.used + s.tokens ELSE f.used END, f.used + s.tokens <= 3500, s.hit_rank, s.section_id, s.ordinal, s.tokens
  FROM fold f JOIN seq s ON s.query_id = f.query_id AND s.n = f.n + 1)
SELECT query_id, hit_rank, ordinal, section_id, tokens FROM fold WHERE took""")
def neighbor_budget(spark: S, sf: str) -> DataFrame:
    hits = _line_hits(spark, sf)
    return R.within_budget(hits, R.neighbours(hits, X.line_chunks(spark, sf)))


@query("prompt_context", f"""WITH {_HITS}
SELECT query_id, string_agg('[来源#' || rank || ']' || chr(10) || '来源：《doc-' || doc_id || '》' || chr(10) || '文件：doc-' || doc_id || '.txt' || chr(10) || '页码：第 ' || ordinal || ' 页' || chr(10)
   || '正文：' || chr(10) || trim(text) || chr(10) || '[/来源#' || rank || ']' || chr(10) || chr(10), '' ORDER BY rank) AS prompt, count(*) AS sources
FROM hits WHERE rank <= 5 GROUP BY query_id""")
def prompt_context(spark: S, sf: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    hits = _line_hits(spark, sf).where("rank <= 5").withColumns({"file_name": F.concat(name, F.lit(".txt")), "title_path": F.lit(None).cast("string"), "page_start": F.col("ordinal").cast("int"), "page_end": F.col("ordinal").cast("int"), "source_label": F.concat(F.lit("《"), name, F.lit("》"))})
    return C.prompt_context(hits)


_ANSWERS = "(VALUES (1, '见【来源#1】和【来源# 2】，另见【来源#9】【来源#1】'), (2, '没有引用'), (3, CAST(NULL AS STRING)), (4, '【来源#3】')) AS t(id, answer)"


@query("citation_validate", """WITH t AS (SELECT * FROM """ + _ANSWERS.replace("STRING", "VARCHAR") + """),
c AS (SELECT id, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '【来源#\\s*(\\d+)】', 1), lambda x: CAST(x AS INTEGER))) AS cited FROM t)
SELECT CAST(id AS INTEGER) AS id, array_to_string(list_sort(cited), ',') AS cited, array_to_string(list_sort(list_filter(cited, lambda x: x > 2)), ',') AS invalid, len(cited) > 0 AS has_citation, len(list_filter(cited, lambda x: x > 2)) = 0 AS all_valid FROM c""")
def citation_validate(spark: S, sf: str) -> DataFrame:
    rows = X.values(spark, _ANSWERS).withColumn("source_ids", F.array(F.lit(1), F.lit(2)))
    checked = C.validate_citations(rows)
    return checked.select("id", F.array_join(F.array_sort("cited"), ",").alias("cited"), F.array_join(F.array_sort("invalid"), ",").alias("invalid"), "has_citation", "all_valid")


_HAN = "(VALUES (1, '公司请假制度 HR 流程'), (2, '年假十天，病假需要证明'), (3, 'plain words'), (4, '制度')) AS t(chunk_id, text)"
_HAN_ASKED = "(VALUES (1, '请假制度'), (2, '病假 hr'), (3, '天')) AS t(query_id, query_text)"


def _han_terms(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '\\p{{Han}}+|[\\p{{L}}\\p{{N}}--\\p{{Han}}]+')".replace("[\\p{L}\\p{N}--\\p{Han}]+", "[a-z0-9]+")
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_full_match(r, '\\p{{Han}}{{3,}}') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))".replace("\\\\", "\\")


@query("bm25_han", f"""WITH tok AS (SELECT chunk_id, {_han_terms('text')} AS t FROM {_HAN}),
asked AS (SELECT query_id, unnest(list_distinct({_han_terms('query_text')})) AS term FROM {_HAN_ASKED}),
tf AS (SELECT chunk_id, term, len(t) AS dl, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (4 - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term)
SELECT query_id, chunk_id, round(sum(idf * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(t)) FROM tok)))), 9) AS score
FROM tf JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL""")
def bm25_han(spark: S, sf: str) -> DataFrame:
    """Chinese questions against Chinese texts, by bigrams."""
    return R.bm25(X.values(spark, _HAN), X.values(spark, _HAN_ASKED), han=True)


@query("valid_hits", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def valid_hits(spark: S, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("chunk_id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    return R.valid_hits(hits).select("chunk_id")
