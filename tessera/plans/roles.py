"""The driver's tables in the roles of files, users, tags, lines and queries, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import documents as D
from tessera.operators import retrieval as R
from tessera.session import spread, table

FILES = """files AS (
  SELECT d.doc_id AS file_id, 'doc-' || d.doc_id || '.txt' AS file_name, md5(d.text) AS md5, d.doc_id % 20 AS owner_id,
         n.n_name AS org_tag, d.doc_id % 10 = 0 AS is_public, CAST(length(d.text) AS BIGINT) AS size
  FROM documents d LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 25)"""
USERS = """users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS username, n_name || ',PRIVATE_' || c_name AS org_tags,
         CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, CAST(c_custkey % 97 AS BIGINT) AS created,
         CASE WHEN c_custkey % 3 = 0 THEN n_name END AS primary_org
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
TAGS = """tags AS (
  SELECT 'DEFAULT' AS tag_id, 'default' AS name, CAST(NULL AS VARCHAR) AS parent_tag
  UNION ALL SELECT r_name, lower(r_name), 'DEFAULT' FROM region
  UNION ALL SELECT n_name, lower(n_name), r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'ARCHIVE', 'archive', 'DEFAULT')"""
CLOSURE = """closure AS (
  SELECT tag_id, tag_id AS ancestor, 0 AS depth FROM tags
  UNION ALL SELECT c.tag_id, t.parent_tag, c.depth + 1 FROM closure c JOIN tags t ON t.tag_id = c.ancestor WHERE t.parent_tag IS NOT NULL)"""
EFFECTIVE = """direct AS (
  SELECT user_id, unnest(string_split(org_tags, ',')) AS tag FROM users),
effective AS (
  SELECT user_id, tag FROM direct UNION SELECT d.user_id, c.ancestor FROM direct d JOIN closure c ON c.tag_id = d.tag
  UNION SELECT user_id, 'DEFAULT' FROM users)"""
LINES = """lines AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS ordinal, line AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
  WHERE line <> '')"""


def tokens_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[A-Za-z0-9]{{1,4}}')) + len(regexp_extract_all({x}, '[^A-Za-z0-9\\s]')) AS BIGINT)"


ANALYZED = """tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
asked AS (
  SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term
  FROM benchmark),
tf AS (SELECT doc_id, term, len(t) AS dl, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term, len(t)),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM tok) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
bm AS (
  SELECT a.item_id AS query_id, tf.doc_id AS chunk_id,
         round(sum(idf.idf * tf.tf / (tf.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * tf.dl / (SELECT avg(len(t)) FROM tok)))), 9) AS score
  FROM tf JOIN idf USING (term) JOIN asked a USING (term) GROUP BY a.item_id, tf.doc_id)"""
VECTORS = """kn AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents))"""


def ranked_sql(source: str, k: int, where: str = "") -> str:
    return f"(SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source} {where} QUALIFY rank <= {k})"


def fused_sql(kw: str, vec: str, wk: float, wv: float, k: int) -> str:
    """SQL of weighted fusion over two ranked relations."""
    return f"""(SELECT query_id, chunk_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(sum(part), 9) AS rrf, min(seen) AS seen FROM (
        SELECT query_id, chunk_id, {wk}::DOUBLE / (60 + rank) AS part, rank AS seen FROM {kw}
        UNION ALL SELECT query_id, chunk_id, {wv}::DOUBLE / (60 + rank), 1000000000 + rank FROM {vec})
      GROUP BY query_id, chunk_id) QUALIFY rank <= {k})"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    nation = table(spark, sf, "nation").select((F.col("n_nationkey")).cast("long").alias("_n"), F.col("n_name").alias("org_tag"))
    rows = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.md5(F.col("text").cast("binary")).alias("md5"), (F.col("doc_id") % 20).alias("owner_id"), (F.col("doc_id") % 10 == 0).alias("is_public"), F.length("text").cast("long").alias("size"), (F.col("doc_id") % 25).alias("_n"))
    return rows.join(F.broadcast(nation), "_n", "left").drop("_n")


def users(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey")
    key = F.col("c_custkey").cast("long")
    return rows.select(key.alias("user_id"), F.col("c_name").alias("username"), F.concat("n_name", F.lit(",PRIVATE_"), "c_name").alias("org_tags"), F.when(key % 50 == 0, "ADMIN").otherwise("USER").alias("role"), (key % 97).alias("created"), F.when(key % 3 == 0, F.col("n_name")).alias("primary_org"))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    roots = spark.createDataFrame([("DEFAULT", "default", None), ("ARCHIVE", "archive", "DEFAULT")], "tag_id string, name string, parent_tag string")
    regions = region.select(F.col("r_name").alias("tag_id"), F.lower("r_name").alias("name"), F.lit("DEFAULT").alias("parent_tag"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("tag_id"), F.lower("n_name").alias("name"), F.col("r_name").alias("parent_tag"))
    return roots.unionByName(regions).unionByName(nations)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents, dealt over all cores if they are few."""
    return spread(table(spark, sf, "documents"), "doc_id")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.lines(texts(spark, sf))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark passage, whole."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return held.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, sf, "embeddings").join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def values(spark: SparkSession, sql: str) -> DataFrame:
    """A literal relation: ``(VALUES ...) AS t(...)`` reads alike in both engines."""
    return spark.sql(f"SELECT * FROM {sql}")


def as_line_chunks(rows: DataFrame) -> DataFrame:
    """Lines as chunks: five lines of a document are a section."""
    section = F.floor((F.col("ordinal") - 1) / 5).cast("long")
    return rows.withColumns({"section_id": F.col("doc_id") * 100_000 + section, "tokens": T.token_estimate(F.col("text"))})


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return as_line_chunks(lines(spark, sf)).select("doc_id", "section_id", "ordinal", "text", "tokens")


LINE_CHUNKS = f"""{LINES},
line_chunks AS (SELECT doc_id, doc_id * 100000 + (ordinal - 1) // 5 AS section_id, ordinal, text, {tokens_sql('text')} AS tokens FROM lines)"""
