"""Queries of previews, point lookups, index rows, rerank answers, sessions, deletions and evaluation inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import conversation as C
from tessera.operators import retrieval as R
from tessera.operators import uploads as U
from tessera.plans import roles as X
from tessera.plans.registry import query
from tessera.plans.scalars import tidy_sql
from tessera.session import table
from tessera.sources import files as G

S = SparkSession

# ------------------------------------------------------------------ previews, names, errors

_SHOWN = "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.1f} KB', round(size / 1024.0, 1)) ELSE format('{:.1f} MB', size / 1048576.0) END"


@query("text_preview", f"""WITH named AS (SELECT doc_id, text, length(text) AS size, CASE WHEN doc_id % 5 = 0 THEN 'doc.xlsx' ELSE 'doc.txt' END AS name FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, len(string_split(text, chr(10))) AS n FROM named),
b AS (SELECT doc_id, line, k, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - strlen(line) - 1 AS before FROM l WHERE k < n OR line <> ''),
j AS (SELECT doc_id, string_agg(line || chr(10), '' ORDER BY k) AS body, sum(strlen(line) + 1) AS bytes FROM b WHERE before < 10240 GROUP BY 1)
SELECT doc_id, md5(CASE WHEN name = 'doc.xlsx' THEN '文件名: doc.xlsx' || chr(10) || '文件大小: ' || {_SHOWN} || chr(10) || '文件类型: XLSX' || chr(10) || '上传时间: 2024-01-01' || chr(10) || chr(10) || '此文件类型不支持预览，请下载后查看。'
  ELSE coalesce(body, '') || CASE WHEN coalesce(bytes, 0) >= 10240 THEN chr(10) || '{T.PREVIEW_CUT}' ELSE '' END END) AS digest
FROM named LEFT JOIN j USING (doc_id)""")
def text_preview(spark: S, sf: str) -> DataFrame:
    """Previews of all documents; every fifth one is a format without a text preview."""
    name = F.when(F.col("doc_id") % 5 == 0, "doc.xlsx").otherwise("doc.txt")
    shown = T.preview(name, F.col("text"), F.length("text"), F.lit("2024-01-01"))
    return X.texts(spark, sf).select("doc_id", F.md5(shown.cast("binary")).alias("digest"))


_OBJECTS = "(VALUES ('a/b.txt'), ('c\\d.txt'), (' e f '), (''), ('  '), (CAST(NULL AS STRING))) AS t(name)"


@query("safe_object_name", f"SELECT name, CASE WHEN s = '' THEN 'document' ELSE s END AS safe FROM (SELECT name, trim(replace(replace(coalesce(name, ''), '/', '_'), chr(92), '_')) AS s FROM {_OBJECTS.replace('STRING', 'VARCHAR')})")
def safe_object_name(spark: S, sf: str) -> DataFrame:
    rows = X.values(spark, _OBJECTS.replace("\\", "\\\\"))
    return rows.select("name", T.safe_name(F.col("name")).alias("safe"))


_ERRORS = "(VALUES (1, 'IllegalState', 'bad'), (2, 'Timeout', CAST(NULL AS STRING)), (3, CAST(NULL AS STRING), 'x'), (4, ' ', CAST(NULL AS STRING)), (5, 'Long', repeat('ab', 3000))) AS t(id, kind, message)"


@query("error_description", f"SELECT id, substr(CASE WHEN kind IS NULL OR trim(kind || coalesce(message, '')) = '' THEN '未知处理错误' WHEN message IS NULL THEN kind ELSE kind || ': ' || message END, 1, 4000) AS told FROM {_ERRORS.replace('STRING', 'VARCHAR')}")
def error_description(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _ERRORS).select("id", T.error_description(F.col("kind"), F.col("message")).alias("told"))


# ------------------------------------------------------------------ lookups and file joins


@query("file_lookup_by_owner_md5", f"WITH {X.FILES} SELECT file_id, owner_id, md5 FROM files SEMI JOIN (SELECT owner_id, md5 FROM files WHERE file_id % 20 = 0) w USING (owner_id, md5)")
def file_lookup_by_owner_md5(spark: S, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    return A.find_files(files, files.where("file_id % 20 = 0").select("owner_id", "md5")).select("file_id", "owner_id", "md5")


@query("file_lookup_public_name", f"WITH {X.FILES} SELECT file_id, file_name FROM files WHERE is_public AND file_name IN (SELECT 'doc-' || item_id || '.txt' FROM benchmark)")
def file_lookup_public_name(spark: S, sf: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("item_id").cast("string"), F.lit(".txt")).alias("file_name")
    wanted = table(spark, sf, "benchmark").select(name, F.lit(True).alias("is_public"))
    return A.find_files(X.files(spark, sf), wanted).select("file_id", "file_name")


@query("tag_lookup_by_parent", f"WITH {X.TAGS} SELECT tag_id, name FROM tags WHERE parent_tag IN (SELECT r_name FROM region WHERE r_regionkey < 2)")
def tag_lookup_by_parent(spark: S, sf: str) -> DataFrame:
    wanted = table(spark, sf, "region").where("r_regionkey < 2").select(F.col("r_name").alias("parent_tag"))
    return A.find_files(X.tags(spark, sf), wanted).select("tag_id", "name")


@query("hit_file_names", f"WITH {X.FILES}, h AS (SELECT item_id AS query_id, item_id * 3 AS file_id, CASE WHEN item_id % 2 = 0 THEN 'known.txt' END AS file_name FROM benchmark) SELECT query_id, file_id, coalesce(h.file_name, f.file_name) AS file_name FROM h LEFT JOIN files f USING (file_id)")
def hit_file_names(spark: S, sf: str) -> DataFrame:
    item = F.col("item_id")
    hits = table(spark, sf, "benchmark").select(item.alias("query_id"), (item * 3).alias("file_id"), F.when(item % 2 == 0, "known.txt").alias("file_name"))
    return R.fill_file_names(hits, X.files(spark, sf)).select("query_id", "file_id", "file_name")


@query("index_rows", f"WITH {X.FILES}, {X.LINES} SELECT file_id || ':v2:' || ordinal AS index_id, file_id, file_name, owner_id, org_tag, is_public, ordinal, l.text FROM lines l JOIN files ON file_id = doc_id")
def index_rows(spark: S, sf: str) -> DataFrame:
    chunks = X.lines(spark, sf).withColumnRenamed("doc_id", "file_id")
    return R.index_rows(chunks, X.files(spark, sf), "v2").select("index_id", "file_id", "file_name", "owner_id", "org_tag", "is_public", "ordinal", "text")


@query("index_document_count", f"WITH {X.LINES} SELECT count(*) AS n, count(DISTINCT doc_id) AS files FROM lines")
def index_document_count(spark: S, sf: str) -> DataFrame:
    return X.lines(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"))


@query("document_delete", f"""WITH {X.FILES}, {X.LINES}, gone AS (SELECT file_id FROM files WHERE owner_id = 7)
SELECT 'files' AS part, count(*) AS n FROM files ANTI JOIN gone USING (file_id)
UNION ALL SELECT 'sections', count(*) FROM (SELECT DISTINCT doc_id AS file_id, (ordinal - 1) // 5 FROM lines) s ANTI JOIN gone USING (file_id)
UNION ALL SELECT 'chunks', count(*) FROM (SELECT doc_id AS file_id FROM lines) c ANTI JOIN gone USING (file_id)""")
def document_delete(spark: S, sf: str) -> DataFrame:
    """What is left of every table after the files of one owner are deleted."""
    files = X.files(spark, sf)
    chunks = X.line_chunks(spark, sf).withColumnRenamed("doc_id", "file_id")
    tables = {"files": files, "sections": chunks.select("file_id", "section_id").distinct(), "chunks": chunks}
    left = None
    for part, rows in U.without_files(tables, files.where("owner_id = 7")).items():
        counted = rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
        left = counted if left is None else left.unionByName(counted)
    return left


@query("reindex_scan", f"WITH {X.FILES} SELECT file_id, file_name FROM files WHERE file_id % 3 = 1")
def reindex_scan(spark: S, sf: str) -> DataFrame:
    return U.to_reindex(X.files(spark, sf).withColumn("status", F.col("file_id") % 3)).select("file_id", "file_name")


# ------------------------------------------------------------------ rerank

_CANDIDATES = "hits AS (SELECT item_id AS query_id, CAST(r AS BIGINT) AS rank, item_id * 100 + r AS chunk_id FROM benchmark, range(1, 13) t(r) WHERE r <= 3 + item_id % 10)"


def _candidates(spark: S, sf: str) -> DataFrame:
    item = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(item.alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), 3 + item % 10)).alias("rank"))
    return rows.select("query_id", "rank", (F.col("query_id") * 100 + F.col("rank")).alias("chunk_id"))


@query("rerank_answers", f"""WITH {_CANDIDATES},
a AS (SELECT item_id AS query_id, CAST(s AS BIGINT) AS seq, (s * 7 + item_id) % 13 AS position, round(((s * 5 + item_id) % 11) / 11.0::DOUBLE, 6) AS score FROM benchmark, range(0, 13) t(s) WHERE (s * 7 + item_id) % 13 < 3 + item_id % 10 OR item_id % 6 = 0),
n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
f AS (SELECT query_id, position, arg_min(score, seq) AS score, min(seq) AS seq FROM a GROUP BY ALL),
u AS (SELECT query_id FROM f JOIN n USING (query_id) GROUP BY query_id, n HAVING n > 5 AND bool_and(position < n) AND count(*) >= 5)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, score
FROM (SELECT f.query_id, h.chunk_id, f.score, f.seq FROM f SEMI JOIN u USING (query_id) JOIN hits h ON h.query_id = f.query_id AND h.rank = f.position + 1) QUALIFY rank <= 5
UNION ALL SELECT query_id, chunk_id, rank, NULL FROM hits ANTI JOIN u USING (query_id) WHERE rank <= 5""")
def rerank_answers(spark: S, sf: str) -> DataFrame:
    """Answers by position: some queries have few candidates, and some have answers out of bounds."""
    item, s = F.col("item_id"), F.col("seq")
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("seq"))
    answers = asked.select(item.alias("query_id"), "seq", ((s * 7 + item) % 13).alias("position"), F.round(((s * 5 + item) % 11) / 11.0, 6).alias("score"))
    answers = answers.where((F.col("position") < 3 + F.col("query_id") % 10) | (F.col("query_id") % 6 == 0))
    return R.rerank_by_answers(_candidates(spark, sf), answers, 5).select("query_id", "chunk_id", "rank", "score")


# ------------------------------------------------------------------ sessions and tokens

_SESSIONS = """idx AS (SELECT user_id, event_id AS conv_id, ts AS updated FROM events),
metas AS (SELECT event_id AS conv_id, CASE WHEN event_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS owner_id, event_type AS title FROM events WHERE event_id % 11 <> 0)"""


@query("owned_sessions", f"""WITH {_SESSIONS}
SELECT user_id, conv_id, title, updated FROM (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, conv_id DESC) <= 5) JOIN metas USING (conv_id) WHERE owner_id = user_id""")
def owned_sessions(spark: S, sf: str) -> DataFrame:
    events, c = table(spark, sf, "events"), F.col
    index = events.select("user_id", c("event_id").alias("conv_id"), c("ts").alias("updated"))
    owner = F.when(c("event_id") % 7 == 0, c("user_id") + 1).otherwise(c("user_id"))
    metas = events.where("event_id % 11 <> 0").select(c("event_id").alias("conv_id"), owner.alias("owner_id"), c("event_type").alias("title"))
    return C.owned_sessions(index, metas, 5)


@query("active_token_count", "SELECT user_id, count(DISTINCT event_id) AS active FROM events WHERE ts + INTERVAL 5 MINUTE > TIMESTAMP '2024-01-10' GROUP BY 1")
def active_token_count(spark: S, sf: str) -> DataFrame:
    """Tokens live for five minutes after their stamp."""
    tokens = table(spark, sf, "events").select("user_id", F.col("event_id").alias("token_id"), F.expr("ts + INTERVAL 5 MINUTES").alias("expires_at"))
    return A.active_tokens(tokens, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


# ------------------------------------------------------------------ evaluation inputs and outlines

_CLAIMS = """(VALUES ('{"id":1,"claim":"a","evidence":{"10":[],"11":[]}}'), ('{"id":2,"claim":"b","evidence":{}}'), ('{"id":3,"claim":"c"}'), ('{"id":4,"claim":"d","evidence":{"12":[{"sentences":[1]}]}}')) AS t(value)"""
_CORPUS = """(VALUES (1, '{"doc_id":10,"title":"t","abstract":["x","y"]}'), (2, ''), (3, '{"doc_id":'), (4, '{"doc_id":11,"title":"u","abstract":[]}'), (5, '{"doc_id":10,"title":"v","abstract":["z"]}')) AS t(line, value)"""


@query("claims_scan", f"SELECT CAST(value ->> '$.id' AS BIGINT) AS id, value ->> '$.claim' AS claim, array_to_string(list_sort(json_keys(value, '$.evidence')), ',') AS relevant FROM {_CLAIMS} WHERE len(json_keys(value, '$.evidence')) > 0")
def claims_scan(spark: S, sf: str) -> DataFrame:
    return G.claims_of(X.values(spark, _CLAIMS)).withColumn("relevant", F.array_join(F.array_sort("relevant"), ","))


@query("corpus_scan", f"""WITH l AS (SELECT * FROM {_CORPUS} WHERE json_valid(value) AND value <> ''),
k AS (SELECT value ->> '$.doc_id' AS doc_id, arg_max(value, line) AS v FROM l GROUP BY 1)
SELECT doc_id, v ->> '$.title' AS title, CAST(json_array_length(v, '$.abstract') AS INTEGER) AS sentences, CAST(1 AS INTEGER) AS malformed FROM k""")
def corpus_scan(spark: S, sf: str) -> DataFrame:
    rows, malformed = G.corpus_of(X.values(spark, _CORPUS))
    return rows.select("doc_id", "title", F.size("abstract").alias("sentences"), F.lit(malformed).alias("malformed"))


_OUTLINE = "(VALUES (1, 1, CAST(NULL AS INT), 'Part  One', 1), (1, 2, 1, 'Chapter', 2), (1, 3, 2, 'Broken', CAST(NULL AS INT)), (1, 4, 3, 'Under broken', 3), (1, 5, 4, 'L5', 4), (1, 6, 5, 'L6', 5), (1, 7, 6, 'L7', 6), (1, 8, CAST(NULL AS INT), ' ', 7), (2, 1, CAST(NULL AS INT), 'Other file', 1)) AS t(file_id, node, parent, title, page)"


@query("outline_headings", f"""WITH RECURSIVE b AS (SELECT * FROM {_OUTLINE}),
w AS (SELECT file_id, node, page, title, 1 AS level FROM b WHERE parent IS NULL
  UNION ALL SELECT b.file_id, b.node, b.page, b.title, least(6, w.level + 1) FROM w JOIN b ON b.file_id = w.file_id AND b.parent = w.node)
SELECT file_id, node, page, {tidy_sql('title')} AS title, level FROM w WHERE page > 0 AND {tidy_sql('title')} <> ''""")
def outline_headings(spark: S, sf: str) -> DataFrame:
    return G.outline_headings(X.values(spark, _OUTLINE))
