"""Queries of scalar functions, over the driver's texts and over literal rows that read alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans import roles as X
from tessera.plans.registry import query
from tessera.sources import files as G
from tessera.session import table

S = SparkSession
_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


def tidy_sql(x: str) -> str:
    return _TIDY.format(x=x)


@query("clean_text", f"SELECT doc_id, md5({tidy_sql('text')}) AS digest FROM documents")
def clean_text(spark: S, sf: str) -> DataFrame:
    return X.texts(spark, sf).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("digest"))


@query("token_estimate", f"SELECT doc_id, {X.tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark: S, sf: str) -> DataFrame:
    return X.texts(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("history_token_estimate", r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\p{Han}')) + greatest(1, floor((len(regexp_extract_all(text, '[^\p{Han}\s]')) + 3) / 4)) + 4 AS BIGINT) AS tokens FROM conversations""")
def history_token_estimate(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.history_token_estimate(F.col("text")).alias("tokens"))


_NAMES = "(VALUES ('report.final.PDF'), ('.hidden'), ('noext'), ('a.docx'), ('b.XLS'), ('c.markdown'), ('d.md'), ('e.exe'), ('f.zzz'), ('g.'), (''), ('h.htm'), ('i.csv'), ('j.pptx'), (CAST(NULL AS STRING))) AS t(file_name)"
_NAMES_SQL = _NAMES.replace("STRING", "VARCHAR")


@query("display_name", f"SELECT file_name, regexp_replace(file_name, '^(.+)\\.[^.]*$', '\\1') AS shown FROM {_NAMES_SQL}")
def display_name(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _NAMES).select("file_name", T.display_name(F.col("file_name")).alias("shown"))


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LABELS_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.LABELS.items()) + " ELSE upper(ext) || '文件' END"


@query("file_type_validate", f"""WITH e AS (SELECT file_name, nullif(lower(regexp_extract(coalesce(file_name, ''), '\\.([^.]*)$', 1)), '') AS ext FROM {_NAMES_SQL})
SELECT file_name, ext AS extension, CASE WHEN file_name IS NULL OR trim(file_name) = '' THEN 'empty name' WHEN ext IS NULL THEN 'no extension' WHEN ext IN ({_listed(G.SUPPORTED)}) THEN 'supported' WHEN ext IN ({_listed(G.DENIED)}) THEN 'unsupported' ELSE 'unknown' END AS reason,
  coalesce(ext IN ({_listed(G.SUPPORTED)}), FALSE) AS valid, CASE WHEN ext IS NULL THEN 'unknown' ELSE {_LABELS_SQL} END AS label FROM e""")
def file_type_validate(spark: S, sf: str) -> DataFrame:
    return G.validate(X.values(spark, _NAMES)).select("file_name", "extension", "reason", "valid", "label")


@query("file_type_dispatch", f"""WITH e AS (SELECT file_name, lower(regexp_extract(coalesce(file_name, ''), '\\.([^.]*)$', 1)) AS ext FROM {_NAMES_SQL})
SELECT file_name, CASE WHEN ext IN ('pdf','docx','pptx','csv') THEN ext WHEN ext IN ('xls','xlsx') THEN 'spreadsheet' WHEN ext IN ('md','markdown') THEN 'markdown' WHEN ext IN ('html','htm') THEN 'html' ELSE 'fallback' END AS parser FROM e""")
def file_type_dispatch(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _NAMES).select("file_name", G.parser_of(F.col("file_name")).alias("parser"))


@query("supported_types", f"SELECT ext AS extension, {_LABELS_SQL} AS label FROM (SELECT unnest([{_listed(G.SUPPORTED)}]) AS ext)")
def supported_types(spark: S, sf: str) -> DataFrame:
    return G.supported_types(spark)


_LABELED = "(VALUES (1, 'a.b.pdf', '第一章｜1.1 范围', 3, 5), (2, 'a.pdf', '', 2, 2), (3, 'x.txt', CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT)), (4, CAST(NULL AS STRING), '总则', CAST(NULL AS INT), CAST(NULL AS INT)), (5, 'y.md', ' ', 7, CAST(NULL AS INT))) AS t(id, file_name, title_path, page_start, page_end)"
_LABELED_SQL = _LABELED.replace("STRING", "VARCHAR")
_PAGES_SQL = "CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN '第 ' || page_start || ' 页' ELSE '第 ' || page_start || '-' || page_end || ' 页' END"


@query("source_label", f"""SELECT id, {_PAGES_SQL} AS page_label,
  '《' || coalesce(regexp_replace(file_name, '^(.+)\\.[^.]*$', '\\1'), '未知文件') || '》' || CASE WHEN trim(coalesce(title_path, '')) <> '' THEN '｜' || title_path ELSE '' END
  || CASE WHEN page_start IS NOT NULL THEN '｜' || {_PAGES_SQL} WHEN trim(coalesce(title_path, '')) <> '' THEN '' ELSE '｜原文片段：“正文”' END AS label FROM {_LABELED_SQL}""")
def source_label(spark: S, sf: str) -> DataFrame:
    c = F.col
    return X.values(spark, _LABELED).select("id", T.page_label(c("page_start"), c("page_end")).alias("page_label"), T.source_label(c("file_name"), c("title_path"), c("page_start"), c("page_end"), F.lit("正文")).alias("label"))


@query("embedding_text", f"""SELECT id, concat_ws(chr(10), nullif(regexp_replace(file_name, '^(.+)\\.[^.]*$', '\\1'), ''), nullif(replace(trim(title_path), '｜', '|'), ''), '正文') AS body, concat_ws(chr(10), CASE WHEN trim(title_path) <> '' THEN title_path END, '正文') AS rerank FROM {_LABELED_SQL}""")
def embedding_text(spark: S, sf: str) -> DataFrame:
    c = F.col
    return X.values(spark, _LABELED).select("id", T.embedding_text(c("file_name"), c("title_path"), F.lit("正文")).alias("body"), T.rerank_text(c("title_path"), F.lit("正文")).alias("rerank"))


@query("excerpt", r"SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 240) || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def excerpt(spark: S, sf: str) -> DataFrame:
    return X.texts(spark, sf).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


_CITED = "(VALUES (1, '见【来源#1】及【S2】。'), (2, '无'), (3, '【来源# 12】x【S】【来源#a】')) AS t(id, body)"


@query("strip_citations", f"SELECT id, regexp_replace(body, '【(?:来源#\\s*|S)(\\d+)】', '', 'g') AS body, regexp_replace(body, '【来源#\\s*(\\d+)】', '<a class=\"source\" data-id=\"\\1\">[\\1]</a>', 'g') AS linked FROM {_CITED}")
def strip_citations(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _CITED).select("id", T.strip_citations(F.col("body")).alias("body"), T.link_citations(F.col("body")).alias("linked"))


_HEADINGS = "(VALUES ('第一章 总则'), ('第二节 范围'), ('第三条 规定如下'), ('一、概述'), ('（一）说明'), ('1. Attendance Policy'), ('1.1 适用范围'), ('1.1.1 Deep numbered item'), ('17 / 37'), ('2024 年度'), ('3 apples'), ('4. 5 apples'), ('第四章 结束。'), ('x'), ('(1) Sign offer letter'), ('10、附则 说明'), ('2.3. 条件 A')) AS t(line)"


@query("heading_detect", f"""SELECT line, CASE WHEN NOT fits THEN NULL WHEN mark = '章' THEN 1 WHEN mark = '节' THEN 2 WHEN mark = '条' THEN 3 WHEN chapter THEN 1 WHEN deeper THEN 2 WHEN numeric_ THEN 1 END AS level,
  CASE WHEN NOT fits THEN NULL WHEN mark = '条' THEN 'LOW' WHEN mark IN ('章', '节') OR chapter OR deeper OR numeric_ THEN 'MEDIUM' END AS confidence
FROM (SELECT line, length(line) BETWEEN 2 AND 120 AND NOT regexp_matches(line, '[。！？；;!?]$') AS fits, regexp_extract(line, '^第[一二三四五六七八九十百千万零〇0-9]+([章节条])\\s*.{{1,100}}$', 1) AS mark,
  regexp_matches(line, '^[一二三四五六七八九十]+、\\s*.{{1,100}}$') AS chapter, regexp_matches(line, '^\\d+[.．]\\d+[.．、]?\\s+[^\\s\\d].{{0,100}}$') AS deeper, regexp_matches(line, '^\\d+(?:[.．]\\d+[.．、]?|[.．、])\\s+[^\\s\\d].{{0,100}}$') AS numeric_ FROM {_HEADINGS})""")
def heading_detect(spark: S, sf: str) -> DataFrame:
    found = T.heading(F.col("line"))
    return X.values(spark, _HEADINGS).select("line", found["level"].alias("level"), found["confidence"].alias("confidence"))


_LOCATORS = "(VALUES ('heading:3'), ('slide:4;heading:1'), ('html:p'), ('page:2;heading:2;confidence:LOW'), (CAST(NULL AS STRING))) AS t(locator)"


@query("heading_level_of_locator", f"SELECT locator, CAST(coalesce(nullif(regexp_extract(locator, 'heading:(\\d+)', 1), ''), '1') AS INTEGER) AS level FROM {_LOCATORS.replace('STRING', 'VARCHAR')}")
def heading_level_of_locator(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _LOCATORS).select("locator", T.heading_level_of(F.col("locator")).alias("level"))


_QUESTIONS = "(VALUES ('那需要提前几天？'), ('请假制度是什么'), ('可以吗'), ('公司年假有多少天的规定在哪里'), (''), ('它的流程'), ('多久')) AS t(question)"


@query("needs_context", f"""SELECT question, length(question) > 0 AND length(question) <= 50 AND (regexp_matches(question, '({'|'.join(T.CONTEXT_WORDS)})') OR (length(question) <= 12 AND regexp_matches(question, '({'|'.join(T.ELLIPSIS_WORDS)})'))) AS needed FROM {_QUESTIONS}""")
def needs_context(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _QUESTIONS).select("question", T.needs_context(F.col("question")).alias("needed"))


_FORMS = "(VALUES (1, '出差申请单'), (2, '姓名 部门 日期 事由 主管'), (3, '姓名 部门 审核 年 月 日'), (4, '姓名 部门 审核'), (5, '金额 期限'), (6, '填表 姓名 部门')) AS t(id, body)"
_FIELD_COUNT = " + ".join(f"CAST(contains(body, '{w}') AS INT)" for w in T.FIELD_WORDS)
_FORM_ANY = " OR ".join(f"contains(body, '{w}')" for w in T.FORM_WORDS)


@query("form_template", f"""SELECT id, ({_FORM_ANY}) OR ({_FIELD_COUNT}) >= 5 OR (({_FIELD_COUNT}) >= 3 AND regexp_matches(body, '(年\\s*)?月\\s*日')) AS is_form,
  length(body) <= 100 AND (({_FORM_ANY}) OR (({_FIELD_COUNT}) >= 3 AND regexp_matches(body, '{'|'.join(T.SIGNATURE_WORDS)}'))) AS is_scaffold FROM {_FORMS}""")
def form_template(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _FORMS).select("id", T.is_form_template(F.col("body")).alias("is_form"), T.is_form_scaffold(F.col("body")).alias("is_scaffold"))


_CELLS = "(VALUES (1, 0, 0, '部门'), (1, 0, 1, '人数'), (1, 1, 0, ' HR '), (1, 1, 1, '3'), (1, 2, 0, ''), (1, 2, 1, ''), (2, 0, 0, '姓名'), (2, 0, 1, '部门'), (2, 1, 0, '日期'), (2, 1, 1, '审核'), (2, 2, 0, '签字'), (2, 2, 1, '')) AS t(table_id, \"row\", col, value)"


@query("table_text", f"""WITH c AS (SELECT table_id, "row", col, trim(value) AS v FROM {_CELLS}),
r AS (SELECT table_id, "row", string_agg(v, ' | ' ORDER BY col) FILTER (v <> '') AS line, count(*) AS n, count(*) FILTER (v <> '') AS f FROM c GROUP BY ALL),
t AS (SELECT table_id, string_agg(line, chr(10) ORDER BY "row") FILTER (f > 0) AS body, sum(n) AS n, sum(f) AS f, count(*) FILTER (f > 0) AS rows FROM r GROUP BY 1)
SELECT table_id, CASE WHEN (n >= 20 AND rows >= 5 AND f / n < 0.3) OR ({_FORM_ANY}) OR ({_FIELD_COUNT}) >= 5 OR (({_FIELD_COUNT}) >= 3 AND regexp_matches(body, '(年\\s*)?月\\s*日')) THEN '' ELSE body END AS text FROM t""")
def table_text(spark: S, sf: str) -> DataFrame:
    return D.table_text(X.values(spark, _CELLS.replace('"row"', "`row`")))


_SHAPES = "(VALUES (20, 5, 5), (24, 7, 4), (24, 8, 6), (100, 29, 9), (100, 30, 9), (19, 1, 5)) AS t(cells, filled, filled_rows)"


@query("blank_template", f"SELECT cells, filled, filled_rows, cells >= 20 AND filled_rows >= 5 AND filled / cells < 0.3 AS blank FROM {_SHAPES}")
def blank_template(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _SHAPES).withColumn("blank", T.is_blank_template(F.col("cells"), F.col("filled"), F.col("filled_rows")))


@query("content_hash", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substr(sha256('scifact:' || doc_id), 1, 32) AS file_key FROM documents")
def content_hash(spark: S, sf: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    key = F.substring(F.sha2(F.concat(F.lit("scifact:"), F.col("doc_id").cast("string")), 256), 1, 32)
    return X.texts(spark, sf).select("doc_id", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"), key.alias("file_key"))


@query("duplicate_owner_md5", f"WITH {X.FILES} SELECT owner_id, md5, count(*) AS n FROM files GROUP BY ALL HAVING count(*) > 1")
def duplicate_owner_md5(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).groupBy("owner_id", "md5").agg(F.count("*").alias("n")).where("n > 1")


@query("files_by_md5", f"WITH {X.FILES} SELECT md5, count(*) AS files, min(file_id) AS first_file FROM files GROUP BY md5")
def files_by_md5(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).groupBy("md5").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"))


@query("human_size", f"WITH {X.FILES}, s AS (SELECT file_id, size * size AS size FROM files) SELECT file_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{{:.1f}} KB', round(size / 1024.0, 1)) WHEN size < 1073741824 THEN format('{{:.1f}} MB', size / 1048576.0) ELSE format('{{:.1f}} GB', round(size / 1073741824.0, 1)) END AS shown FROM s")
def human_size(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).select("file_id", T.human_size(F.col("size") * F.col("size")).alias("shown"))


_QUOTED = "(VALUES ('\"a b\"'), ('“c”'), ('d'), ('\"e'), (' \"f\" ')) AS t(q)"


@query("unquote", f"SELECT q, CASE WHEN regexp_matches(trim(q), '^(\".*\"|“.*”)$') AND length(trim(q)) >= 2 THEN trim(substr(trim(q), 2, length(trim(q)) - 2)) ELSE trim(q) END AS body FROM {_QUOTED}")
def unquote(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _QUOTED).select("q", T.unquote(F.col("q")).alias("body"))


_SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')"


@query("sentences", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentences(spark: S, sf: str) -> DataFrame:
    parts = T.sentences(F.col("text"))
    return X.texts(spark, sf).select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|").cast("binary")).alias("digest"))


_STAMPS = "(VALUES ('2024-01-02T03:04:05'), ('2024-01-02T03:04'), ('2024-01-02T03'), ('2024-01-02'), ('未知时间'), ('2024/01/02'), (CAST(NULL AS STRING))) AS t(s)"


@query("lenient_timestamp", f"""SELECT s, CASE WHEN length(s) IN (19, 16, 13, 10) AND regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d') THEN CAST(rpad(replace(s, 'T', ' '), 19, substr('0000-00-00 00:00:00', length(s) + 1)) AS TIMESTAMP) END AS t FROM {_STAMPS.replace('STRING', 'VARCHAR')}""")
def lenient_timestamp(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _STAMPS).select("s", T.lenient_timestamp(F.col("s")).alias("t"))


@query("time_range_filter", f"SELECT s FROM {_STAMPS.replace('STRING', 'VARCHAR')} WHERE s IS NULL OR (s <> '未知时间' AND (NOT regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d') OR substr(rpad(s, 19, '0'), 1, 13) >= '2024-01-02T03'))")
def time_range_filter(spark: S, sf: str) -> DataFrame:
    """Open at the end; texts that are no stamps pass, and so does a missing stamp."""
    start, end = F.lit("2024-01-02T03:00:00").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    return X.values(spark, _STAMPS).where(T.in_time_range(F.col("s"), start, end))


@query("tag_list_membership", f"WITH {X.USERS} SELECT user_id, list_contains(string_split(org_tags, ','), 'NATION_6') AS member, CAST(len(string_split(org_tags, ',')) AS INTEGER) AS n FROM users")
def tag_list_membership(spark: S, sf: str) -> DataFrame:
    held = A.split_tags(F.col("org_tags"))
    return X.users(spark, sf).select("user_id", F.array_contains(held, "NATION_6").alias("member"), F.size(held).alias("n"))


@query("event_props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("conversation_json", "SELECT conv_id, CAST(sum(length(to_json({'role': role, 'text': text}))) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def conversation_json(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length(F.to_json(F.struct("role", "text")))).alias("bytes"))


@query("highlight", "SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def highlight(spark: S, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return E.holders(X.chunks(spark, sf), items).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"))


@query("preview", "SELECT doc_id, CASE WHEN strlen(text) <= 10240 THEN 'whole' ELSE 'cut' END AS kind, CAST(least(strlen(text), 10240) AS BIGINT) AS bytes FROM documents")
def preview(spark: S, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return X.texts(spark, sf).select("doc_id", F.when(size <= 10240, "whole").otherwise("cut").alias("kind"), F.least(size, F.lit(10240)).cast("long").alias("bytes"))


@query("dcg_discount", "SELECT CAST(r AS INTEGER) AS rank, round(1 / log2(r + 1), 9) AS gain FROM range(1, 21) t(r)")
def dcg_discount(spark: S, sf: str) -> DataFrame:
    return spark.range(1, 21).select(F.col("id").cast("int").alias("rank"), F.round(1 / F.log2(F.col("id") + 1), 9).alias("gain"))


@query("cjk_bigrams")
def cjk_bigrams(spark: S, sf: str) -> DataFrame:
    rows = X.values(spark, "(VALUES (1, '公司请假制度 HR 流程'), (2, '年假'), (3, 'plain words')) AS t(id, body)")
    return rows.select("id", R.cjk_bigrams(R.analyze(F.col("body"))).alias("tokens"))


_FRAMES = "(VALUES (1, 'data: {\"choices\":[{\"delta\":{\"content\":\"你好\"}}]}'), (2, 'data: [DONE]'), (3, '{\"choices\":[{\"message\":{\"content\":\"plain\"}}]}'), (4, 'event: x'), (5, 'data: {\"choices\":[{\"delta\":{\"role\":\"assistant\"}}]}')) AS t(id, frame)"


@query("sse_content", f"""SELECT id, coalesce(json_extract_string(p, '$.choices[0].delta.content'), json_extract_string(p, '$.choices[0].message.content')) AS content
FROM (SELECT id, CASE WHEN starts_with(frame, 'data:') THEN trim(substr(frame, 6)) ELSE frame END AS p FROM {_FRAMES}) WHERE p <> '[DONE]' AND NOT regexp_matches(p, '^(event|id|retry):')""")
def sse_content(spark: S, sf: str) -> DataFrame:
    rows = X.values(spark, _FRAMES).select("id", F.explode(T.sse_payloads(F.col("frame"))).alias("p"))
    return rows.select("id", T.sse_content(F.col("p")).alias("content"))
