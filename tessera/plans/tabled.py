"""The scalar operators whose other queries read literal rows, over rows that are made of the given tables.

Each SQL text is that of the query over literal rows with another relation in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import documents as D
from tessera.plans import access as PA
from tessera.plans import documents as PD
from tessera.plans import lookups as L
from tessera.plans import scalars as P
from tessera.plans.registry import SQL, query
from tessera.session import table
from tessera.sources import files as G

S = SparkSession


def _sql(name: str, literal: str, relation: str) -> str:
    if literal not in SQL[name]:
        raise ValueError(f"the SQL of {name} does not read its literal rows")
    return SQL[name].replace(literal, relation)


def _tabled(name: str, like: str, literal: str, relation: str) -> Callable:
    return query(name, _sql(like, literal, relation))


def _pick(words: list[str], at: Column) -> Column:
    return F.array(*[F.lit(w) for w in words])[F.pmod(at, F.lit(len(words))).cast("int")]


def _pick_sql(words: list[str], at: str) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[1 + ({at}) % {len(words)}]"


# ------------------------------------------------------------------ names of pages, labels

_ENDINGS = [*G.SUPPORTED, *G.DENIED, "PDF", "zzz"]
_NAME_SQL = f"regexp_extract(url, '([^/?]*)([?].*)?$', 1) || '.' || {_pick_sql(_ENDINGS, 'page_id')}"
_NAMED = f"(SELECT {_NAME_SQL} FROM pages) AS t(file_name)"


def _names(spark: S, sf: str) -> DataFrame:
    name = F.concat(F.regexp_extract("url", r"([^/?]*)([?].*)?$", 1), F.lit("."), _pick(_ENDINGS, F.col("page_id")))
    return table(spark, sf, "pages").select("page_id", name.alias("file_name"), "url")


@_tabled("display_name_of_pages", "display_name", P._NAMES_SQL, _NAMED)
def display_name_of_pages(spark: S, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_name", T.display_name(F.col("file_name")).alias("shown"))


@_tabled("file_type_validate_of_pages", "file_type_validate", P._NAMES_SQL, _NAMED)
def file_type_validate_of_pages(spark: S, sf: str) -> DataFrame:
    return G.validate(_names(spark, sf)).select("file_name", "extension", "reason", "valid", "label")


@_tabled("file_type_dispatch_of_pages", "file_type_dispatch", P._NAMES_SQL, _NAMED)
def file_type_dispatch_of_pages(spark: S, sf: str) -> DataFrame:
    return _names(spark, sf).select("file_name", G.parser_of(F.col("file_name")).alias("parser"))


@_tabled("safe_object_name_of_pages", "safe_object_name", L._OBJECTS.replace("STRING", "VARCHAR"), "(SELECT CASE WHEN page_id % 9 = 0 THEN NULL ELSE ' ' || url || chr(92) || page_id END FROM pages) AS t(name)")
def safe_object_name_of_pages(spark: S, sf: str) -> DataFrame:
    name = F.when(F.col("page_id") % 9 != 0, F.concat(F.lit(" "), "url", F.lit("\\"), F.col("page_id").cast("string")))
    return table(spark, sf, "pages").select(name.alias("name")).select("name", T.safe_name(F.col("name")).alias("safe"))


_LABELED = f"""(SELECT page_id, {_NAME_SQL}, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_extract(url, '//([^/]*)', 1) END,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(length(html) % 90 + 1 AS INTEGER) END, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN NULL ELSE CAST(length(html) % 90 + 1 + page_id % 2 AS INTEGER) END
  FROM pages) AS t(id, file_name, title_path, page_start, page_end)"""


def _labeled(spark: S, sf: str) -> DataFrame:
    page = F.col("page_id")
    start = (F.length("html") % 90 + 1).cast("int")
    rows = _names(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    title = F.when(page % 3 != 0, F.regexp_extract("url", "//([^/]*)", 1))
    end = F.when((page % 4 != 0) & (page % 5 != 0), (start + page % 2).cast("int"))
    return rows.select(page.alias("id"), "file_name", title.alias("title_path"), F.when(page % 4 != 0, start).alias("page_start"), end.alias("page_end"))


@_tabled("source_label_of_pages", "source_label", P._LABELED_SQL, _LABELED)
def source_label_of_pages(spark: S, sf: str) -> DataFrame:
    c = F.col
    return _labeled(spark, sf).select("id", T.page_label(c("page_start"), c("page_end")).alias("page_label"), T.source_label(c("file_name"), c("title_path"), c("page_start"), c("page_end"), F.lit("正文")).alias("label"))


@_tabled("embedding_text_of_pages", "embedding_text", P._LABELED_SQL, _LABELED)
def embedding_text_of_pages(spark: S, sf: str) -> DataFrame:
    c = F.col
    return _labeled(spark, sf).select("id", T.embedding_text(c("file_name"), c("title_path"), F.lit("正文")).alias("body"), T.rerank_text(c("title_path"), F.lit("正文")).alias("rerank"))


_FOLDERS = ["", "/api/v1/admin", "/api/v1/users/login", "/api/v1/upload", "/api/search/hybrid"]
_VISITS = f"(SELECT page_id, {_pick_sql(_FOLDERS, 'page_id')} || CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '//[^/]*(/[^?]*)', 1) ELSE '' END, CASE page_id % 3 WHEN 1 THEN 'USER' WHEN 2 THEN 'ADMIN' END FROM pages) AS t(id, path, role)"


@_tabled("endpoint_roles_of_pages", "endpoint_roles", PA._CALLS.replace("STRING", "VARCHAR"), _VISITS)
def endpoint_roles_of_pages(spark: S, sf: str) -> DataFrame:
    page = F.col("page_id")
    path = F.concat(_pick(_FOLDERS, page), F.when(page % 2 == 0, F.regexp_extract("url", "//[^/]*(/[^?]*)", 1)).otherwise(""))
    role = F.when(page % 3 == 1, "USER").when(page % 3 == 2, "ADMIN")
    rows = table(spark, sf, "pages").select(page.alias("id"), path.alias("path"), role.alias("role"))
    return rows.select("id", A.endpoint_allowed(F.col("path"), F.col("role")).alias("allowed"))


# ------------------------------------------------------------------ lines of documents

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL"
_NUMBERS = ["", "1. ", "2.3 ", "第一章 ", "一、", "第三条 ", "第二节 "]
_FIELDS = ["", " 申请单", " 姓名 部门 日期 事由 主管", " 姓名 部门 审核 年 月 日", " 姓名 部门 审核"]


def _lines(spark: S, sf: str) -> DataFrame:
    parts = F.split("text", "\n")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "line"))


@_tabled("heading_detect_in_lines", "heading_detect", P._HEADINGS, f"(SELECT {_pick_sql(_NUMBERS, 'doc_id + k')} || line FROM ({_LINES})) AS t(line)")
def heading_detect_in_lines(spark: S, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select(F.concat(_pick(_NUMBERS, F.col("doc_id") + F.col("k")), F.col("line")).alias("line"))
    found = T.heading(F.col("line"))
    return rows.select("line", found["level"].alias("level"), found["confidence"].alias("confidence"))


@_tabled("form_template_in_lines", "form_template", P._FORMS, f"(SELECT doc_id * 1000000 + k, line || {_pick_sql(_FIELDS, 'doc_id + k')} FROM ({_LINES})) AS t(id, body)")
def form_template_in_lines(spark: S, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("id"), F.concat("line", _pick(_FIELDS, F.col("doc_id") + F.col("k"))).alias("body"))
    return rows.select("id", T.is_form_template(F.col("body")).alias("is_form"), T.is_form_scaffold(F.col("body")).alias("is_scaffold"))


@_tabled("heading_level_of_lines", "heading_level_of_locator", P._LOCATORS.replace("STRING", "VARCHAR"), f"(SELECT 'page:' || doc_id || CASE WHEN k % 3 = 0 THEN '' ELSE ';heading:' || k END FROM ({_LINES})) AS t(locator)")
def heading_level_of_lines(spark: S, sf: str) -> DataFrame:
    mark = F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(";heading:"), F.col("k").cast("string")))
    rows = _lines(spark, sf).select(F.concat(F.lit("page:"), F.col("doc_id").cast("string"), mark).alias("locator"))
    return rows.select("locator", T.heading_level_of(F.col("locator")).alias("level"))


@_tabled("page_counters_in_lines", "page_counters", PD._COUNTERS, f"(SELECT CASE WHEN k % 4 = 0 THEN (k + 1) || ' / ' || n ELSE line END FROM ({_LINES})) AS t(line)")
def page_counters_in_lines(spark: S, sf: str) -> DataFrame:
    counter = F.concat((F.col("k") + 1).cast("string"), F.lit(" / "), F.col("n").cast("string"))
    rows = _lines(spark, sf).select(F.when(F.col("k") % 4 == 0, counter).otherwise(F.col("line")).alias("line"))
    return rows.withColumn("counter", T.is_page_counter(F.col("line")))


_CONTENTS = """(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Contents|' ELSE '' END || array_to_string(list_transform(string_split(text, chr(10)), lambda x: x || CASE WHEN length(x) % 3 = 0 THEN ' ......... 3' ELSE '' END), '|')
  FROM documents WHERE text IS NOT NULL) AS t(id, body)"""


@_tabled("toc_pages_of_documents", "toc_pages", PD._TOC, _CONTENTS)
def toc_pages_of_documents(spark: S, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.when(F.length(x) % 3 == 0, " ......... 3").otherwise("")))
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, "Contents|").otherwise(""), F.array_join(lines, "|"))
    rows = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), body.alias("body"))
    return rows.select("id", D.is_contents_page(F.translate("body", "|", "\n")).alias("toc"))


# ------------------------------------------------------------------ turns of conversations

_ASKED = ["", "那", "多久", "可以吗"]


@_tabled("strip_citations_of_turns", "strip_citations", P._CITED, "(SELECT conv_id * 1000 + turn, '【来源#' || turn || '】' || coalesce(text, '') || '【S' || conv_id || '】【来源#a】' FROM conversations) AS t(id, body)")
def strip_citations_of_turns(spark: S, sf: str) -> DataFrame:
    turn, conv = (F.col(c).cast("string") for c in ("turn", "conv_id"))
    body = F.concat(F.lit("【来源#"), turn, F.lit("】"), F.coalesce("text", F.lit("")), F.lit("【S"), conv, F.lit("】【来源#a】"))
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"))
    return rows.select("id", T.strip_citations(F.col("body")).alias("body"), T.link_citations(F.col("body")).alias("linked"))


@_tabled("needs_context_of_sentences", "needs_context", P._QUESTIONS, f"(SELECT {_pick_sql(_ASKED, 'conv_id + turn')} || trim(replace(unnest(string_split(text, '.')), chr(10), ' ')) FROM conversations) AS t(question)")
def needs_context_of_sentences(spark: S, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\.")).alias("s"))
    rows = rows.select(F.concat(_pick(_ASKED, F.col("conv_id") + F.col("turn")), F.trim(F.replace("s", F.lit("\n"), F.lit(" ")))).alias("question"))
    return rows.select("question", T.needs_context(F.col("question")).alias("needed"))


_FLAT_SQL = "replace(text, chr(10), ' ')"


@_tabled("unquote_turns", "unquote", P._QUOTED, f"""(SELECT CASE turn % 4 WHEN 0 THEN '"' || {_FLAT_SQL} || '"' WHEN 1 THEN '“' || {_FLAT_SQL} || '”' WHEN 2 THEN '"' || {_FLAT_SQL} ELSE ' ' || {_FLAT_SQL} END FROM conversations WHERE text IS NOT NULL) AS t(q)""")
def unquote_turns(spark: S, sf: str) -> DataFrame:
    flat, turn = F.replace("text", F.lit("\n"), F.lit(" ")), F.col("turn") % 4
    q = F.when(turn == 0, F.concat(F.lit('"'), flat, F.lit('"'))).when(turn == 1, F.concat(F.lit("“"), flat, F.lit("”"))).when(turn == 2, F.concat(F.lit('"'), flat)).otherwise(F.concat(F.lit(" "), flat))
    return table(spark, sf, "conversations").where("text is not null").select(q.alias("q")).select("q", T.unquote(F.col("q")).alias("body"))


@_tabled("sse_content_of_turns", "sse_content", P._FRAMES, """(SELECT conv_id * 1000 + turn, CASE WHEN turn % 3 = 0 THEN CAST(to_json({'choices': [{'message': {'content': text}}]}) AS VARCHAR) ELSE 'data: ' || CAST(to_json({'choices': [{'delta': {'content': text}}]}) AS VARCHAR) END FROM conversations WHERE text IS NOT NULL) AS t(id, frame)""")
def sse_content_of_turns(spark: S, sf: str) -> DataFrame:
    held = F.struct(F.col("text").alias("content"))
    body = lambda name: F.to_json(F.struct(F.array(F.struct(held.alias(name))).alias("choices")))
    frame = F.when(F.col("turn") % 3 == 0, body("message")).otherwise(F.concat(F.lit("data: "), body("delta")))
    rows = table(spark, sf, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), frame.alias("frame"))
    return rows.select("id", F.explode(T.sse_payloads(F.col("frame"))).alias("p")).select("id", T.sse_content(F.col("p")).alias("content"))


# ------------------------------------------------------------------ stamps of events, tables of orders

_STAMPED = "(SELECT substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, ([19, 16, 13, 10])[1 + event_id % 4]) FROM events) AS t(s)"


def _stamps(spark: S, sf: str) -> DataFrame:
    size = F.array(F.lit(19), F.lit(16), F.lit(13), F.lit(10))[(F.col("event_id") % 4).cast("int")]
    return table(spark, sf, "events").select(F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(1), size).alias("s"))


@_tabled("lenient_timestamp_of_events", "lenient_timestamp", P._STAMPS.replace("STRING", "VARCHAR"), _STAMPED)
def lenient_timestamp_of_events(spark: S, sf: str) -> DataFrame:
    return _stamps(spark, sf).select("s", T.lenient_timestamp(F.col("s")).alias("t"))


@_tabled("time_range_of_events", "time_range_filter", P._STAMPS.replace("STRING", "VARCHAR"), _STAMPED)
def time_range_of_events(spark: S, sf: str) -> DataFrame:
    start, end = F.lit("2024-01-02T03:00:00").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    return _stamps(spark, sf).where(T.in_time_range(F.col("s"), start, end))


_CELLS = """(SELECT l_orderkey, l_linenumber, c, CASE c WHEN 0 THEN l_returnflag WHEN 1 THEN ' ' || l_linestatus WHEN 2 THEN CASE WHEN l_quantity > 25 THEN '姓名 部门 审核' ELSE '' END ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), range(0, 4) AS r(c)) AS t(table_id, "row", col, value)"""


def _cells(spark: S, sf: str) -> DataFrame:
    quantity = F.col("l_quantity")
    values = F.array(F.col("l_returnflag"), F.concat(F.lit(" "), F.col("l_linestatus")), F.when(quantity > 25, "姓名 部门 审核").otherwise(""), quantity.cast("long").cast("string"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")])
    return lines.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.posexplode(values).alias("col", "value"))


@_tabled("table_text_of_orders", "table_text", P._CELLS, _CELLS)
def table_text_of_orders(spark: S, sf: str) -> DataFrame:
    return D.table_text(_cells(spark, sf))


_SHAPED = "(SELECT 8 * count(*), count(*) FILTER (l_quantity > 40) + count(*) FILTER (l_returnflag = 'R'), count(DISTINCT l_linenumber) FROM lineitem GROUP BY l_orderkey) AS t(cells, filled, filled_rows)"


@_tabled("blank_template_of_orders", "blank_template", P._SHAPES, _SHAPED)
def blank_template_of_orders(spark: S, sf: str) -> DataFrame:
    filled = F.count(F.when(F.col("l_quantity") > 40, 1)) + F.count(F.when(F.col("l_returnflag") == "R", 1))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((8 * F.count("*")).alias("cells"), filled.alias("filled"), F.count_distinct("l_linenumber").alias("filled_rows"))
    return rows.drop("l_orderkey").withColumn("blank", T.is_blank_template(F.col("cells"), F.col("filled"), F.col("filled_rows")))


@_tabled("error_description_of_events", "error_description", L._ERRORS.replace("STRING", "VARCHAR"), "(SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END FROM events) AS t(id, kind, message)")
def error_description_of_events(spark: S, sf: str) -> DataFrame:
    message = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.error_description(F.col("event_type"), message).alias("told"))
