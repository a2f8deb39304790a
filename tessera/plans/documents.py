"""Queries of line rules, sections, chunks, parsers, conversations, uploads and the pipeline's event rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import conversation as C
from tessera.operators import documents as D
from tessera.operators import uploads as U
from tessera.operators import versions as V
from tessera.plans import roles as X
from tessera.plans.registry import query
from tessera.sources import files as G
from tessera.session import shared_path, spread, table

S = SparkSession

# ------------------------------------------------------------------ lines and pages

#: Pages made from documents: five lines each, under a running head that is the same on most pages of a document.
_PAGES_SQL = f"""{X.LINES},
body AS (SELECT doc_id, (ordinal - 1) // 5 + 1 AS page, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM lines GROUP BY ALL),
pages AS (SELECT doc_id, page, 'Doc ' || doc_id || chr(10) || t || chr(10) || CASE WHEN page % 4 = 0 THEN 'rare ' || page ELSE 'foot' END AS text FROM body)"""


def _pages(spark: S, sf: str) -> DataFrame:
    rows = X.lines(spark, sf).withColumn("page", F.floor((F.col("ordinal") - 1) / 5) + 1)
    body = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("t"))
    foot = F.when(F.col("page") % 4 == 0, F.concat(F.lit("rare "), F.col("page").cast("string"))).otherwise("foot")
    return body.select("doc_id", "page", F.concat_ws("\n", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), "t", foot).alias("text"))


def _tidy(x: str) -> str:
    from tessera.plans.scalars import tidy_sql

    return tidy_sql(x)


@query("page_chrome_removed", f"""WITH {_PAGES_SQL},
cut AS (SELECT doc_id, page, string_split({_tidy('text')}, chr(10)) AS l FROM pages),
cand AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN [l[1], l[-1]] ELSE [l[1]] END) AS line FROM cut),
n AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(*) AS n FROM cand WHERE line <> '' AND length(line) <= 120 GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS pages FROM pages GROUP BY 1) USING (doc_id) WHERE n >= greatest(3, ceil(pages * 0.6))),
ex AS (SELECT doc_id, page, unnest(l) AS line, unnest(range(len(l))) AS pos FROM cut)
SELECT p.doc_id, p.page, md5(coalesce(t, '')) AS digest FROM pages p LEFT JOIN (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS t FROM ex ANTI JOIN n USING (doc_id, line) GROUP BY ALL) USING (doc_id, page)""")
def page_chrome_removed(spark: S, sf: str) -> DataFrame:
    return D.without_page_chrome(_pages(spark, sf)).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("needs_ocr", f"WITH {X.LINES}, p AS (SELECT doc_id, ordinal AS page, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 3) ELSE text END AS text FROM lines) SELECT doc_id, count(*) AS pages, CAST(sum(length({_tidy('text')})) AS BIGINT) AS chars, sum(length({_tidy('text')})) < 10 * count(*) AS needs_ocr FROM p GROUP BY 1")
def needs_ocr(spark: S, sf: str) -> DataFrame:
    pages = X.lines(spark, sf).select("doc_id", F.col("ordinal").alias("page"), F.when(F.col("doc_id") % 7 == 0, F.substring("text", 1, 3)).otherwise(F.col("text")).alias("text"))
    return D.needs_ocr(pages)


_TOC = "(VALUES (1, '目 录|第一章 ......... 1|第二章 ......... 3'), (2, 'Contents|one ......... 1'), (3, 'a ...... 1|b ...... 2|c ...... 3'), (4, 'plain|text ... here')) AS t(id, body)"


@query("toc_pages", f"""WITH r AS (SELECT id, unnest(string_split(body, '|')) AS line FROM {_TOC}),
c AS (SELECT id, count(*) FILTER (regexp_matches(line, '([.．·…]\\s*){{6,}}')) AS n, bool_or(regexp_matches(line, '(?i)^(目\\s*录|contents?)$')) AS head FROM r GROUP BY 1)
SELECT id, n >= 3 OR (head AND n >= 2) AS toc FROM c""")
def toc_pages(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _TOC).select("id", D.is_contents_page(F.translate("body", "|", "\n")).alias("toc"))


_COUNTERS = "(VALUES ('17 / 37'), ('第 3 / 9 页'), ('3/9'), ('page 3'), ('3 / x')) AS t(line)"


@query("page_counters", f"SELECT line, regexp_matches(line, '^\\s*(第\\s*)?\\d+\\s*[/／]\\s*\\d+\\s*(页)?\\s*$') AS counter FROM {_COUNTERS}")
def page_counters(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _COUNTERS).withColumn("counter", T.is_page_counter(F.col("line")))


@query("csv_element", f"SELECT doc_id, 'TABLE' AS type, 'csv' AS locator, CAST(length({_tidy('text')}) AS INTEGER) AS chars FROM documents WHERE {_tidy('text')} <> ''")
def csv_element(spark: S, sf: str) -> DataFrame:
    body = T.clean(F.col("text"))
    rows = X.texts(spark, sf).select("doc_id", F.lit("TABLE").alias("type"), F.lit("csv").alias("locator"), F.length(body).alias("chars"))
    return rows.where("chars > 0")


@query("paragraphs", f"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n{{2,}}')) AS t FROM documents) SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(trim(t, ' ' || chr(10)))) AS BIGINT) AS chars FROM p WHERE trim(t, ' ' || chr(10)) <> '' GROUP BY 1")
def paragraphs(spark: S, sf: str) -> DataFrame:
    """Blank-line paragraphs, where a full stop at a line end stands for the blank line."""
    spread = F.regexp_replace("text", "\\.\n", ".\n\n")
    rows = X.texts(spark, sf).select("doc_id", F.explode(F.split(spread, "\n{2,}")).alias("t")).withColumn("t", F.regexp_replace("t", "^[ \n]+|[ \n]+$", ""))
    return rows.where("t <> ''").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("t")).alias("chars"))


@query("markdown_lines", f"""WITH m AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 5 = 1 THEN '## ' || text WHEN ordinal % 5 = 2 THEN '- ' || text ELSE text END AS line FROM (SELECT * FROM ({'WITH ' + X.LINES + ' SELECT * FROM lines'})))
SELECT doc_id, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN 'TITLE' WHEN regexp_matches(line, '^([-*+]|\\d+[.)])\\s+') THEN 'LIST' ELSE 'TEXT' END AS type, count(*) AS n FROM m GROUP BY ALL""")
def markdown_lines(spark: S, sf: str) -> DataFrame:
    line = F.when(F.col("ordinal") % 5 == 1, F.concat(F.lit("## "), "text")).when(F.col("ordinal") % 5 == 2, F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    kind = F.when(F.col("line").rlike(r"^#{1,6}\s+"), "TITLE").when(F.col("line").rlike(r"^([-*+]|\d+[.)])\s+"), "LIST").otherwise("TEXT")
    return X.lines(spark, sf).withColumn("line", line).groupBy("doc_id", kind.alias("type")).agg(F.count("*").alias("n"))


@query("html_elements")
def html_elements(spark: S, sf: str) -> DataFrame:
    pages = spread(table(spark, sf, "pages"), "page_id").select(F.col("page_id").alias("doc_id"), F.lit("page.html").alias("file_name"), F.col("html").cast("binary").alias("content"))
    return G.parse_files(pages).select("doc_id", F.inline("elements")).select("doc_id", "ordinal", "type", "locator", "heading_level", "text")


@query("html_by_type", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS titles FROM pages")
def html_by_type(spark: S, sf: str) -> DataFrame:
    rows = html_elements(spark, sf)
    found = rows.groupBy(F.col("doc_id").alias("page_id")).agg(F.sum((F.col("type") == "TITLE").cast("long")).alias("titles"))
    return table(spark, sf, "pages").select("page_id").join(found, "page_id", "left").na.fill(0)


@query("markdown_elements")
def markdown_elements(spark: S, sf: str) -> DataFrame:
    body = F.concat_ws("\n", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).when(i % 5 == 1, F.concat(F.lit("- "), x)).otherwise(x)), "\n"))
    rows = X.texts(spark, sf).select("doc_id", F.lit("a.md").alias("file_name"), body.cast("binary").alias("content"))
    return G.parse_files(rows).select("doc_id", F.inline("elements")).select("doc_id", "ordinal", "type", "locator", "text")


# ------------------------------------------------------------------ sections and chunks

_ELEMENTS_SQL = f"""{X.LINES},
el AS (SELECT doc_id, ordinal, text, CASE WHEN ordinal % 5 = 1 THEN 'TITLE' ELSE 'NARRATIVE' END AS type, CASE WHEN ordinal % 5 = 1 THEN CASE WHEN ordinal % 10 = 1 THEN 1 ELSE 2 END END AS lvl,
  CASE WHEN ordinal % 5 = 1 THEN CASE WHEN ordinal % 35 = 1 THEN 'LOW' ELSE 'HIGH' END END AS conf FROM lines),
marked AS (SELECT *, type = 'TITLE' AND coalesce(conf, '') NOT IN ('LOW', 'REJECTED') AND lvl <= 2 AS title FROM el),
run AS (SELECT *, sum(title::INT) OVER w AS section, last_value(CASE WHEN title AND lvl = 1 THEN {_tidy('text')} END IGNORE NULLS) OVER w AS one, last_value(CASE WHEN title AND lvl = 1 THEN ordinal END IGNORE NULLS) OVER w AS one_at,
  last_value(CASE WHEN title AND lvl = 2 THEN {_tidy('text')} END IGNORE NULLS) OVER w AS two, last_value(CASE WHEN title AND lvl = 2 THEN ordinal END IGNORE NULLS) OVER w AS two_at FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
body AS (SELECT doc_id, CAST(section AS BIGINT) AS section, ordinal, text, nullif(concat_ws('｜', one, CASE WHEN one_at IS NULL OR two_at > one_at THEN two END), '') AS title_path FROM run WHERE NOT title)"""


def _elements(spark: S, sf: str) -> DataFrame:
    """Every fifth line is a title, levels 1 and 2 in turn; every seventh of those is of low confidence."""
    title = F.col("ordinal") % 5 == 1
    return X.lines(spark, sf).select(
        "doc_id", "ordinal", "text",
        F.when(title, "TITLE").otherwise("NARRATIVE").alias("type"),
        F.when(title, F.when(F.col("ordinal") % 10 == 1, 1).otherwise(2)).alias("heading_level"),
        F.when(title, F.when(F.col("ordinal") % 35 == 1, "LOW").otherwise("HIGH")).alias("heading_confidence"),
        F.lit(None).cast("string").alias("locator"), F.lit(None).cast("int").alias("page"),
    )


@query("title_path", f"WITH {_ELEMENTS_SQL} SELECT doc_id, section, ordinal, title_path FROM body")
def title_path(spark: S, sf: str) -> DataFrame:
    return D.section_rows(_elements(spark, sf)).select("doc_id", "section", "ordinal", "title_path")


@query("heading_sections", f"WITH {_ELEMENTS_SQL} SELECT doc_id, section, max(title_path) AS title_path, count(*) AS elements, CAST(sum({X.tokens_sql('text')}) AS BIGINT) AS tokens FROM body GROUP BY ALL")
def heading_sections(spark: S, sf: str) -> DataFrame:
    return D.sections(D.section_rows(_elements(spark, sf))).drop("page_start", "page_end")


def _files_with_elements(spark: S, sf: str, titled: bool) -> DataFrame:
    rows = _elements(spark, sf)
    if not titled:
        rows = rows.withColumns({"type": F.lit("NARRATIVE"), "heading_level": F.lit(None).cast("int"), "heading_confidence": F.lit(None).cast("string"), "page": F.when(F.col("doc_id") % 2 == 0, F.floor((F.col("ordinal") - 1) / 8).cast("int") + 1)})
    item = F.struct("type", "text", "page", F.coalesce("locator", F.concat(F.lit("line:"), F.col("ordinal").cast("string"))).alias("locator"), F.col("ordinal").cast("int").alias("ordinal"), "heading_level", "heading_confidence")
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("e")))).alias("_l"))
    return grouped.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.transform("_l", lambda x: x["e"]).alias("elements"))


@query("chunks")
def chunks(spark: S, sf: str) -> DataFrame:
    return D.chunk_documents(_files_with_elements(spark, sf, True))


@query("fallback_sections")
def fallback_sections(spark: S, sf: str) -> DataFrame:
    """Chunks of documents without titles: sections by page (even ids) or by size (odd ids)."""
    return D.chunk_documents(_files_with_elements(spark, sf, False))


@query("parse_quality")
def parse_quality(spark: S, sf: str) -> DataFrame:
    files = _files_with_elements(spark, sf, True)
    return D.parse_quality(files, D.chunk_documents(files))


@query("section_page_range", f"WITH {X.LINES} SELECT doc_id, (ordinal - 1) // 20 AS section, min((ordinal - 1) // 8 + 1) AS page_start, max((ordinal - 1) // 8 + 1) AS page_end FROM lines GROUP BY ALL")
def section_page_range(spark: S, sf: str) -> DataFrame:
    rows = X.lines(spark, sf).select("doc_id", F.floor((F.col("ordinal") - 1) / 20).alias("section"), (F.floor((F.col("ordinal") - 1) / 8) + 1).alias("page"))
    return rows.groupBy("doc_id", "section").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


@query("locator_join", f"WITH {X.LINES}, g AS (SELECT doc_id, ordinal, 'p:' || ((ordinal - 1) // 3) AS locator FROM lines) SELECT doc_id, string_agg(locator, ',' ORDER BY f) AS locators FROM (SELECT doc_id, locator, min(ordinal) AS f FROM g GROUP BY ALL) GROUP BY doc_id")
def locator_join(spark: S, sf: str) -> DataFrame:
    rows = X.lines(spark, sf).withColumn("locator", F.concat(F.lit("p:"), F.floor((F.col("ordinal") - 1) / 3).cast("string")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "locator"))), lambda x: x["locator"])
    return rows.groupBy("doc_id").agg(F.array_join(F.array_distinct(listed), ",").alias("locators"))


# ------------------------------------------------------------------ conversations

_STRIPPED = "trim(regexp_replace(text, '【(?:来源#\\s*|S)(\\d+)】', '', 'g'), ' ' || chr(10))"
_VALID = f"valid AS (SELECT conv_id, turn, role, {_STRIPPED} AS content FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND {_STRIPPED} <> '')"
_COST = "CAST(len(regexp_extract_all(content, '\\p{Han}')) + greatest(1, floor((len(regexp_extract_all(content, '[^\\p{Han}\\s]')) + 3) / 4)) + 4 AS BIGINT)"


@query("history_answer_budget", f"WITH {_VALID}, r AS (SELECT *, {_COST} AS tokens, CAST(sum({_COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM valid) SELECT * FROM r WHERE used <= 300")
def history_answer_budget(spark: S, sf: str) -> DataFrame:
    return C.history_for_answer(table(spark, sf, "conversations"), 300)


@query("history_rewrite_window", f"WITH {_VALID.replace('FROM conversations', 'FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)')} SELECT * FROM valid")
def history_rewrite_window(spark: S, sf: str) -> DataFrame:
    return C.history_for_rewrite(table(spark, sf, "conversations"), 2)


@query("history_keep_last", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_keep_last(spark: S, sf: str) -> DataFrame:
    return C.keep_last(table(spark, sf, "conversations"), 3).select("conv_id", "turn", "role")


@query("history_append_turn", "WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'q' || conv_id FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1 UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'a' || conv_id FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1) SELECT conv_id, turn, role, md5(text) AS digest FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def history_append_turn(spark: S, sf: str) -> DataFrame:
    messages = table(spark, sf, "conversations")
    key = F.col("conv_id").cast("string")
    turns = messages.where("conv_id % 3 = 0").select("conv_id").distinct().select("conv_id", F.concat(F.lit("q"), key).alias("question"), F.concat(F.lit("a"), key).alias("answer"))
    return C.append_turn(messages, turns, 4).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("session_titles", r"SELECT conv_id, CASE WHEN t = '' THEN '新对话' WHEN length(t) <= 28 THEN t ELSE substr(t, 1, 28) || '…' END AS title FROM (SELECT conv_id, trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), '\s+', ' ', 'g')) AS t FROM conversations GROUP BY 1)")
def session_titles(spark: S, sf: str) -> DataFrame:
    return C.session_titles(table(spark, sf, "conversations"))


@query("recent_sessions", "SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY 1 ORDER BY turns DESC, conv_id DESC LIMIT 100")
def recent_sessions(spark: S, sf: str) -> DataFrame:
    """The newest hundred sessions."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).orderBy(F.desc("turns"), F.desc("conv_id")).limit(100)


@query("conversation_range", "SELECT event_id, user_id, ts FROM events WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def conversation_range(spark: S, sf: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf, "events").where((F.col("user_id") == 7) & F.col("ts").between(day("2024-01-05"), day("2024-01-20"))).select("event_id", "user_id", "ts")


@query("state_ttl", "SELECT user_id, count(*) AS live FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def state_ttl(spark: S, sf: str) -> DataFrame:
    """Rows of the last seven days before the newest one."""
    rows = table(spark, sf, "events")
    newest = rows.agg(F.max("ts").alias("_now"))
    return U.live(rows.crossJoin(F.broadcast(newest)), "ts", F.col("_now"), 7 * 24 * 3600).groupBy("user_id").agg(F.count("*").alias("live"))


@query("prompt_messages")
def prompt_messages(spark: S, sf: str) -> DataFrame:
    messages = table(spark, sf, "conversations")
    asked = messages.select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), "conv_id", F.lit("sources").alias("prompt"), F.lit("question").alias("question"))
    return C.messages_of("rules", C.history_for_rewrite(messages), asked)


# ------------------------------------------------------------------ uploads

_PLAN_SQL = """sized AS (SELECT doc_id AS file_id, CAST(length(text) AS BIGINT) * 40000 + 1 AS total_size, CASE WHEN doc_id % 3 = 0 THEN 1048576 WHEN doc_id % 3 = 1 THEN 33554432 END AS requested FROM documents),
a AS (SELECT *, CAST(greatest(greatest(5242880, least(5368709120, coalesce(requested, 16777216))), ceil(total_size / 10485760000.0) * 1048576) AS BIGINT) AS part_size FROM sized),
plan AS (SELECT file_id, total_size, part_size, CAST(ceil(total_size / part_size) AS BIGINT) AS parts, total_size - (CAST(ceil(total_size / part_size) AS BIGINT) - 1) * part_size AS last_part FROM a)"""


def _plan(spark: S, sf: str) -> DataFrame:
    wanted = F.when(F.col("doc_id") % 3 == 0, F.lit(1048576)).when(F.col("doc_id") % 3 == 1, F.lit(33554432)).cast("long")
    return U.part_plan(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), (F.length("text").cast("long") * 40000 + 1).alias("total_size"), wanted.alias("requested")))


@query("part_plan", f"WITH {_PLAN_SQL} SELECT * FROM plan")
def part_plan(spark: S, sf: str) -> DataFrame:
    return _plan(spark, sf)


_PARTS_SQL = f"""{_PLAN_SQL},
parts_ AS (SELECT file_id, part_number, CASE WHEN part_number = parts THEN last_part WHEN (file_id + part_number) % 41 = 0 THEN part_size - 1 ELSE part_size END AS size
  FROM (SELECT *, unnest(range(1, parts + 1)) AS part_number FROM plan) WHERE (file_id * 7 + part_number) % 23 <> 0)"""


def _parts(spark: S, sf: str) -> DataFrame:
    rows = _plan(spark, sf).withColumn("part_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))
    size = F.when(F.col("part_number") == F.col("parts"), F.col("last_part")).when((F.col("file_id") + F.col("part_number")) % 41 == 0, F.col("part_size") - 1).otherwise(F.col("part_size"))
    return rows.where((F.col("file_id") * 7 + F.col("part_number")) % 23 != 0).select("file_id", "part_number", size.alias("size"))


@query("part_validate", f"""WITH {_PARTS_SQL},
n AS (SELECT p.*, pl.part_size, pl.parts, pl.last_part, row_number() OVER (PARTITION BY p.file_id ORDER BY part_number) AS rn FROM parts_ p JOIN plan pl USING (file_id)),
g AS (SELECT file_id, count(*) AS uploaded, CAST(sum(size) AS BIGINT) AS bytes, min(rn) FILTER (rn <> part_number) AS gap, CAST(count(*) FILTER (size <> CASE WHEN part_number = parts THEN last_part ELSE part_size END) AS BIGINT) AS wrong_sizes FROM n GROUP BY 1),
j AS (SELECT pl.*, coalesce(uploaded, 0) AS uploaded, coalesce(bytes, 0) AS bytes, coalesce(wrong_sizes, 0) AS wrong_sizes, coalesce(gap, CASE WHEN coalesce(uploaded, 0) < parts THEN coalesce(uploaded, 0) + 1 END) AS first_missing FROM plan pl LEFT JOIN g USING (file_id))
SELECT file_id, uploaded, bytes, round(uploaded * 100.0::DOUBLE / parts, 2) AS progress, first_missing, wrong_sizes, first_missing IS NULL AND wrong_sizes = 0 AND bytes = total_size AS complete FROM j""")
def part_validate(spark: S, sf: str) -> DataFrame:
    return U.part_check(_plan(spark, sf), _parts(spark, sf))


@query("missing_parts", f"WITH {_PARTS_SQL} SELECT file_id, part_number FROM (SELECT file_id, unnest(range(1, parts + 1)) AS part_number FROM plan) ANTI JOIN parts_ USING (file_id, part_number)")
def missing_parts(spark: S, sf: str) -> DataFrame:
    return U.missing_parts(_plan(spark, sf), _parts(spark, sf))


@query("bitmap_parts", "SELECT CAST(k AS INTEGER) AS part, (CAST('0x' || substr('A5F00180', CAST(k // 8 * 2 + 1 AS INT), 2) AS INTEGER) >> CAST(7 - k % 8 AS INT)) & 1 = 1 AS received FROM range(0, 32) t(k)")
def bitmap_parts(spark: S, sf: str) -> DataFrame:
    bitmap = F.unhex(F.lit("A5F00180"))
    return spark.range(32).select(F.col("id").cast("int").alias("part"), T.bit_is_set(bitmap, F.col("id")).alias("received"))


# ------------------------------------------------------------------ outbox and status

_STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PUBLISHING' WHEN 'purchase' THEN 'PUBLISHED' WHEN 'error' THEN 'DEAD' ELSE 'PENDING' END"
_OUTBOX_SQL = f"""ob AS (SELECT event_id, user_id AS file_id, ts AS created_at, {_STATUS_SQL} AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS retry_count,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 DAY END AS next_retry_at, CASE WHEN event_type = 'click' THEN ts + INTERVAL 30 SECOND END AS locked_until FROM events)"""


def _outbox(spark: S, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "PUBLISHING").when(F.col("event_type") == "purchase", "PUBLISHED").when(F.col("event_type") == "error", "DEAD").otherwise("PENDING")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("file_id"), F.col("ts").alias("created_at"), status.alias("status"),
        (F.from_json("props", "k bigint")["k"] % 5).alias("retry_count"),
        F.when(F.col("event_id") % 3 == 0, F.expr("ts + INTERVAL 5 DAYS")).alias("next_retry_at"),
        F.when(F.col("event_type") == "click", F.expr("ts + INTERVAL 30 SECONDS")).alias("locked_until"),
    )


@query("outbox_dedup", "SELECT 'DOCUMENT_PROCESSING:' || user_id || ':v1' AS dedup_key, user_id AS file_id FROM (SELECT DISTINCT user_id FROM events)")
def outbox_dedup(spark: S, sf: str) -> DataFrame:
    return U.outbox_rows(_outbox(spark, sf))


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("outbox_candidates", f"WITH {_OUTBOX_SQL} SELECT event_id, status FROM ob WHERE (status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {_NOW})) OR (status = 'PUBLISHING' AND locked_until < {_NOW})")
def outbox_candidates(spark: S, sf: str) -> DataFrame:
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    c = F.col
    return _outbox(spark, sf).where(U.dispatchable(c("status"), c("next_retry_at"), c("locked_until"), now)).select("event_id", "status")


@query("outbox_claim_batch", f"WITH {_OUTBOX_SQL} SELECT event_id, created_at FROM ob WHERE (status = 'PENDING' AND (next_retry_at IS NULL OR next_retry_at <= {_NOW})) OR (status = 'PUBLISHING' AND locked_until < {_NOW}) ORDER BY created_at, event_id LIMIT 20")
def outbox_claim_batch(spark: S, sf: str) -> DataFrame:
    return U.claim(_outbox(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 20).select("event_id", "created_at")


_FILE_STATUS_SQL = "fs AS (SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'READY' WHEN 2 THEN 'RETRYING' ELSE 'CHUNKED' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'v6' ELSE 'v7' END AS chunker_version, doc_id % 3 <> 0 AS has_chunks FROM documents WHERE doc_id % 6 <> 5)"


def _file_status(spark: S, sf: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "UPLOADED").when(k % 4 == 1, "READY").when(k % 4 == 2, "RETRYING").otherwise("CHUNKED")
    return table(spark, sf, "documents").where(k % 6 != 5).select(k.alias("file_id"), status.alias("file_status"), F.when(k % 5 == 0, "v6").otherwise("v7").alias("chunker_version"), (k % 3 != 0).alias("has_chunks"))


@query("dispatch_actions", f"WITH {_OUTBOX_SQL}, {_FILE_STATUS_SQL} SELECT event_id, CASE WHEN fs.status IS NULL THEN 'DEAD' WHEN fs.status <> 'UPLOADED' THEN 'PUBLISHED' ELSE 'SEND' END AS action FROM ob LEFT JOIN fs USING (file_id)")
def dispatch_actions(spark: S, sf: str) -> DataFrame:
    return _outbox(spark, sf).join(_file_status(spark, sf), "file_id", "left").select("event_id", U.dispatch_action(F.col("file_status")).alias("action"))


@query("outbox_file_update", f"WITH {_OUTBOX_SQL}, {_FILE_STATUS_SQL} SELECT event_id, CASE WHEN ob.status = 'PENDING' AND fs.status <> 'UPLOADED' THEN 'PUBLISHED' ELSE ob.status END AS status FROM ob JOIN fs USING (file_id)")
def outbox_file_update(spark: S, sf: str) -> DataFrame:
    rows = _outbox(spark, sf).join(_file_status(spark, sf), "file_id")
    return rows.select("event_id", F.when((F.col("status") == "PENDING") & (F.col("file_status") != "UPLOADED"), "PUBLISHED").otherwise(F.col("status")).alias("status"))


@query("resume_actions", f"WITH {_FILE_STATUS_SQL} SELECT file_id, CASE WHEN status IN ('READY', 'NEEDS_OCR') THEN 'IGNORE' WHEN status IN ('CHUNKED', 'EMBEDDING', 'RETRYING') AND has_chunks AND chunker_version = 'v7' THEN 'VECTORIZE' ELSE 'PARSE' END AS action FROM fs")
def resume_actions(spark: S, sf: str) -> DataFrame:
    c = F.col
    return _file_status(spark, sf).select("file_id", U.resume_action(c("file_status"), c("chunker_version"), c("has_chunks"), "v7").alias("action"))


@query("retry_backoff", f"WITH {_OUTBOX_SQL} SELECT event_id, CASE WHEN event_id % 7 = 0 OR retry_count + 1 >= 4 THEN 'DEAD' ELSE 'PENDING' END AS status, CAST(least(300, 2 * pow(2, least(20, greatest(0, retry_count)))) AS BIGINT) AS delay FROM ob")
def retry_backoff(spark: S, sf: str) -> DataFrame:
    rows = _outbox(spark, sf)
    return rows.select("event_id", U.retry_outcome(F.col("retry_count"), F.col("event_id") % 7 != 0, 4).alias("status"), T.backoff_seconds(F.col("retry_count") + 1).alias("delay"))


_FAILURES = "(VALUES ('reset', CAST(NULL AS INT)), ('http', 429), ('http', 503), ('http', 400), ('bad_argument', CAST(NULL AS INT)), ('missing_object', 404)) AS t(kind, status)"


@query("retryable_failures", f"SELECT kind, status, CASE WHEN kind IN ('bad_argument', 'missing_object', 'access_denied') THEN FALSE WHEN status IS NULL THEN TRUE ELSE status = 429 OR status >= 500 OR status < 400 END AS retryable FROM {_FAILURES}")
def retryable_failures(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _FAILURES).withColumn("retryable", U.is_retryable(F.col("kind"), F.col("status")))


_EVENTS_SQL = "se AS (SELECT user_id AS file_id, ts AS seen, event_id, CASE event_type WHEN 'signup' THEN 'PARSING' WHEN 'view' THEN 'CHUNKED' WHEN 'click' THEN 'RETRYING' WHEN 'purchase' THEN 'READY' ELSE 'FAILED' END AS status FROM events)"


def status_events(spark: S, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "PARSING").when(kind == "view", "CHUNKED").when(kind == "click", "RETRYING").when(kind == "purchase", "READY").otherwise("FAILED")
    return table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("ts").alias("at"), "event_id", status.alias("status"))


@query("status_final", f"""WITH {_EVENTS_SQL}, l AS (SELECT *, coalesce(max(CASE WHEN status IN ('READY', 'NEEDS_OCR') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seen, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND status IN ('FAILED', 'RETRYING') AS late FROM se)
SELECT file_id, arg_max(status, (seen, event_id)) FILTER (NOT late) AS status, count(*) FILTER (late) AS late_failures FROM l GROUP BY 1""")
def status_final(spark: S, sf: str) -> DataFrame:
    return U.final_status(status_events(spark, sf))


@query("idempotent_consumption", f"WITH {_OUTBOX_SQL}, {_FILE_STATUS_SQL} SELECT file_id, min(event_id) AS event_id FROM ob WHERE file_id NOT IN (SELECT file_id FROM fs WHERE status IN ('READY', 'NEEDS_OCR')) GROUP BY 1")
def idempotent_consumption(spark: S, sf: str) -> DataFrame:
    done = _file_status(spark, sf).where(F.col("file_status").isin(*U.TERMINAL)).select("file_id")
    return _outbox(spark, sf).join(done, "file_id", "left_anti").groupBy("file_id").agg(F.min("event_id").alias("event_id"))


@query("delete_by_md5", f"WITH {X.FILES} SELECT file_id FROM files WHERE md5 NOT IN (SELECT md5 FROM files WHERE file_id % 50 = 0)")
def delete_by_md5(spark: S, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    return files.join(files.where("file_id % 50 = 0").select("md5").distinct(), "md5", "left_anti").select("file_id")


@query("ordered_chunks", f"WITH {X.LINES} SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS number FROM lines")
def ordered_chunks(spark: S, sf: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return X.lines(spark, sf).select("doc_id", "ordinal", F.row_number().over(order).cast("long").alias("number"))


_ENDED = "named AS (SELECT event_id, user_id AS file_id, ts, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'abort' ELSE 'init' END AS action FROM events)"


@query("upload_sessions", f"""WITH RECURSIVE {_ENDED},
seq AS (SELECT file_id, action, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id, action) AS n FROM named),
fold AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS restarts, CAST(0 AS BIGINT) AS refused FROM named
  UNION ALL SELECT f.file_id, s.n,
    CASE WHEN f.status = 'COMPLETED' THEN f.status WHEN s.action = 'init' THEN 'UPLOADING' WHEN f.status = 'UPLOADING' THEN CASE s.action WHEN 'complete' THEN 'COMPLETED' ELSE 'ABORTED' END ELSE f.status END,
    f.restarts + CASE WHEN f.status = 'ABORTED' AND s.action = 'init' THEN 1 ELSE 0 END,
    f.refused + CASE WHEN f.status = 'COMPLETED' THEN CASE WHEN s.action = 'abort' THEN 1 ELSE 0 END WHEN s.action = 'init' OR f.status = 'UPLOADING' THEN 0 ELSE 1 END
  FROM fold f JOIN seq s ON s.file_id = f.file_id AND s.n = f.n + 1)
SELECT file_id, arg_max(status, n) AS status, arg_max(restarts, n) AS restarts, arg_max(refused, n) AS refused FROM fold GROUP BY file_id""")
def upload_sessions(spark: S, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "abort").otherwise("init")
    return U.session_states(table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("ts").alias("at"), "event_id", action.alias("action")))


@query("outbox_settle", f"""WITH {_OUTBOX_SQL}, held AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN 'mine' ELSE 'other' END AS token, ['PUBLISHED', 'RESCHEDULE', 'DEAD'][CAST(event_id % 3 + 1 AS BIGINT)] AS action FROM ob)
SELECT event_id, CASE WHEN status <> 'PUBLISHING' OR token = 'other' THEN status WHEN action = 'RESCHEDULE' THEN 'PENDING' ELSE action END AS status,
       CASE WHEN status = 'PUBLISHING' AND token = 'mine' AND action <> 'PUBLISHED' THEN retry_count + 1 ELSE retry_count END AS retry_count, status = 'PUBLISHING' AND token = 'mine' AS settled FROM held""")
def outbox_settle(spark: S, sf: str) -> DataFrame:
    """Every claimed event is reported by a worker with one token; half of them have been claimed again by another."""
    k = F.col("event_id")
    rows = _outbox(spark, sf).withColumns({"lock_token": F.when(k % 2 == 0, "mine").otherwise("other"), "last_error": F.lit(None).cast("string")})
    action = F.when(k % 3 == 0, "PUBLISHED").when(k % 3 == 1, "RESCHEDULE").otherwise("DEAD")
    told = rows.select("event_id", F.lit("mine").alias("lock_token"), action.alias("action"), (F.col("retry_count") + 1).alias("retry_count"), F.col("created_at").alias("next_retry_at"), F.lit("failed").alias("error"))
    return U.settle(rows, told, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "status", "retry_count", "settled")


@query("slow_requests", "SELECT event_type AS path, count(*) AS requests, count(*) FILTER (value * 100 > 3000) AS slow, round(avg(value * 100), 6) AS mean_ms, max(value * 100) AS longest_ms FROM events GROUP BY 1")
def slow_requests(spark: S, sf: str) -> DataFrame:
    return U.slow_requests(table(spark, sf, "events").select(F.col("event_type").alias("path"), (F.col("value") * 100).alias("took_ms")))


@query("sessions", "SELECT user_id, session_id, created, updated FROM (SELECT user_id, user_id || '-' || event_id % 7 AS session_id, min(ts) FILTER (event_type = 'view') AS created, max(ts) FILTER (event_type IN ('view', 'click')) AS updated, max(ts) FILTER (event_type = 'view') AS made, max(ts) FILTER (event_type = 'error') AS gone FROM events GROUP BY 1, 2) WHERE created IS NOT NULL AND (gone IS NULL OR gone < made) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session_id) <= 100")
def sessions(spark: S, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "touch").when(F.col("event_type") == "error", "delete").otherwise("other")
    rows = table(spark, sf, "events").select("user_id", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("session_id"), F.col("ts").alias("at"), action.alias("action"))
    return C.sessions(rows)


@query("versioned_replace", """
WITH marked AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN 1 ELSE 2 END AS version,
       md5(coalesce(d.text, '') || CASE WHEN m.doc_id IS NULL THEN '' ELSE chr(10) || 'quality ' || coalesce(CAST(m.quality AS VARCHAR), '-') END) AS digest
FROM documents d LEFT JOIN marked m USING (doc_id)""")
def versioned_replace(spark: S, sf: str) -> DataFrame:
    """All documents are written, then those with labels are replaced, with their label as last line: the second version."""
    path = shared_path(spark, "versioned-documents")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    V.replace(docs, path)
    label = F.concat(F.lit("\nquality "), F.coalesce(F.col("quality").cast("string"), F.lit("-")))
    V.replace(docs.join(marked, "doc_id").select("doc_id", F.concat("text", label).alias("text")), path)
    return V.read(spark, path, name="version").select("doc_id", F.col("version").cast("int").alias("version"), F.md5("text").alias("digest"))
