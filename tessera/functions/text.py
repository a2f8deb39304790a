"""Text functions as Column builders: cleaning, token estimates, labels, headings, form tests.

All of them stay in built-in functions; only ``nfkc`` needs Python, and it is applied to texts that may change under it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: they must equal those of the behaviour that is reproduced ----
#: Ten words that mark a form.
FORM_WORDS = ("申请单", "申请表", "签到卡", "签到簿", "请假卡", "通知单", "报销单", "日报表", "记录表", "汇总表")
#: Thirteen words of form fields.
FIELD_WORDS = ("姓名", "部门", "日期", "申请人", "核准", "审核", "签字", "签章", "填表", "职务", "事由", "主管", "经理")
SIGNATURE_WORDS = ("签字", "签章", "核准", "审核", "填表")
CONTEXT_WORDS = ("那", "那么", "这个", "这些", "这种", "这样", "也是", "也要", "也可以", "还是", "前面", "上面", "刚才", "它", "他们", "她们", "其", "呢")
ELLIPSIS_WORDS = ("提前", "多少", "几天", "多久", "什么时候", "怎么办", "怎么处理", "是否可以", "需要吗", "可以吗")
TITLE_JOINT = "｜"
DEFAULT_TITLE = "新对话"
UNKNOWN_FILE = "未知文件"
UNKNOWN_SOURCE = "未知来源"
UNKNOWN_TIME = "未知时间"
UNKNOWN_ERROR = "未知处理错误"
UNNAMED_OBJECT = "document"
#: Extensions that are previewed as text.
PREVIEWED = ("txt", "md", "doc", "docx", "pdf", "html", "htm", "xml", "json", "csv", "log", "java", "js", "ts", "py", "cpp", "c", "h", "css", "scss", "less", "sql", "yml", "yaml", "properties", "conf", "config")
PREVIEW_CUT = "... (内容已截断，仅显示前10KB)"
PREVIEW_CARD = "文件名: %s\n文件大小: %s\n文件类型: %s\n上传时间: %s\n\n此文件类型不支持预览，请下载后查看。"
# ---------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form. ASCII texts, which cannot change, do not travel to Python."""
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(odd), text)


def strip(text: Column) -> Column:
    """White space and control characters removed at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def tidy(text: Column) -> Column:
    """Cleaning after NFKC: line ends, control characters, runs of blanks, blanks at line ends, at most one empty line."""
    value = F.coalesce(text, F.lit(""))
    value = F.regexp_replace(value, "\u00a0", " ")
    value = F.regexp_replace(value, "\r\n|\r", "\n")
    value = F.regexp_replace(value, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    value = F.regexp_replace(value, " *\n *", "\n")
    value = F.regexp_replace(value, "\n{3,}", "\n\n")
    return strip(value)


def clean(text: Column) -> Column:
    return tidy(nfkc(text))


def token_estimate(text: Column) -> Column:
    """Runs of ASCII letters and digits cost a quarter of their length, rounded up; other visible characters cost 1."""
    return (F.regexp_count(text, F.lit("[A-Za-z0-9]{1,4}")) + F.regexp_count(text, F.lit(r"[^A-Za-z0-9\s]"))).cast("long")


def history_token_estimate(text: Column) -> Column:
    """Han characters cost 1, other visible characters a quarter in all (1 at least), and a message 4."""
    han = F.regexp_count(text, F.lit(r"\p{IsHan}"))
    rest = F.regexp_count(text, F.lit(r"[^\p{IsHan}\s]"))
    return (han + F.greatest(F.lit(1), F.floor((rest + 3) / 4)) + 4).cast("long")


def display_name(name: Column) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(strip(text)) > 0, text)


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def embedding_prefix(name: Column, title: Column) -> Column:
    return F.concat_ws("\n", blank_to_null(display_name(tidy(name))), blank_to_null(F.regexp_replace(tidy(title), TITLE_JOINT, "|")))


def embedding_text(name: Column, title: Column, body: Column) -> Column:
    """Name, title path and text on lines of their own; the title's full-width joint is narrowed as by cleaning."""
    return F.concat_ws("\n", blank_to_null(embedding_prefix(name, title)), blank_to_null(tidy(body)))


def rerank_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", blank_to_null(title), F.coalesce(body, F.lit("")))


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis if there were more."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def excerpt(text: Column, most: int = 240) -> Column:
    return cut(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), most)


def page_label(start: Column, end: Column) -> Column:
    one = F.concat(F.lit("第 "), start.cast("string"), F.lit(" 页"))
    span = F.concat(F.lit("第 "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" 页"))
    return F.when(start.isNull(), F.lit(None).cast("string")).when(end.isNull() | (end == start), one).otherwise(span)


def source_label(name: Column, title: Column, start: Column, end: Column, body: Column) -> Column:
    """《name》, then the title path, then the pages; without either the first 40 characters of the text."""
    titled = F.length(strip(F.coalesce(title, F.lit("")))) > 0
    head = F.concat(F.lit("《"), F.coalesce(display_name(tidy(name)), F.lit(UNKNOWN_FILE)), F.lit("》"))
    head = F.when(name.isNull(), F.lit(f"《{UNKNOWN_FILE}》")).otherwise(head)
    path = F.when(titled, F.concat(F.lit(TITLE_JOINT), title)).otherwise("")
    tail = F.when(start.isNotNull(), F.concat(F.lit(TITLE_JOINT), page_label(start, end))).when(titled, "").otherwise(F.concat(F.lit("｜原文片段：“"), cut(tidy(body), 40), F.lit("”")))
    return F.concat(head, path, tail)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"【(?:来源#\s*|S)(\d+)】", "")


def citation_ids(answer: Column) -> Column:
    """Distinct ids cited in an answer, in order of first citation."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"【来源#\s*(\d+)】"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def link_citations(text: Column) -> Column:
    """Citations as links for display."""
    return F.regexp_replace(text, r"【来源#\s*(\d+)】", '<a class="source" data-id="$1">[$1]</a>')


def session_title(message: Column) -> Column:
    value = strip(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " "))
    return F.when(value == "", F.lit(DEFAULT_TITLE)).otherwise(cut(value, 28))


def safe_name(name: Column) -> Column:
    """A name that is safe as part of an object key; a blank one gets a name of its own."""
    safe = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\\/\x00-\x1F\x7F]", "_"))
    return F.when(safe == "", F.lit(UNNAMED_OBJECT)).otherwise(safe)


def error_description(kind: Column, message: Column, most: int = 4000) -> Column:
    """Kind of the root cause and its message, at most ``most`` characters; an unknown error has a text of its own."""
    told = F.when(message.isNull(), kind).otherwise(F.concat(kind, F.lit(": "), message))
    return F.substring(F.when(told.isNull() | (strip(told) == ""), F.lit(UNKNOWN_ERROR)).otherwise(told), 1, most)


def preview(name: Column, text: Column, size: Column, created: Column, most: int = 10_240) -> Column:
    """The lines that begin within the first ``most`` bytes, with a notice if they fill them; a card for other formats."""
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"))

    def step(state: Column, line: Column) -> Column:
        more = F.struct((state["bytes"] + F.octet_length(line) + 1).alias("bytes"), (state["n"] + 1).alias("n"))
        return F.when(state["bytes"] < most, more).otherwise(state)

    def shown(pair: Column) -> Column:
        # a line takes a byte at least, so no line after the first ``most`` is ever shown
        return F.concat(
            F.when(pair["got"]["n"] > 0, F.concat(F.array_join(F.slice(pair["lines"], F.lit(1), pair["got"]["n"]), "\n"), F.lit("\n"))).otherwise(""),
            F.when(pair["got"]["bytes"] >= most, F.lit("\n" + PREVIEW_CUT)).otherwise(""),
        )

    counted = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.aggregate(F.slice(x, 1, most), start, step).alias("got")))
    ext = F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1)
    card = F.format_string(PREVIEW_CARD, name, human_size(size), F.upper(ext), created)
    return F.when(F.lower(ext).isin(*PREVIEWED), F.get(F.transform(counted, shown), 0)).otherwise(card)


def unquote(text: Column) -> Column:
    """One pair of straight or curved quotes around a text removed."""
    value = strip(text)
    return F.when(value.rlike('(?s)^(".*"|“.*”|\'.*\')$') & (F.length(value) >= 2), strip(F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(value)


def needs_context(question: Column) -> Column:
    """A question of at most 50 characters that refers back, or of at most 12 that is elliptic."""
    value = strip(F.coalesce(question, F.lit("")))
    refers = value.rlike("^[^\n]*(" + "|".join(CONTEXT_WORDS) + ")[^\n]*$")
    elliptic = value.rlike("^[^\n]*(" + "|".join(ELLIPSIS_WORDS) + ")[^\n]*$")
    return (F.length(value) > 0) & (F.length(value) <= 50) & (refers | ((F.length(value) <= 12) & elliptic))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal; null for null.

    Ties are rounded as the queries' SQL has them: up in KB and GB, to an even digit in MB. Rounding comes before the format,
    whose own is up.
    """
    kb, mb, gb = (size / float(1 << k) for k in (10, 20, 30))
    tenths = lambda x: F.round(x * 10) / 10
    shown = F.when(size < 1024, F.format_string("%d B", size)).when(size < 1 << 20, F.format_string("%.1f KB", tenths(kb)))
    shown = shown.when(size < 1 << 30, F.format_string("%.1f MB", F.rint(mb * 10) / 10))
    return F.when(size.isNotNull(), shown.otherwise(F.format_string("%.1f GB", tenths(gb))))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done * 100.0 / total, 2)).otherwise(F.lit(0.0))


def backoff_seconds(retries: Column, base: int = 2, most: int = 300) -> Column:
    """base * 2^(retries - 1), the exponent held between 0 and 20, at most ``most``."""
    power = F.least(F.lit(20), F.greatest(F.lit(0), retries - 1))
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), power)).cast("long")


def sentences(text: Column) -> Column:
    """Sentences with their end mark; blank ones are left out."""
    parts = F.transform(F.split(text, r"(?<=[。！？；.!?;])|(?<=\n)"), strip)
    return F.filter(parts, lambda x: F.length(x) > 0)


def heading_level_of(locator: Column) -> Column:
    found = F.regexp_extract(F.coalesce(locator, F.lit("")), r"^.*heading:(\d+)", 1)
    return F.when(found == "", F.lit(1)).otherwise(found.try_cast("int"))


def bit_is_set(bitmap: Column, k: Column) -> Column:
    """Bit k of a binary, most significant bit of each byte first; bits beyond the end are unset."""
    octet = F.conv(F.hex(F.substring(bitmap, (F.floor(k / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.shiftright(octet, 0).bitwiseAND(F.pow(F.lit(2), 7 - k % 8).cast("int")) > 0, F.lit(False))


def heading(text: Column) -> Column:
    """struct(level, confidence) of a cleaned line that looks like a heading, else null.

    The full-width numbering in parentheses can never match: cleaning makes the parentheses ASCII first.
    """
    fits = F.length(text).between(2, 120) & ~text.rlike("[。！？；;!?]$")
    numbered = F.regexp_extract(text, r"^第[一二三四五六七八九十百千万零〇0-9]+([章节条])\s*.{1,100}$", 1)
    chapter = text.rlike(r"^[一二三四五六七八九十]+、\s*.{1,100}$")
    numeric = text.rlike(r"^\d+(?:[.．]\d+[.．、]?|[.．、])\s+[^\s\d].{0,100}$")
    deeper = text.rlike(r"^\d+[.．]\d+[.．、]?\s+[^\s\d].{0,100}$")
    got = lambda level, confidence: F.struct(F.lit(level).alias("level"), F.lit(confidence).alias("confidence"))
    return F.when(~fits, None).when(numbered == "章", got(1, "MEDIUM")).when(numbered == "节", got(2, "MEDIUM")).when(numbered == "条", got(3, "LOW")).when(chapter, got(1, "MEDIUM")).when(deeper, got(2, "MEDIUM")).when(numeric, got(1, "MEDIUM"))


def word_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in a text."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def is_form_template(table_text: Column) -> Column:
    fields = word_hits(table_text, FIELD_WORDS)
    dated = table_text.rlike(r"(年\s*)?月\s*日")
    return (word_hits(table_text, FORM_WORDS) > 0) | (fields >= 5) | ((fields >= 3) & dated)


def is_form_scaffold(paragraph: Column) -> Column:
    signed = (word_hits(paragraph, FIELD_WORDS) >= 3) & (word_hits(paragraph, SIGNATURE_WORDS) > 0)
    return (F.length(paragraph) <= 100) & ((word_hits(paragraph, FORM_WORDS) > 0) | signed)


def is_blank_template(cells: Column, filled: Column, filled_rows: Column) -> Column:
    return (cells >= 20) & (filled_rows >= 5) & (filled / cells < 0.3)


def is_page_counter(line: Column) -> Column:
    return line.rlike(r"^\s*(?:第\s*)?\d+\s*[/／]\s*\d+\s*(?:页)?\s*$")


def is_contents_heading(line: Column) -> Column:
    return line.rlike(r"(?i)^(?:目\s*录|contents?)$")


def has_dotted_leader(line: Column) -> Column:
    return line.rlike(r"(?:[.．·…]\s*){6,}")


def lenient_timestamp(text: Column) -> Column:
    """ISO date-times, padded where minutes, seconds or the time are missing; null for anything else."""
    n = F.length(text)
    padded = F.when(n == 16, F.concat(text, F.lit(":00"))).when(n == 13, F.concat(text, F.lit(":00:00"))).when(n == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    shape = padded.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$")
    return F.when(shape, F.to_timestamp_ntz(F.substring(padded, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def in_time_range(stamp: Column, start: Column, end: Column) -> Column:
    """Inclusive; a null bound is open. Stamps that cannot be read pass, the mark for an unknown time fails any bound."""
    at, bound = lenient_timestamp(stamp), start.isNotNull() | end.isNotNull()
    inside = F.coalesce(at >= start, F.lit(True)) & F.coalesce(at <= end, F.lit(True))
    return F.when(F.coalesce(stamp == UNKNOWN_TIME, F.lit(False)), ~bound).otherwise(inside)


def sse_payloads(chunk: Column) -> Column:
    """Data payloads of server-sent event lines, without the end mark; bare JSON lines count as payloads."""
    lines = F.transform(F.split(chunk, "\r?\n"), strip)
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith(":") & ~x.rlike("^(event|id|retry):"))
    bare = F.transform(lines, lambda x: F.when(x.startswith("data:"), strip(F.substring(x, F.lit(6), F.length(x)))).otherwise(x))
    return F.filter(bare, lambda x: (F.length(x) > 0) & (x != "[DONE]"))


def sse_content(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.choices[0].delta.content"), F.get_json_object(payload, "$.choices[0].message.content"))
