"""File formats as elements: dispatch, validation, and readers for text, CSV, Markdown, HTML and OOXML.

A file is a row (path, content) of Spark's binaryFile source, or a text column; readers run per row in mapInPandas.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.access import ancestors
from tessera.operators.documents import ELEMENTS, Element, clean

# ---- fixed values: extensions, and labels by extension ----
SUPPORTED = "pdf doc docx xls xlsx ppt pptx txt rtf md odt ods odp html htm xml json csv epub pages numbers keynote".split()
DENIED = (
    "jpg jpeg png gif bmp svg webp tiff ico psd "
    "mp3 wav flac aac ogg wma m4a "
    "mp4 avi mov wmv flv mkv webm m4v 3gp "
    "zip rar 7z tar gz bz2 xz "
    "exe msi dmg pkg deb rpm "
    "ttf otf woff woff2 eot "
    "dwg dxf step iges "
    "db sqlite mdb accdb "
    "bin dat iso img"
).split()
LABELS = {
    "pdf": "PDF文档", "doc": "Word文档", "docx": "Word文档", "xls": "Excel表格", "xlsx": "Excel表格",
    "ppt": "PowerPoint演示文稿", "pptx": "PowerPoint演示文稿", "txt": "文本文件", "rtf": "富文本文档", "md": "Markdown文档",
    "odt": "OpenDocument文本", "ods": "OpenDocument表格", "odp": "OpenDocument演示文稿", "html": "HTML文档", "htm": "HTML文档",
    "xml": "XML文档", "json": "JSON文件", "csv": "CSV文件", "epub": "EPUB电子书", "pages": "Apple Pages文档",
    "numbers": "Apple Numbers表格", "keynote": "Apple Keynote演示文稿", "jpg": "JPEG图片", "jpeg": "JPEG图片", "png": "PNG图片",
    "gif": "GIF图片", "bmp": "BMP图片", "svg": "SVG图片", "mp4": "MP4视频", "avi": "AVI视频", "mov": "MOV视频", "mp3": "MP3音频",
    "wav": "WAV音频", "zip": "ZIP压缩包", "rar": "RAR压缩包", "7z": "7Z压缩包",
}
SHEET_TITLE = "工作表："
# -----------------------------------------------------------


def extension(name: Column) -> Column:
    """The lower-cased last extension; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))


def parser_of(name: Column) -> Column:
    """The reader that a file name is dispatched to."""
    ext = extension(name)
    return (
        F.when(ext.isin("pdf", "docx", "pptx", "csv"), ext)
        .when(ext.isin("xlsx", "xls"), "spreadsheet")
        .when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin("html", "htm"), "html")
        .otherwise("fallback")
    )


def type_label(ext: Column) -> Column:
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.concat(F.upper(ext), F.lit("文件")))


def validate(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add extension, valid, reason and label. Unknown extensions are invalid; ``markdown`` is unknown here."""
    ext = extension(F.col(name))
    rows = files.withColumn("extension", F.when(ext != "", ext))
    reason = (
        F.when(F.col(name).isNull() | (F.trim(name) == ""), "empty name")
        .when(F.col("extension").isNull(), "no extension")
        .when(F.col("extension").isin(*SUPPORTED), "supported")
        .when(F.col("extension").isin(*DENIED), "unsupported")
        .otherwise("unknown")
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumns({"valid": F.col("reason") == "supported", "label": F.when(F.col("extension").isNull(), "unknown").otherwise(type_label(F.col("extension")))})


def supported_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, LABELS[e]) for e in SUPPORTED], "extension string, label string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under path as (file_name, content); only the listed extensions are opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content")


# ------------------------------------------------------------------ readers: content -> elements


def _texts(body: str, locator: str, kind: str = "NARRATIVE") -> list[Element]:
    return [Element(kind, clean(p), locator=locator) for p in re.split(r"\n{2,}", body) if clean(p)]


def read_plain(content: bytes) -> list[Element]:
    return _texts(clean(content.decode("utf-8", "replace")), "tika")


def read_csv(content: bytes) -> list[Element]:
    """The whole file is one table; delimiters are not interpreted."""
    body = clean(content.decode("utf-8", "replace"))
    return [Element("TABLE", body, locator="csv")] if body else []


_HEADING, _ITEM = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"[-*+]\s+.*|\d+[.)]\s+.*")


def read_markdown(content: bytes) -> list[Element]:
    """Fences, headings, list lines and paragraphs in order; text before a fence stays before it, an open fence is kept."""
    out: list[Element] = []
    pile: list[str] = []
    fenced = False

    def close(kind: str, locator: str) -> None:
        body = clean("\n".join(pile)) if kind == "NARRATIVE" else "\n".join(pile).strip()
        pile.clear()
        if body:
            out.append(Element(kind, body, locator=locator))

    for line in clean(content.decode("utf-8", "replace")).split("\n"):
        if line.startswith("```"):
            close(*(("CODE", "code") if fenced else ("NARRATIVE", "markdown")))
            fenced = not fenced
        elif fenced:
            pile.append(line)
        elif found := _HEADING.fullmatch(line):
            close("NARRATIVE", "markdown")
            level = len(found[1])
            out.append(Element("TITLE", found[2].strip(), locator=f"heading:{level}", heading_level=level, heading_confidence="HIGH"))
        elif _ITEM.fullmatch(line):
            close("NARRATIVE", "markdown")
            out.append(Element("LIST", line, locator="list"))
        else:
            pile.append(line)
    close(*(("CODE", "code") if fenced else ("NARRATIVE", "markdown")))
    return out


class _Selected(HTMLParser):
    """Text of h1..h6, p, li, pre and table elements in document order; nested ones are reported on their own too."""

    WANTED = frozenset("h1 h2 h3 h4 h5 h6 p li pre table".split())
    CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
    RAW = frozenset(("script", "style", "title", "textarea"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.RAW:
            self.silent += 1
            return
        if tag in self.CLOSES_P:
            self._end("p")
        if tag == "li":
            self._end("li", stop=("ul", "ol"))
        if tag == "br":
            self.handle_data(" ")
        if tag in ("br", "hr", "img", "meta", "link", "input"):
            return
        self._space()
        body: list[str] | None = [] if tag in self.WANTED else None
        if body is not None:
            self.found.append((tag, body))
        self.open.append((tag, body))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.RAW:
            self.silent = max(0, self.silent - 1)
            return
        self._end(tag)

    def _end(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                self._space()
                return
            if self.open[k][0] in stop:
                return

    def _space(self) -> None:
        if self.open and self.open[-1][0] in ("tr", "table", "ul", "ol", "li", "td", "th", "tbody"):
            self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, body in self.open:
                if body is not None:
                    body.append(data)


_HTML_KINDS = {"table": "TABLE", "pre": "CODE", "li": "LIST", "p": "NARRATIVE"}


def read_html(content: bytes) -> list[Element]:
    parser = _Selected()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    out = []
    for tag, parts in parser.found:
        body = clean(re.sub(r"\s+", " ", "".join(parts)))
        if not body:
            continue
        if tag[0] == "h" and tag != "hr":
            out.append(Element("TITLE", body, locator=f"heading:{tag[1]}", heading_level=int(tag[1]), heading_confidence="HIGH"))
        else:
            out.append(Element(_HTML_KINDS[tag], body, locator=f"html:{tag}"))
    return out


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x) == name)


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _run_text(node: ElementTree.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in node.iter())




def _is_form(body: str) -> bool:
    fields = sum(w in body for w in T.FIELD_WORDS)
    return any(w in body for w in T.FORM_WORDS) or fields >= 5 or (fields >= 3 and bool(re.search(r"月\s*日", body)))


def _is_scaffold(body: str) -> bool:
    signed = sum(w in body for w in T.FIELD_WORDS) >= 3 and any(w in body for w in T.SIGNATURE_WORDS)
    return len(body) <= 100 and (any(w in body for w in T.FORM_WORDS) or signed)


_NUMBERED = re.compile(r"第[一二三四五六七八九十百千万零〇0-9]+([章节条])\s*.{1,100}")
_CHAPTER = re.compile(r"[一二三四五六七八九十]+、\s*.{1,100}")
_NUMERIC = re.compile(r"\d+(?:(\.\d+)[.、]?|[.、])\s+[^\s\d].{0,100}")


def detect_heading(line: str) -> tuple[int, str] | None:
    """(level, confidence) of a line that looks like a heading."""
    body = clean(line)
    if not 2 <= len(body) <= 120 or body[-1] in "。！？；;!?":
        return None
    if found := _NUMBERED.fullmatch(body):
        return {"章": (1, "MEDIUM"), "节": (2, "MEDIUM"), "条": (3, "LOW")}[found[1]]
    if _CHAPTER.fullmatch(body):
        return 1, "MEDIUM"
    if found := _NUMERIC.fullmatch(body):
        return (2 if found[1] else 1), "MEDIUM"
    return None


def read_docx(content: bytes) -> list[Element]:
    """Paragraphs and tables in body order; heading styles give levels, other lines go through the heading detector."""
    out: list[Element] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = next(_all(_xml(archive, "word/document.xml"), "body"))
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in _all(_xml(archive, "word/styles.xml"), "style"):
                named = next(_all(style, "name"), None)
                names[_attr(style, "styleId")] = _attr(named, "val") if named is not None else None
        for node in body:
            if _local(node) == "p":
                line = clean(_run_text(node))
                style = next((_attr(x, "val") for x in _all(node, "pStyle")), None)
                shown = (names.get(style) or style or "").lower()
                if not line:
                    continue
                if re.search(r"(heading|标题) ?[1-9]", shown):
                    level = min(6, int(re.sub(r"\D", "", shown)))
                    out.append(Element("TITLE", line, locator=f"heading:{level}", heading_level=level, heading_confidence="HIGH"))
                elif found := detect_heading(line):
                    out.append(Element("TITLE", line, locator=f"heading:{found[0]}", heading_level=found[0], heading_confidence=found[1]))
                elif not _is_scaffold(line):
                    out.append(Element("NARRATIVE", line, locator=f"paragraph:{len(out) + 1}"))
            elif _local(node) == "tbl":
                cells = [[clean(_run_text(c)) for c in _all(r, "tc")] for r in _all(node, "tr")]
                total, filled = sum(map(len, cells)), sum(bool(v) for r in cells for v in r)
                rows = [" | ".join(v for v in r if v) for r in cells if any(r)]
                blank = total >= 20 and len(rows) >= 5 and filled / total < 0.3
                if rows and not blank and not _is_form("\n".join(rows)):
                    out.append(Element("TABLE", "\n".join(rows), locator=f"table:{len(out) + 1}"))
    return out


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def read_pptx(content: bytes) -> list[Element]:
    """Per slide the first text shape is the title, the others are one narrative; the page is the slide's number."""
    out: list[Element] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for page, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
            texts = []
            for shape in _all(_xml(archive, name), "sp"):
                body = clean("\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p")))
                if body:
                    texts.append(body)
            if texts:
                out.append(Element("TITLE", texts[0], page, f"slide:{page};heading:1", None, 1, "HIGH"))
            if texts[1:]:
                out.append(Element("NARRATIVE", "\n".join(texts[1:]), page, f"slide:{page}"))
    return out


def read_xlsx(content: bytes) -> list[Element]:
    """Per sheet a title and one table of its non-blank rows; blank cells inside a row stay."""
    out: list[Element] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(archive, "xl/sharedStrings.xml"), "si")]
        names = [_attr(s, "name") or "" for s in _all(_xml(archive, "xl/workbook.xml"), "sheet")]
        for name, part in zip(names, _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            out.append(Element("TITLE", SHEET_TITLE + name, locator="heading:1", heading_level=1, heading_confidence="HIGH"))
            rows = []
            for row in _all(_xml(archive, part), "row"):
                values = []
                for cell in _all(row, "c"):
                    raw = next((v.text or "" for v in _all(cell, "v")), "")
                    kind = _attr(cell, "t")
                    values.append(shared[int(raw)] if kind == "s" and raw else "".join(t.text or "" for t in _all(cell, "t")) if kind == "inlineStr" else raw)
                if any(v.strip() for v in values):
                    rows.append(" | ".join(values))
            if rows:
                out.append(Element("TABLE", "\n".join(rows).strip(), locator=f"sheet:{name}"))
    return out


def page_elements(pages: list[str], outlines: dict[int, list[tuple[int, str]]] | None = None) -> list[Element]:
    """Elements of extracted pages: contents pages skipped, outline titles first, then headings and paragraphs by line."""
    out: list[Element] = []
    for page, body in enumerate(pages, 1):
        rows = [clean(x) for x in body.split("\n")]
        leaders = sum(bool(re.search(r"(?:[.．·…]\s*){6,}", x)) for x in rows)
        if leaders >= 3 or (leaders >= 2 and any(re.fullmatch(r"(?i)目\s*录|contents?", x) for x in rows)):
            continue
        known = set()
        for level, title in (outlines or {}).get(page, []):
            if clean(title):
                known.add(clean(title))
                out.append(Element("TITLE", clean(title), page, f"page:{page};heading:{level};confidence:HIGH", None, level, "HIGH"))
        pile: list[str] = []
        for row in [*rows, ""]:
            found = detect_heading(row) if row else None
            counter = re.fullmatch(r"(?:第\s*)?\d+\s*[/／]\s*\d+\s*页?", row)
            if row and not found and not counter:
                pile.append(row)
                continue
            if pile:
                out.append(Element("NARRATIVE", "\n".join(pile), page, f"page:{page}"))
                pile = []
            if found and row not in known:
                out.append(Element("TITLE", row, page, f"page:{page};heading:{found[0]};confidence:{found[1]}", None, *found))
    return out


READERS = {"docx": read_docx, "pptx": read_pptx, "spreadsheet": read_xlsx, "csv": read_csv, "markdown": read_markdown, "html": read_html, "fallback": read_plain}


def parse_files(files: DataFrame) -> DataFrame:
    """files (doc_id, file_name, content) -> (doc_id, file_name, elements, error).

    A file that cannot be read has no elements and an error. PDF files need a page extractor, which is not part of Spark
    or the standard library: they are reported as such, and ``page_elements`` takes extracted pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, name, content, kind in zip(pdf["doc_id"], pdf["file_name"], pdf["content"], pdf["_parser"], strict=True):
                try:
                    found = READERS[kind](bytes(content or b"")) if kind != "pdf" else []
                    error = "needs a page extractor" if kind == "pdf" else None
                except Exception as e:
                    found, error = [], f"{type(e).__name__}: {e}"[:4000]
                items = [{"type": e.type, "text": e.text, "page": e.page, "locator": e.locator, "ordinal": k, "heading_level": e.heading_level, "heading_confidence": e.heading_confidence} for k, e in enumerate(found, 1)]
                rows.append((doc_id, name, items, error))
            yield pd.DataFrame(rows, columns=["doc_id", "file_name", "elements", "error"])

    return files.select("doc_id", "file_name", "content", parser_of(F.col("file_name")).alias("_parser")).mapInPandas(run, f"doc_id long, file_name string, elements {ELEMENTS}, error string")


def read_claims(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines of claims with evidence: (id, claim, relevant); with a limit, fewer claims are an error."""
    rows = claims_of(spark.read.text(path))
    if limit is None:
        return rows
    picked = rows.orderBy("id").limit(limit)
    if picked.count() < limit:
        raise ValueError(f"fewer than {limit} claims with evidence")
    return picked


def claims_of(lines: DataFrame) -> DataFrame:
    """lines (value) of JSON -> (id, claim, relevant) of claims whose evidence names a document."""
    raw = lines.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.claim").alias("claim"), F.json_object_keys(F.get_json_object("value", "$.evidence")).alias("relevant"))
    return raw.where(F.size("relevant") > 0)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """JSON lines of papers: (doc_id, title, abstract), the last line of an id wins; and the number of malformed lines."""
    return corpus_of(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def corpus_of(lines: DataFrame) -> tuple[DataFrame, int]:
    """lines (line, value) of JSON -> papers and the number of malformed lines; blank lines are neither."""
    parsed = lines.where("trim(value) <> ''").withColumn("_j", F.from_json("value", "doc_id string, title string, abstract array<string>"))
    good = parsed.where(F.col("_j.doc_id").isNotNull())
    rows = good.groupBy(F.col("_j.doc_id").alias("doc_id")).agg(F.max_by("_j", "line").alias("_k")).select("doc_id", "_k.title", "_k.abstract")
    return rows, parsed.where(F.col("_j.doc_id").isNull()).count()


def outline_headings(bookmarks: DataFrame) -> DataFrame:
    """bookmarks (file_id, node, parent, title, page) -> (file_id, node, page, title, level) of usable bookmarks.

    Children of a broken bookmark (no page, or no title) are still visited; levels are counted from the top and held at 6.
    Bookmarks that do not lead up to a top one are left out.
    """
    key = lambda c: F.struct("file_id", F.col(c).alias("node"))
    chains = ancestors(bookmarks.select(key("node").alias("tag_id"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent_tag")))
    tops = bookmarks.where(F.col("parent").isNull()).select(key("node").alias("ancestor"))
    levels = chains.join(tops, "ancestor").select("tag_id.file_id", "tag_id.node", F.least(F.lit(6), F.col("depth") + 1).alias("level"))
    rows = bookmarks.join(levels, ["file_id", "node"]).select("file_id", "node", "page", T.clean(F.col("title")).alias("title"), "level")
    return rows.where((F.col("page") > 0) & (F.col("title") != ""))
