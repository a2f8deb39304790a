"""Elements, sections and chunks of documents.

Line-level rules are windows and grouped sums. Greedy packing (sections by size, chunks, table splits, short-chunk merges)
is a fold over the elements of one document, so it runs as one Python function per document row inside mapInPandas: a
document is a row, and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

TARGET, HARD_LIMIT, OVERLAP, SHORT = 480, 600, 64, 160
SECTION_TARGET, SECTION_LIMIT = 1800, 2400

ELEMENT = "struct<type:string,text:string,page:int,locator:string,ordinal:int,heading_level:int,heading_confidence:string>"
ELEMENTS = f"array<{ELEMENT}>"


# ------------------------------------------------------------------ windows over lines and elements


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ordinal, text): non-empty lines with their 1-based number among all lines."""
    cut = docs.select(key, F.posexplode(F.split("text", "\n")).alias("_pos", "text"))
    return cut.where("text <> ''").select(key, (F.col("_pos") + 1).cast("long").alias("ordinal"), "text")


def without_page_chrome(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) -> text without lines that repeat as first or last line of most pages.

    A candidate of at most 120 characters must be the first or last line of max(3, 60 %) pages of its document; every line
    equal to it goes then, wherever it stands.
    """
    cut = pages.select("doc_id", "page", F.split(T.tidy(F.col("text")), "\n").alias("_lines"))
    many = F.size("_lines") > 1
    ends = F.when(many, F.array(F.get("_lines", F.lit(0)), F.element_at("_lines", -1))).otherwise(F.array(F.get("_lines", F.lit(0))))
    candidates = cut.select("doc_id", F.explode(ends).alias("line")).where("line <> '' and length(line) <= 120")
    counts = candidates.groupBy("doc_id", "line").agg(F.count("*").alias("_n"))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("_pages"))
    chrome = counts.join(sizes, "doc_id").where(F.col("_n") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.6)))
    exploded = cut.select("doc_id", "page", F.posexplode("_lines").alias("_at", "line"))
    kept = exploded.join(chrome.select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    texts = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(texts, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def needs_ocr(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, needs_ocr): fewer than 10 clean characters per page."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length(T.tidy(F.col("text")))).cast("long").alias("chars")).withColumn("needs_ocr", F.col("chars") < 10 * F.col("pages"))


def is_contents_page(text: Column) -> Column:
    """A contents heading and two lines with dotted leaders, or three such lines."""
    rows = F.filter(F.transform(F.split(text, "\n"), T.tidy), lambda x: x != "")
    leaders = F.size(F.filter(rows, T.has_dotted_leader))
    return (F.exists(rows, T.is_contents_heading) & (leaders >= 2)) | (leaders >= 3)


def section_rows(elements: DataFrame) -> DataFrame:
    """elements (doc_id, ordinal, type, text, page, heading_level, heading_confidence, locator) -> body elements with
    section number and title path, by windows.

    Titles of low confidence or below level 2 are body text. A title starts a section and is not part of its body; a path
    is the last level-1 title and the last level-2 title after it.
    """
    level = F.coalesce("heading_level", T.heading_level_of(F.col("locator")))
    trusted = ~F.coalesce(F.col("heading_confidence"), F.lit("")).isin("LOW", "REJECTED") & (level <= 2)
    rows = elements.where(F.length(T.tidy(F.col("text"))) > 0)
    rows = rows.withColumns({"_title": (F.col("type") == "TITLE") & trusted, "_level": level})
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    name = T.tidy(F.col("text"))
    rows = rows.withColumns(
        {
            "section": F.sum(F.col("_title").cast("long")).over(order),
            "_one": F.last(F.when(F.col("_title") & (F.col("_level") == 1), name), ignorenulls=True).over(order),
            "_one_at": F.last(F.when(F.col("_title") & (F.col("_level") == 1), F.col("ordinal")), ignorenulls=True).over(order),
            "_two": F.last(F.when(F.col("_title") & (F.col("_level") == 2), name), ignorenulls=True).over(order),
            "_two_at": F.last(F.when(F.col("_title") & (F.col("_level") == 2), F.col("ordinal")), ignorenulls=True).over(order),
        }
    )
    two = F.when(F.col("_one_at").isNull() | (F.col("_two_at") > F.col("_one_at")), F.col("_two"))
    path = F.concat_ws(T.TITLE_JOINT, "_one", two)
    rows = rows.where(~F.col("_title")).withColumn("title_path", F.when(path != "", path))
    kind = F.when(F.col("type") == "TITLE", F.lit("NARRATIVE")).otherwise(F.col("type"))
    return rows.withColumn("type", kind).select("doc_id", "section", "title_path", "ordinal", "type", "text", "page", "locator")


def sections(body: DataFrame) -> DataFrame:
    """One row per section: title path, element count, tokens and page range."""
    return body.groupBy("doc_id", "section").agg(
        F.first("title_path").alias("title_path"),
        F.count("*").alias("elements"),
        F.sum(T.token_estimate(F.col("text"))).cast("long").alias("tokens"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
    )


def table_text(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, col, value) -> (table_id, text): blank cells and rows dropped, templates and forms empty."""
    value = T.tidy(F.col("value"))
    rows = cells.withColumn("_v", value).groupBy("table_id", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_v") != "", F.struct("col", "_v")))), lambda x: x["_v"]), " | ").alias("_line"),
        F.count("*").alias("_cells"),
        F.sum((F.col("_v") != "").cast("int")).alias("_filled"),
    )
    tables = rows.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_filled") > 0, F.struct("row", "_line")))), lambda x: x["_line"]), "\n").alias("_text"),
        F.sum("_cells").alias("_c"),
        F.sum("_filled").alias("_f"),
        F.sum((F.col("_filled") > 0).cast("int")).alias("_r"),
    )
    empty = T.is_blank_template(F.col("_c"), F.col("_f"), F.col("_r")) | T.is_form_template(F.col("_text"))
    return tables.select("table_id", F.when(empty, "").otherwise(F.col("_text")).alias("text"))


# ------------------------------------------------------------------ folds over one document


@dataclass(frozen=True)
class Element:
    type: str
    text: str
    page: int | None = None
    locator: str | None = None
    ordinal: int | None = None
    heading_level: int | None = None
    heading_confidence: str | None = None


@dataclass(frozen=True)
class Chunk:
    text: str
    page_start: int | None
    page_end: int | None
    locator: str | None
    tokens: int


_RUNS = re.compile(r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9\s]")
_STRIP = "".join(map(chr, range(33)))


def clean(text: str | None) -> str:
    value = unicodedata.normalize("NFKC", text or "").replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n")
    value = re.sub(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "", value)
    value = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", value))
    return re.sub(r"\n{3,}", "\n\n", value).strip(_STRIP)


def estimate(text: str | None) -> int:
    return len(_RUNS.findall(text or ""))


def _page_range(elements: list[Element]) -> tuple[int | None, int | None]:
    pages = [e.page for e in elements if e.page is not None]
    return (min(pages), max(pages)) if pages else (None, None)


def level_of(element: Element) -> int:
    if element.heading_level is not None:
        return element.heading_level
    found = re.findall(r"heading:(\d+)", element.locator or "")
    return int(found[-1]) if found else 1


def plan_sections(elements: list[Element]) -> list[tuple[str | None, list[Element]]]:
    """(title path, body elements) of each section: by trusted titles, else by pages, else by size."""
    rows = []
    for e in sorted((e for e in elements if clean(e.text)), key=lambda e: (e.ordinal is None, e.ordinal or 0)):
        trusted = e.heading_confidence not in ("LOW", "REJECTED") and level_of(e) <= 2
        rows.append(replace(e, type="NARRATIVE") if e.type == "TITLE" and not trusted else e)
    if any(e.type == "TITLE" for e in rows):
        out: list[tuple[str | None, list[Element]]] = []
        titles: dict[int, str] = {}
        body: list[Element] = []
        path = None
        for e in rows:
            if e.type != "TITLE":
                body.append(e)
                continue
            out.append((path, body))
            body, level = [], level_of(e)
            titles = {k: v for k, v in titles.items() if k < level} | {level: clean(e.text)}
            path = T.TITLE_JOINT.join(v for v in titles.values() if v) or None
        return [s for s in [*out, (path, body)] if s[1]]
    units: list[list[Element]] = []
    paged = any(e.page is not None for e in rows)
    for e in rows:
        if paged and units and units[-1][-1].page == e.page:
            units[-1].append(e)
        else:
            units.append([e])
    packed: list[list[Element]] = []
    used = 0
    for unit in units:
        cost = sum(estimate(e.text) for e in unit)
        full = used >= SECTION_TARGET or used + cost > SECTION_LIMIT if paged else used + cost > SECTION_TARGET
        if not packed or full:
            packed.append([])
            used = 0
        packed[-1] += unit
        used += cost
    return [(None, p) for p in packed]


_SENTENCE_END, _BLANK = re.compile(r"[。！？；.!?;\n]"), re.compile(r"\s")


def _atoms(text: str, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that cut a text into parts of at most the capacity, and the tokens of each part.

    Offsets are of three classes, sentence ends, borders of words and all characters; those of a finer class count only
    within parts that the coarser ones leave too large. Tokens of a part are a difference of token numbers at its offsets.
    """
    starts = np.fromiter((m.start() for m in _RUNS.finditer(text)), np.int64)
    blanks = np.fromiter((m.start() for m in _BLANK.finditer(text)), np.int64)
    edges = np.unique(np.concatenate([[0, len(text)], np.fromiter((m.end() for m in _SENTENCE_END.finditer(text)), np.int64)]))
    for finer in (np.concatenate([blanks, blanks + 1]), np.arange(len(text))):
        large = np.append(np.diff(np.searchsorted(starts, edges)) > capacity, False)
        edges = np.union1d(edges, finer[large[np.searchsorted(edges, finer, side="right") - 1]])
    cost = np.diff(np.searchsorted(starts, edges))
    # a character alone is a token, also one from the middle of a run
    single = np.diff(edges) == 1
    cost[single] = ~np.isin(edges[:-1][single], blanks)
    return edges, cost


def pieces(text: str, capacity: int) -> list[str]:
    """A text in pieces of at most the capacity: as many of its parts as fit, joined by blanks, from each piece on anew."""
    edges, cost = _atoms(text, capacity)
    parts = [text[a:z].strip(_STRIP) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    kept = [k for k, part in enumerate(parts) if part]
    total = np.cumsum(cost[kept])
    out: list[str] = []
    at, before = 0, 0
    while at < len(kept):
        end = max(at + 1, int(np.searchsorted(total, before + capacity, side="right")))
        out.append(" ".join(parts[k] for k in kept[at:end]))
        at, before = end, int(total[end - 1])
    return out


def _tail(text: str, tokens: int) -> str:
    """The shortest end of a text that is worth the tokens, or all of it."""
    low, high = 0, len(text)
    while low < high:  # the estimate of an end does not grow as the end gets shorter
        mid = (low + high + 1) // 2
        if estimate(text[mid:]) >= tokens:
            low = mid
        else:
            high = mid - 1
    return text[low:]


def split_long(element: Element, capacity: int) -> list[Element]:
    """Parts of a narrative or table: table rows under a repeated header, or pieces with an overlap before them."""
    rows = element.text.split("\n")
    if element.type == "TABLE" and len(rows) > 1:
        parts = [[rows[0]]]
        for row in rows[1:]:
            if len(parts[-1]) > 1 and estimate("\n".join([*parts[-1], row])) > capacity:
                parts.append([rows[0]])
            parts[-1].append(row)
        return [replace(element, text="\n".join(p)) for p in parts]
    cut = pieces(element.text, max(1, capacity - OVERLAP))
    kind = "NARRATIVE" if element.type == "TABLE" else element.type
    return [replace(element, type=kind, text=p if k == 0 else f"{_tail(cut[k - 1], OVERLAP)}\n{p}") for k, p in enumerate(cut)]


def _draft(prefix: str, elements: list[Element]) -> Chunk:
    text = "\n\n".join(e.text for e in elements)
    start, end = _page_range(elements)
    locators = list(dict.fromkeys(e.locator for e in elements if e.locator is not None))
    return Chunk(text, start, end, ",".join(locators) if locators else None, estimate(f"{prefix}\n{text}" if prefix.strip() else text))


def _merged(prefix: str, a: Chunk, b: Chunk) -> Chunk:
    text = f"{a.text}\n\n{b.text}"
    names = [x for part in (a.locator, b.locator) for x in (part or "").split(",") if x.strip()]
    starts = [x for x in (a.page_start, b.page_start) if x is not None]
    ends = [x for x in (a.page_end, b.page_end) if x is not None]
    return Chunk(text, min(starts, default=None), max(ends, default=None), ",".join(dict.fromkeys(names)) or None, estimate(f"{prefix}\n{text}" if prefix.strip() else text))


def chunk_section(prefix: str, elements: list[Element]) -> list[Chunk]:
    """Chunks of a section: packed to TARGET, never over HARD_LIMIT unless an element cannot be split."""
    fixed = estimate(prefix)
    drafts: list[Chunk] = []
    open_: list[Element] = []
    used = fixed

    def close() -> None:
        nonlocal used
        if open_:
            drafts.append(_draft(prefix, list(open_)))
            open_.clear()
        used = fixed

    for raw in elements:
        e = replace(raw, text=clean(raw.text))
        if not e.text:
            continue
        cost = estimate(e.text)
        over = fixed + cost > HARD_LIMIT
        if e.type == "TABLE" or (over and e.type == "NARRATIVE"):
            close()
            drafts += [_draft(prefix, [x]) for x in (split_long(e, HARD_LIMIT - fixed) if over else [e])]
            continue
        if open_ and used + cost > TARGET:
            close()
        open_.append(e)
        used += cost
    close()
    merged: list[Chunk] = []
    for c in drafts:
        if merged and min(merged[-1].tokens, c.tokens) < SHORT and merged[-1].locator != c.locator:
            both = _merged(prefix, merged[-1], c)
            if both.tokens <= HARD_LIMIT:
                merged[-1] = both
                continue
        merged.append(c)
    return merged


CHUNK_SCHEMA = "doc_id long, section int, ordinal int, title_path string, text string, page_start int, page_end int, locator string, tokens int, over_limit boolean"


def chunk_documents(files: DataFrame) -> DataFrame:
    """files (doc_id, file_name, elements) -> chunks with their section and a number within the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, name, items in zip(pdf["doc_id"], pdf["file_name"], pdf["elements"], strict=True):
                whole = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else int(x)
                elements = [Element(i["type"], i["text"], whole(i["page"]), i["locator"], whole(i["ordinal"]), whole(i["heading_level"]), i["heading_confidence"]) for i in ([] if items is None else items)]
                shown = clean(name)
                dot = shown.rfind(".")
                shown = shown[:dot] if dot > 0 else shown
                n = 0
                for k, (path, body) in enumerate(plan_sections(elements), 1):
                    prefix = "\n".join(x for x in (shown, clean(path)) if x)
                    for c in chunk_section(prefix, body):
                        n += 1
                        rows.append((doc_id, k, n, path, c.text, c.page_start, c.page_end, c.locator, c.tokens, c.tokens > HARD_LIMIT))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])
            yield out.astype({"page_start": "Int32", "page_end": "Int32"})

    return files.select("doc_id", "file_name", "elements").mapInPandas(run, CHUNK_SCHEMA)


def parse_quality(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: chunks, sections, mean tokens (rounded) and chunks of under 100 tokens; zeros where there is none."""
    found = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"), F.round(F.avg("tokens")).cast("long").alias("average_tokens"), F.sum((F.col("tokens") < 100).cast("long")).alias("short_chunks"))
    return files.select("doc_id").join(found, "doc_id", "left").na.fill(0)
