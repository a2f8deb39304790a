"""Sections, chunks and readers."""

import io
import random
import re
import zipfile

import pytest

from tessera.operators import documents as D
from tessera.operators.documents import Element
from tessera.sources import files as G


def narrative(text, **more):
    return Element("NARRATIVE", text, **more)


def title(text, level, confidence="HIGH", **more):
    return Element("TITLE", text, heading_level=level, heading_confidence=confidence, **more)


def test_title_paths_reset_deeper_levels():
    rows = [title("第一章 总则", 1, ordinal=1), narrative("a", ordinal=2), title("1.1 适用范围", 2, ordinal=3), narrative("b", ordinal=4), title("第二章 考勤", 1, ordinal=5), narrative("c", ordinal=6)]
    assert [p for p, _ in D.plan_sections(rows)] == ["第一章 总则", "第一章 总则｜1.1 适用范围", "第二章 考勤"]


def test_low_titles_are_body_text():
    (path, body), = D.plan_sections([title("第一条", 3, "LOW", ordinal=1), narrative("x", ordinal=2)])
    assert path is None and [e.text for e in body] == ["第一条", "x"]


def test_headings_without_a_body_give_no_section():
    assert D.plan_sections([title("a", 1, ordinal=1)]) == []


def test_pages_are_merged_up_to_the_limit():
    pages = [narrative("字" * 1000, page=k, ordinal=k) for k in (1, 2, 3)]
    assert [[e.page for e in body] for _, body in D.plan_sections(pages)] == [[1, 2], [3]]


def test_natural_elements_are_merged_up_to_the_target():
    rows = [narrative("字" * 1000, ordinal=k) for k in (1, 2, 3)]
    assert [len(body) for _, body in D.plan_sections(rows)] == [1, 1, 1]


def test_long_narrative_is_split_with_overlap():
    body = "".join(chr(0x4E00 + k) for k in range(1200))
    chunks = D.chunk_section("手册", [narrative(body, locator="p")])
    assert len(chunks) > 2 and all(c.tokens <= D.HARD_LIMIT for c in chunks)
    joined = ["".join(c.text.split()) for c in chunks]
    at = 0
    for text in joined:  # every chunk goes on where the last one ended, some characters earlier
        start = body.index(text[:10])
        assert start <= at
        at = max(at, start + len(text))
    assert at == len(body)


def test_tables_stand_alone_and_short_neighbours_merge():
    rows = [narrative("before", locator="a"), Element("TABLE", "h | i\n1 | 2", locator="t"), narrative("after", locator="b")]
    (chunk,) = D.chunk_section("", rows)
    assert chunk.text == "before\n\nh | i\n1 | 2\n\nafter" and chunk.locator == "a,t,b"
    same = [Element("LIST", "x " * 300, locator="list"), Element("LIST", "y", locator="list"), Element("LIST", "z " * 400, locator="list")]
    assert len(D.chunk_section("", same)) == 2


def test_table_rows_repeat_the_header():
    table = Element("TABLE", "\n".join(["head"] + [f"row {k} " + "字" * 50 for k in range(30)]), locator="t")
    chunks = D.chunk_section("", [table])
    assert len(chunks) > 1 and all(c.text.startswith("head\nrow") for c in chunks)
    assert sum(c.text.count("row ") for c in chunks) == 30


def test_chunk_invariants(spark):
    from tessera.plans import documents as P

    for name in ("chunks", "fallback_sections"):
        rows = getattr(P, name)(spark, "/root/testdata/sf0.001").collect()
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r.ordinal)
            assert r.tokens <= D.HARD_LIMIT or r.over_limit
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_markdown():
    text = "intro\n# One\nbody\n- item\n1. first\n```\n  code\n```\ntail\n```\nopen"
    got = [(e.type, e.text) for e in G.read_markdown(text.encode())]
    assert got == [("NARRATIVE", "intro"), ("TITLE", "One"), ("NARRATIVE", "body"), ("LIST", "- item"), ("LIST", "1. first"), ("CODE", "code"), ("NARRATIVE", "tail"), ("CODE", "open")]


def test_html():
    page = "<title>no</title><script>var t='</p>';</script><nav><ul><li><a>one</a></li></ul></nav><h1>T&amp;x</h1><p>a <b>b<br>c<p>d</b></p><li><p>in</p></li><table><tr><td>1</td><td>2</td></tr></table><pre>q</pre>"
    got = [(e.type, e.text) for e in G.read_html(page.encode())]
    assert got == [("LIST", "one"), ("TITLE", "T&x"), ("NARRATIVE", "a b c"), ("NARRATIVE", "d"), ("LIST", "in"), ("NARRATIVE", "in"), ("TABLE", "1 2"), ("CODE", "q")]


def test_page_elements():
    pages = ["目 录\n第一章 ......... 1\n第二章 ......... 3", "17 / 37\n1. Attendance Policy\n(1) Sign offer letter\n1.1.1 Deep numbered item\n\nnext"]
    got = [(e.type, e.text, e.page) for e in G.page_elements(pages)]
    assert got == [("TITLE", "1. Attendance Policy", 2), ("NARRATIVE", "(1) Sign offer letter\n1.1.1 Deep numbered item", 2), ("NARRATIVE", "next", 2)]
    outlined = G.page_elements(["1. Attendance Policy\nbody"], {1: [(1, "1. Attendance Policy")]})
    assert [(e.type, e.heading_confidence) for e in outlined] == [("TITLE", "HIGH"), ("NARRATIVE", None)]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="w"'


def test_docx(spark):
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in (("部门", "人数"), ("HR", ""), ("", ""))) + "</w:tbl>"
    document = f'<w:document {W}><w:body>{p("Intro", "Heading2")}{p("text")}{p("第一章 总则")}{table}{p("出差申请单")}</w:body></w:document>'
    content = _zip({"word/document.xml": document})
    got = [(e.type, e.text, e.heading_level) for e in G.read_docx(content)]
    assert got == [("TITLE", "Intro", 2), ("NARRATIVE", "text", None), ("TITLE", "第一章 总则", 1), ("TABLE", "部门 | 人数\nHR", None)]
    rows = G.parse_files(spark.createDataFrame([(1, "a.docx", bytearray(content)), (2, "b.docx", bytearray(b"junk")), (3, "c.pdf", bytearray(b"%PDF"))], "doc_id long, file_name string, content binary")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(by[1].elements) == 4 and by[2].error.startswith("BadZipFile") and by[3].error


def test_pptx_and_xlsx():
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:t>one</a:t></a:p><a:p><a:t>two</a:t></a:p></p:sp></p:sld>'
    got = [(e.type, e.text, e.page) for e in G.read_pptx(_zip({"ppt/slides/slide2.xml": slide, "ppt/slides/slide10.xml": "<x/>"}))]
    assert got == [("TITLE", "Title", 1), ("NARRATIVE", "one\ntwo", 1)]
    book = _zip({
        "xl/workbook.xml": '<workbook><sheets><sheet name="人员"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><row><c t="s"><v>0</v></c><c/><c><v>3</v></c></row><row><c/></row></worksheet>',
    })
    assert [(e.type, e.text) for e in G.read_xlsx(book)] == [("TITLE", "工作表：人员"), ("TABLE", "name |  | 3")]


def test_claims_and_corpus(spark, tmp_path):
    (tmp_path / "claims.jsonl").write_text('{"id": 1, "claim": "a", "evidence": {"d1": []}}\n{"id": 2, "claim": "b", "evidence": {}}\n')
    (tmp_path / "corpus.jsonl").write_text('{"doc_id": "d1", "title": "old", "abstract": []}\n\nbroken\n{"doc_id": "d1", "title": "new", "abstract": ["x"]}\n')
    claims = G.read_claims(spark, str(tmp_path / "claims.jsonl"))
    assert [(r.id, r.relevant) for r in claims.collect()] == [(1, ["d1"])]
    with pytest.raises(ValueError):
        G.read_claims(spark, str(tmp_path / "claims.jsonl"), 2)
    rows, bad = G.read_corpus(spark, str(tmp_path / "corpus.jsonl"))
    assert [(r.doc_id, r.title) for r in rows.collect()] == [("d1", "new")] and bad == 1


def test_pieces_take_as_many_parts_as_fit():
    rng = random.Random(7)
    parts = ["a", "bc1", "漢", "字", "。", " ", "  ", "\n", ".", "!", "x" * 9, "é", "？", "-"]
    for _ in range(2000):
        text, capacity = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50))), rng.randint(1, 12)
        cut = D.pieces(text, capacity)
        atoms = []
        for sentence in re.findall(r"[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$", text):
            words = [sentence.strip()] if D.estimate(sentence) <= capacity else sentence.split()
            for word in words:
                atoms += [word] if D.estimate(word) <= capacity else list(word)
        want, used = [], 0
        for atom in filter(None, atoms):
            cost = D.estimate(atom)
            if want and used + cost <= capacity:
                want[-1], used = f"{want[-1]} {atom}", used + cost
            else:
                want, used = [*want, atom], cost
        assert cut == want and all(D.estimate(p) <= capacity for p in cut)
