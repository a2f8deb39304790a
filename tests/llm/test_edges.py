"""Every operator on awkward tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import avi, classifier, langid, mixing, pii, quality, simhash, spm, tokens, warc
from tessera.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack " * 3
ROWS = [
    (1, PROSE + "mail me at joe@example.org or +1 (743) 555-3824", "en", "a", 0),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "de", None, 3),
    (5, PROSE, "en", "a", 0),
    (5, PROSE, "en", "a", 0),
    (None, "no id here", "fr", "b", 9),
    (7, "x" * 50_000 + "1" * 50_000 + "@" * 1000, "en", "b", 101_000),
    (8, "漢字 🙂 \x00 é́ ▁", "zh", "a", 9),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(awkward):
    """Extra columns that are named like the operators' own."""
    names = ["size", "_key", "fp", "_row", "_new", "_hit", "_text", "part", "whole", "kept", "mask", "ids", "n_tokens", "score", "_g", "_salt"]
    return awkward.withColumns({n: F.lit(f"own-{n}") for n in names})


def test_mix(awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert [r.taken for r in rows if r.doc_id == 2] == [0]


def test_mixed_documents(clashing):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r["size"] == "own-size" and r["_row"] == "own-_row" and r.n_chars == len(r.text) for r in rows)


def test_pii(awkward, clashing):
    rows = {r.doc_id: r for r in pii.scan(awkward).collect()}
    assert (rows[1].n_email, rows[1].n_phone, rows[1].n_ip, rows[1].n_card) == (1, 1, 0, 0)
    assert rows[2].spans == rows[3].spans == ""
    out = pii.redacted(clashing)
    assert out.columns == clashing.columns
    new = {r.doc_id: r for r in out.collect()}
    assert new[1].text.endswith("mail me at [EMAIL] or [PHONE]") and new[1].n_chars == len(new[1].text)
    assert new[2].text is None and new[5].text == PROSE and new[5]["_new"] == "own-_new"


def test_simhash(awkward, clashing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[4].component_id == 2
    kept = simhash.one_per_class(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids.count(5) == 1 - (by[5].component_id != 5) and 3 not in ids and 4 not in ids


def test_quality(awkward, clashing):
    rows = quality.judge(awkward).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert quality.kept_documents(clashing).columns == clashing.columns


def test_classifier(awkward):
    labels = awkward.sparkSession.createDataFrame([(1, 1), (5, 1), (7, 0), (8, None)], "doc_id long, quality int")
    rows = classifier.classify(awkward.withColumn("held_out", F.lit(False)), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    none = classifier.classify(awkward.withColumn("held_out", F.lit(True)), labels).collect()
    assert {r.score for r in none} == {0.5}


def test_avi(awkward):
    rows = avi.media_round_trip(awkward).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].payload_bytes == 64 and by[2].n_bytes == 0 and by[2].media_sha256 == by[3].media_sha256
    assert by[7].n_bytes == 101_000


def test_tokens(awkward):
    rows = tokens.token_round_trip(awkward, tokenizer_file("word_bpe_49k.json")).collect()
    assert len(rows) == len(ROWS)
    assert sorted(r.start for r in rows)[0] == 0 and min(r.n_tokens for r in rows) == 1
    assert next(r for r in rows if r.doc_id is None).start == 0


def test_spm(awkward, clashing):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = spm.encode(awkward.select("doc_id", "text"), path).collect()
    assert [r.round_trip for r in rows if r.doc_id == 8] == [False]  # it holds the blank mark itself
    assert all(r.round_trip for r in rows if r.doc_id != 8)
    out = spm.encode(clashing, path)
    assert out.columns.count("ids") == 1 and out.count() == len(ROWS)
    back = {r.doc_id: r.text for r in spm.decode(out.select("doc_id", "ids"), path).collect()}
    assert back[5] == PROSE and back[2] == ""


def test_langid(awkward):
    model = langid.train(awkward.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    rows = langid.identify(awkward.select("doc_id", "text"), model).collect()
    assert len(rows) == len(ROWS)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "u\r\nWARC/1.1", None), (4, "", ""), (4, "", ""), (None, "n", "<p>n</p>"), (6, "http://a", "WARC/1.1\r\n\r\n\r\nContent-Length: 3")], "page_id long, url string, html string")
    rows = warc.archive_round_trip(pages.withColumn("_hash", F.lit("own"))).collect()
    assert len(rows) == 7
    by = {r.page_id: r for r in rows}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type) == ("revisit", 2, "response")
    assert by[3].record_type == "revisit" and by[3].refers_to == 4 and by[4].payload_bytes == 0
    assert by[6].payload_bytes == len("WARC/1.1\r\n\r\n\r\nContent-Length: 3")


@pytest.mark.parametrize(
    "run",
    [
        mixing.mix,
        mixing.mixed_documents,
        pii.scan,
        pii.redacted,
        simhash.near_duplicates,
        simhash.one_per_class,
        quality.judge,
        quality.kept_documents,
        avi.media_round_trip,
        lambda d: tokens.token_round_trip(d, tokenizer_file("word_bpe_49k.json")),
        lambda d: spm.encode(d, tokenizer_file("piece_bpe_32k.model")),
        lambda d: langid.identify(d.select("doc_id", "text"), langid.train(d.select("doc_id", "text", "lang"))),
        lambda d: classifier.classify(d.withColumn("held_out", F.lit(False)), d.select("doc_id", F.lit(1).alias("quality"))),
        lambda d: warc.archive_round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))),
    ],
)
def test_no_rows(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_stages(spark, awkward):
    docs = awkward
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = out
    docs.count()
