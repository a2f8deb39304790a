"""Tables of document parts that are replaced by document in one step."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions as V


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def _seen(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_versions_replace_delete_and_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.commits(spark, path) == []
    with pytest.raises(ValueError):
        V.read(spark, path)
    assert V.replace(_rows(spark, (1, "a"), (1, "a"), (2, "c"), (None, "n"), (4, None)), path) == 1
    first = V.read(spark, path)
    assert V.replace(_rows(spark, (1, "new"), (3, "d"), (None, "m")), path, ids=_rows(spark, (4, "")).select("doc_id")) == 2
    assert V.replace(_rows(spark).limit(0), path) == 3
    want = [(1, "new"), (2, "c"), (3, "d"), (None, "m")]
    assert _seen(V.read(spark, path)) == sorted(want, key=str)
    old = sorted([(1, "a"), (1, "a"), (2, "c"), (None, "n"), (4, None)], key=str)
    assert _seen(first) == old and _seen(V.read(spark, path, 1)) == old
    assert {(r.doc_id, r.v) for r in V.read(spark, path, name="v").collect()} == {(1, 2), (2, 1), (3, 2), (None, 2)}
    with pytest.raises(ValueError):
        V.read(spark, path, 9)
    with pytest.raises(ValueError):
        V.replace(_rows(spark, (1, "x")).withColumn("more", F.lit(1)), path)


def test_lost_writers_are_not_seen_and_tokens_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    V.replace(_rows(spark, (1, "a")), path, token="s:0")
    V._stage(_rows(spark, (1, "lost")), path, None, None, False)
    assert _seen(V.read(spark, path)) == [(1, "a")]
    assert V.replace(_rows(spark, (1, "again")), path, token="s:0") == 1
    # a replay that staged its part before it could see the first commit
    assert V._commit(spark, path, V._stage(_rows(spark, (1, "again")), path, None, "s:0", False)) == 1
    assert _seen(V.read(spark, path)) == [(1, "a")] and len(V.commits(spark, path)) == 1


def test_writers_that_meet_both_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.replace(_rows(spark, (1, "a"), (2, "b")), path)
    entry = V._stage(_rows(spark, (1, "late")), path, None, None, False)
    real, stale = V.commits, V.commits(spark, path)
    V.replace(_rows(spark, (1, "early"), (2, "early")), path)
    answers = [stale]
    monkeypatch.setattr(V, "commits", lambda s, t: answers.pop() if answers else real(s, t))
    assert V._commit(spark, path, entry) == 3
    assert _seen(V.read(spark, path)) == [(1, "late"), (2, "early")]
    assert not [p for p in (tmp_path / "t/commits").iterdir() if not p.name.endswith(".crc") and not p.name.isdigit()]


def test_compaction_keeps_rows_and_gives_way(spark, tmp_path):
    path = str(tmp_path / "t")
    V.replace(_rows(spark, (1, "a"), (2, "b"), (None, "n")), path)
    V.replace(_rows(spark, (2, "c"), (2, "c")), path)
    want = _seen(V.read(spark, path))
    late = V._stage(V.read(spark, path), path, None, None, True)
    assert V.compact(spark, path) == 3 and _seen(V.read(spark, path)) == want
    assert V._commit(spark, path, late, 2) is None
    V.replace(_rows(spark, (1, "z")), path)
    assert _seen(V.read(spark, path)) == sorted([(1, "z"), (2, "c"), (2, "c"), (None, "n")], key=str)
    assert _seen(V.read(spark, path, 2)) == want
    assert V.clean(spark, path, 3) == 4 and _seen(V.read(spark, path, 3)) == want
    assert len(_seen(V.read(spark, path))) == 4


def test_streams_replace_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "in").mkdir()

    def run(checkpoint):
        rows = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        V.write_stream(rows, path, str(tmp_path / checkpoint), "chunks").awaitTermination(60)

    (tmp_path / "in/a.json").write_text('{"doc_id": 1, "text": "a"}\n{"doc_id": 2, "text": "b"}\n')
    run("ck")
    (tmp_path / "in/b.json").write_text('{"doc_id": 1, "text": "c"}\n')
    run("ck")
    assert _seen(V.read(spark, path)) == [(1, "c"), (2, "b")] and len(V.commits(spark, path)) == 2
    run("lost")  # a checkpoint that is lost replays both batches: their tokens are known
    assert _seen(V.read(spark, path)) == [(1, "c"), (2, "b")] and len(V.commits(spark, path)) == 2
