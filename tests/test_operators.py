"""Retrieval, access, pipeline and streaming rules on small rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access as A
from tessera.operators import embedding as M
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.operators import uploads as U
from tessera.streaming import tasks as Q


def test_fusion_ties_and_limits(spark):
    keyword = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank long")
    vector = spark.createDataFrame([(1, 20, 1), (1, 11, 2)], "query_id long, chunk_id long, rank long")
    rows = R.fuse(keyword, vector, 1.0, 1.0, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [11, 10, 20]
    assert R.fuse(keyword, vector, 1.0, 1.0, 0).count() == 0
    with pytest.raises(ValueError):
        R.fuse(keyword, vector, 0.0, 0.0, 5)


def test_rerank_only_when_there_is_a_choice(spark):
    hits = spark.createDataFrame([(1, 1, 1, "q", "aaa"), (1, 2, 2, "q", "b"), (2, 3, 1, "q", "zz")], "query_id long, chunk_id long, rank long, query_text string, text string")
    score = lambda q, t: -F.length(t).cast("double")
    assert {(r.query_id, r.chunk_id) for r in R.rerank(hits, 1, score).collect()} == {(1, 2), (2, 3)}
    assert {(r.query_id, r.chunk_id) for r in R.rerank(hits, 1, None).collect()} == {(1, 1), (2, 3)}


def test_budget_skips_and_goes_on(spark):
    hits = spark.createDataFrame([(1, 1, 7, 5, 3000)], "query_id long, rank long, section_id long, ordinal long, tokens long")
    around = spark.createDataFrame([(1, 1, 7, 4, 600), (1, 1, 7, 6, 400)], "query_id long, hit_rank long, section_id long, ordinal long, tokens long")
    assert [r.ordinal for r in R.within_budget(hits, around).collect()] == [6]


def test_metrics_credit_each_document_once(spark):
    run = spark.createDataFrame([("m", 1, d, k) for k, d in enumerate([9, 1, 1, 2, 8], 1)], "method string, query_id long, chunk_id long, rank long")
    qrels = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "query_id long, chunk_id long")
    rows = {r.query_id: r for r in E.query_metrics(run, qrels).collect()}
    assert rows[1].hit1 == 0 and rows[1].hit3 == 1 and rows[1].recall5 == 1 and rows[1].precision5 == pytest.approx(0.4) and rows[1].mrr10 == 0.5
    assert rows[2].mrr10 == 0 and rows[2].ndcg10 == 0


def test_cycles_end(spark):
    tags = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "tag_id string, parent_tag string")
    assert A.ancestors(tags).where("tag_id = 'a'").count() == 2
    assert A.tag_tree(tags).count() == 1


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert M.invalid_vectors(M.embed_chunks(rows, M.hashing_embedder(8), 8), 8).count() == 0
    with pytest.raises(Exception, match="dimension"):
        M.embed_chunks(rows, M.hashing_embedder(4), 8).collect()


def test_terminal_states_do_not_regress(spark):
    rows = [(1, "2024-01-01", 1, "READY"), (1, "2024-01-02", 2, "FAILED"), (2, "2024-01-01", 3, "FAILED"), (2, "2024-01-02", 4, "PARSING")]
    got = {r.file_id: (r.status, r.late_failures) for r in U.final_status(spark.createDataFrame(rows, "file_id long, at string, event_id long, status string")).collect()}
    assert got == {1: ("READY", 1), 2: ("PARSING", 0)}


def test_part_plan(spark):
    mib = 1024 * 1024
    plan = U.part_plan(spark.createDataFrame([(1, 20 * mib, None), (2, 20 * mib, 1), (3, 400_000 * mib, None)], "file_id long, total_size long, requested long"))
    got = {r.file_id: (r.part_size // mib, r.parts, r.last_part // mib) for r in plan.collect()}
    assert got == {1: (16, 2, 4), 2: (5, 4, 5), 3: (40, 10_000, 40)}


def test_clean_is_nfkc_first(spark):
    row = spark.createDataFrame([("（一）第二章｜a  b\r\n\r\n\n c…\x07",)], "t string").select(T.clean(F.col("t"))).first()
    assert row[0] == "(一)第二章|a b\n\nc..."


def test_task_stream(spark, tmp_path):
    rows = [(1, 1, "ok"), (2, 2, "reset"), (3, 2, "reset"), (3, 2, "reset"), (4, 2, "reset"), (5, 2, "reset"), (6, 2, "reset"), (7, 3, "fatal"), (8, 1, "reset"), (9, 4, "reset"), (9, 4, "reset"), (9, 4, "ok")]
    (tmp_path / "in").mkdir()
    deliveries = [0] * 10 + [0, 1]  # event 9 comes twice, and is tried again later under its own id
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"event_id": e, "delivery": d, "file_id": f, "at": f"2024-01-01T00:00:{e + d:02d}", "outcome": o}) for (e, f, o), d in zip(rows, deliveries, strict=True)))
    (tmp_path / "in/b.json").write_text(json.dumps({"event_id": 10, "delivery": 0, "file_id": 5, "at": "2020-01-01T00:00:00", "outcome": "ok"}))  # years late
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    steps = Q.attempts(Q.task_stream(spark, str(tmp_path / "in")))
    Q.write_steps(steps, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.event_id, r.action, r.delay_s) for r in spark.read.parquet(str(tmp_path / "out/steps")).collect()}
    assert got == {(1, "DONE", 0), (8, "IGNORE", 0), (2, "RETRY", 1), (3, "RETRY", 2), (4, "RETRY", 4), (5, "RETRY", 8), (6, "DEAD_LETTER", 0), (7, "DEAD_LETTER", 0), (9, "RETRY", 1), (9, "DONE", 0), (10, "DONE", 0)}


def test_replacement_is_by_document(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    Q.replace_documents(rows((1, "a"), (1, "b"), (2, "c")), path, 2)
    Q.replace_documents(rows((1, "new"), (3, "d")), path, 2)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "c"), (3, "d")]


def test_preview_shows_lines_that_begin_in_the_limit(spark):
    rows = spark.createDataFrame([("a.txt", "ab\r\ncd\n"), ("b.md", "x" * 30 + "\nrest"), ("c.txt", ""), ("d.txt", None), ("e.XLSX", "z")], "name string, text string")
    got = [r[0] for r in rows.select(T.preview(F.col("name"), F.col("text"), F.lit(10), F.lit("now"), 20)).collect()]
    assert got[:4] == ["ab\ncd\n", "x" * 30 + "\n\n" + T.PREVIEW_CUT, "", ""]
    assert got[4].startswith("文件名: e.XLSX\n文件大小: 10 B\n文件类型: XLSX\n上传时间: now")


def test_rerank_answers_fall_back(spark):
    hits = spark.createDataFrame([(q, r, q * 10 + r) for q in (1, 2, 3) for r in (1, 2, 3)] + [(4, 1, 41)], "query_id long, rank long, chunk_id long")
    answers = [(1, 0, 2, 0.5), (1, 1, 0, 0.9), (1, 2, 2, 1.0), (2, 0, 7, 1.0), (2, 1, 0, 0.1), (2, 2, 1, 0.2), (3, 0, 1, 0.4), (4, 0, 0, 1.0)]
    rows = R.rerank_by_answers(hits, spark.createDataFrame(answers, "query_id long, seq long, position long, score double"), 2)
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {1: [(11, 0.9), (13, 0.5)], 2: [(21, None), (22, None)], 3: [(31, None), (32, None)], 4: [(41, None)]}


def test_report_is_json(spark, tmp_path):
    E.write_report(spark.createDataFrame([("bm25", 0.5)], "method string, mrr10 double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).collect()[0].asDict() == {"method": "bm25", "mrr10": 0.5}


def test_bm25_equals_a_loop(spark):
    texts = {1: "a b b c", 2: "b", 3: None, 4: "", 5: "A-c d d d"}
    asked = {7: "b a", 8: "d d zzz", 9: "", 10: None}
    got = {(r.query_id, r.chunk_id): r.score for r in R.bm25(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id long, query_text string")).collect()}
    words = {k: (t or "").lower().replace("-", " ").split() for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, text in asked.items():
        for term in set((text or "").split()):
            df = sum(term in w for w in words.values())
            for k, w in words.items():
                if term in w:
                    tf, idf = w.count(term), math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
                    want[q, k] = want.get((q, k), 0) + idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert got == pytest.approx(want, abs=1e-8)


def test_deep_tags_are_followed_to_the_end(spark):
    from tessera.operators import access as A

    tags = spark.createDataFrame([(f"t{k}", f"t{k - 1}" if k else None) for k in range(104)], "tag_id string, parent_tag string")
    assert A.tag_tree(tags).agg(F.max("depth")).first()[0] == 103


def test_only_the_holder_of_a_lease_settles_an_event(spark):
    events = [(1, "PUBLISHING", "a", 0), (2, "PUBLISHING", "b", 1), (3, "PUBLISHING", "c", 2), (4, "PUBLISHING", "new", 0), (5, "PENDING", "e", 0)]
    rows = spark.createDataFrame(events, "event_id long, status string, lock_token string, retry_count int").withColumns({"locked_until": F.lit("2024-01-01").cast("timestamp"), "next_retry_at": F.lit(None).cast("timestamp"), "last_error": F.lit("old")})
    outcomes = spark.createDataFrame([(1, "a", "PUBLISHED", 0, None), (2, "b", "RESCHEDULE", 2, " "), (3, "c", "DEAD", 3, "x" * 3000), (4, "lost", "PUBLISHED", 0, None), (5, "e", "PUBLISHED", 0, None)], "event_id long, lock_token string, action string, retry_count int, error string").withColumn("next_retry_at", F.lit("2024-01-02").cast("timestamp"))
    got = {r.event_id: r for r in U.settle(rows, outcomes, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()}
    assert {k: (r.status, r.retry_count, r.settled) for k, r in got.items()} == {1: ("PUBLISHED", 0, True), 2: ("PENDING", 2, True), 3: ("DEAD", 3, True), 4: ("PUBLISHING", 0, False), 5: ("PENDING", 0, False)}
    assert got[2].last_error == U.UNKNOWN_ERROR and len(got[3].last_error) == 2000 and got[1].last_error is None and got[4].lock_token == "new"


def test_sessions_of_uploads_fold_their_events(spark):
    told = {1: "init complete complete abort", 2: "init abort init", 3: "complete init", 4: "init init abort complete"}
    rows = [(f, k, k, a) for f, t in told.items() for k, a in enumerate(t.split())]
    got = {r.file_id: tuple(r)[1:] for r in U.session_states(spark.createDataFrame(rows, "file_id long, at long, event_id long, action string")).collect()}
    assert got == {1: ("COMPLETED", 0, 1), 2: ("UPLOADING", 1, 0), 3: ("UPLOADING", 0, 1), 4: ("ABORTED", 0, 1)}


def test_questions_are_rewritten_or_left(spark):
    from tessera.operators import conversation as C

    rows = spark.createDataFrame([("那它呢", ["a"]), ("那它呢", []), ("A full question that needs nothing", ["a"]), (None, None)], "question string, history array<string>")
    got = [tuple(r)[2:] for r in C.rewritten(rows, lambda q, h: F.lit('"annual leave"')).collect()]
    assert got == [("annual leave", True), ("那它呢", False), ("A full question that needs nothing", False), ("", False)]
    assert [r.query for r in C.rewritten(rows, lambda q, h: F.lit(" ")).collect()][0] == "那它呢"


def test_sessions_come_and_go(spark):
    from tessera.operators import conversation as C

    rows = [(1, "a", 1, "create"), (1, "a", 9, "touch"), (1, "b", 2, "create"), (1, "c", 3, "create"), (1, "c", 4, "delete"), (1, "d", 5, "delete"), (1, "d", 6, "create"), (2, "e", 1, "touch")]
    got = C.sessions(spark.createDataFrame(rows, "user_id long, session_id string, at long, action string"), 2).orderBy(F.desc("updated")).collect()
    assert [(r.session_id, r.created, r.updated) for r in got] == [("a", 1, 9), ("d", 6, 6)]


def test_holders_of_short_and_cut_passages(spark):
    from tessera.operators import evaluation as E

    texts = spark.createDataFrame([(1, "say: one two  three four five six!"), (2, "xone two three four fivey"), (3, "two"), (4, None), (5, "one two three four")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four five"), (2, "two"), (3, "ne two three four fi"), (4, "two  three four five six")], "query_id long, passage string")
    got = {(r.query_id, r.chunk_id) for r in E.holders(texts, asked).collect()}
    assert got == {(1, 2), (2, 1), (2, 2), (2, 3), (2, 5), (3, 2), (4, 1)}


def test_human_size_ties_and_nulls(spark):
    """The SQL of human_size rounds ties up in KB and GB and to an even digit in MB; a null size shows nothing."""
    sizes = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 1024**2 * 5 // 4, 1024**2 * 7 // 4, 1536**2, 1024**3 - 1, 1024**3 * 5 // 4, 1024**3 * 7 // 4, None]
    rows = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").select("k", T.human_size(F.col("size")).alias("shown")).orderBy("k").collect()
    assert [r.shown for r in rows] == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1.8 KB", "1024.0 KB", "1.0 MB", "1.2 MB", "1.8 MB", "2.2 MB", "1024.0 MB", "1.3 GB", "1.8 GB", None]


def test_visible_pairs_once_and_without_comparing_pairs(spark):
    """A file that is public, own and tagged is one pair; repeated rows of files or users repeat it; no pair is compared."""
    tags = spark.createDataFrame([("DEFAULT", None), ("r", "DEFAULT"), ("n", "r")], "tag_id string, parent_tag string")
    users = spark.createDataFrame([(1, "n,n"), (2, "x"), (None, "n"), (3, ""), (3, "")], "user_id long, org_tags string")
    files = spark.createDataFrame(
        [(10, 1, "n", True), (11, 1, "n", False), (12, 2, "n", False), (13, 2, None, False), (14, None, "r", None), (15, 9, None, None), (15, 9, "DEFAULT", None), (16, 3, "x", False), (16, 3, "x", False)],
        "file_id long, owner_id long, org_tag string, is_public boolean",
    )
    got = A.visible(files, users, tags)
    want = [(None, 10), (1, 10), (2, 10), (3, 10), (3, 10), (1, 11), (1, 12), (2, 12), (2, 13), (1, 14), (1, 15), (2, 15), (3, 15), (3, 15), (2, 16), (2, 16), *[(3, 16)] * 4]
    key = lambda r: (r[1], r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    plan = got._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
