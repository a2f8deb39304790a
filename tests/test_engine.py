"""Ingest and search from end to end on a few files."""

import numpy as np
from pyspark.sql import functions as F

from tessera import engine
from tessera.operators import retrieval
from tessera.operators.embedding import hashing_embedder

FILES = [
    (1, "handbook.md", b"# Leave\nAnnual leave is ten days.\n## Sick leave\nSick leave needs a note.\n"),
    (2, "notes.txt", b"Travel costs are refunded.\n\nKeep the receipts."),
    (3, "movie.mp4", b""),
    (4, "empty.txt", b"  "),
    (5, "broken.docx", b"no archive"),
]


def test_ingest_and_search(spark):
    files = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in FILES], "doc_id long, file_name string, content binary")
    chunks, rejects = engine.ingest(files, hashing_embedder(16), 16)
    rows = {(r.doc_id, r.ordinal): r for r in chunks.collect()}
    assert rows[1, 1].title_path == "Leave" and rows[1, 2].title_path == "Leave｜Sick leave"
    assert {r.doc_id: r.reason.split(":")[0] for r in rejects.collect()} == {3: "unsupported", 4: "no section", 5: "BadZipFile"}
    table = chunks.select((F.col("doc_id") * 100 + F.col("ordinal")).alias("chunk_id"), "text", "vector", (F.col("doc_id") % 2).alias("owner_id"), F.lit(False).alias("is_public"), F.lit("T").alias("org_tag"))
    queries = spark.createDataFrame([(1, "sick note"), (2, "travel receipts")], "query_id long, query_text string")
    found = {(r.query_id, r["rank"]): r.chunk_id for r in engine.hybrid_search(table.drop("vector"), queries, 1).collect()}
    assert found == {(1, 1): 102, (2, 1): 201}
    who = spark.createDataFrame([(1, 0, ["T"]), (2, 1, [])], "query_id long, user_id long, tags array<string>")
    seen = engine.hybrid_search(table.drop("vector"), queries, 5, who).collect()
    assert {(r.query_id, r.chunk_id) for r in seen} == {(1, 102)}


def test_enriched_hits(spark):
    schema = "chunk_id long, section_id long, ordinal long, tokens long, text string, file_name string, title_path string, page_start int, page_end int"
    chunks = spark.createDataFrame([(k, 1, k, 10, f"text {k}", "a.md", "T", None, None) for k in range(1, 5)], schema)
    hits = spark.createDataFrame([(9, 1, 2)], "query_id long, rank long, chunk_id long")
    rows = engine.enrich(hits, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.is_hit) for r in rows] == [(2, True), (1, False), (3, False)]
    assert rows[0].source_label == "《a》｜T"
    context = engine.build_context(engine.enrich(hits, chunks)).first()
    assert context.sources == 3 and context.prompt.startswith("[来源#1]\n来源：《a》｜T\n文件：a.md\n标题路径：T\n正文：\ntext 2\n[/来源#1]\n\n")


def test_search_without_a_vector_service(spark):
    chunks = spark.createDataFrame([(1, "公司请假制度", [1.0, 0.0]), (2, "差旅报销", [0.0, 1.0])], "chunk_id long, text string, vector array<double>")
    asked = spark.createDataFrame([(7, "请假")], "query_id long, query_text string")

    def fails(queries):
        raise RuntimeError("no service")

    rows, step = engine.hybrid_search_or_less(chunks, asked, fails, 2, han=True)
    assert step == "text" and [(r.query_id, r.chunk_id) for r in rows.collect()] == [(7, 1)]
    rows, step = engine.hybrid_search_or_less(chunks, asked, lambda q: q.withColumn("vector", F.array(F.lit(0.0), F.lit(1.0))), 2, han=True)
    assert step == "hybrid" and [r.chunk_id for r in rows.orderBy("rank").collect()] == [1, 2]  # 0.1 / 61 + 0.9 / 62 is more than 0.9 / 61


def test_a_missing_or_odd_vector_concerns_its_own_query_only(spark):
    chunks = spark.createDataFrame([(1, "sick note", [1.0, 0.0]), (2, "travel note", [0.0, 1.0]), (3, "other", [1.0, 1.0, 1.0]), (4, "none", None), (5, "zero", [0.0, 0.0])], "chunk_id long, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "sick", [1.0, 0.1]), (2, "other", [0.5, 0.5, 0.5]), (3, "travel", None), (4, "x", []), (5, "x", [0.0, 0.0])], "query_id long, query_text string, vector array<double>")
    near = {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.knn(chunks, asked, 5).collect()}
    assert near == {(1, 1): 1, (1, 2): 2, (2, 3): 1}
    rows, step = engine.hybrid_search_or_less(chunks, asked.drop("vector"), lambda q: q.join(asked.select("query_id", "vector"), "query_id"), 1)
    assert step == "hybrid" and {(r.query_id, r.chunk_id) for r in rows.collect()} == {(1, 1), (2, 3), (3, 2)}


def test_a_search_that_fails_while_it_runs_gives_way(spark):
    chunks = spark.createDataFrame([(1, "sick note", [1.0, 0.0])], "chunk_id long, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "sick")], "query_id long, query_text string")
    broken = F.raise_error(F.lit("no vector")).cast("array<double>")
    rows, step = engine.hybrid_search_or_less(chunks.withColumn("vector", F.when(F.col("chunk_id") == 1, broken)), asked, lambda q: q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))), 1)
    assert step == "text" and [r.chunk_id for r in rows.collect()] == [1]
    who = spark.createDataFrame([(1, 1, ["T"])], "query_id long, user_id long, tags array<string>")
    owned = chunks.withColumns({"owner_id": F.lit(1), "is_public": F.lit(True), "org_tag": F.lit("T"), "text": F.when(F.col("chunk_id") == 1, F.raise_error(F.lit("no text")).cast("string"))})
    rows, step = engine.hybrid_search_or_less(owned, asked, lambda q: q, 1, who)
    assert step == "nothing" and rows.collect() == []


def test_neighbours_equal_brute_force_under_permissions(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (400, 4)).astype(float)
    tags = ["A", "B", "C"]
    rows = [(k, v.tolist(), int(k % 5), bool(k % 7 == 0), tags[k % 3]) for k, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, owner_id int, is_public boolean, org_tag string").repartition(3)
    asks = [(q, rng.integers(-3, 4, 4).astype(float).tolist(), q % 4, [tags[q % 3]] if q % 2 else []) for q in range(30)]
    queries = spark.createDataFrame(asks, "query_id long, vector array<double>, user_id int, tags array<string>")
    for permissions in (False, True):
        want = set()
        for q, v, user, own in asks:
            if not any(v):
                continue
            seen = [(k, np.array(x)) for k, x, owner, public, tag in rows if any(x) and (not permissions or public or owner == user or tag in own)]
            order = sorted((-round(float(x @ np.array(v) / np.linalg.norm(x) / np.linalg.norm(v)), 9), k) for k, x in seen)[:10]
            want |= {(q, k, n + 1) for n, (_, k) in enumerate(order)}
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.knn(chunks, queries, 10, permissions).collect()} == want
