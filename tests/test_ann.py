"""Neighbours by inverted lists and product codes against the exact way."""

import numpy as np
import pytest

from tessera import plans
from tessera.operators import ann, retrieval
from tessera.session import table

SCHEMA = "chunk_id long, vector array<double>, owner_id int, is_public boolean, org_tag string"


@pytest.fixture(scope="module")
def clustered(spark):
    """6,000 rows, half of them in one cluster, with odd dimensions, nulls and zeros among them; 40 queries."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (30, 24))
    which = np.where(rng.random(6000) < 0.5, 0, rng.integers(0, 30, 6000))
    x = centres[which] + rng.normal(0, 0.5, (6000, 24))
    rows = [(k, v.tolist(), k % 5, k % 7 == 0, "ABC"[k % 3]) for k, v in enumerate(x)]
    rows += [(9001, None, 1, True, "A"), (9002, [0.0] * 24, 1, True, "A"), (9003, [1.0, 2.0], 1, True, "A"), (9004, [2.0, 1.0], 1, True, "A"), (9005, [], 1, True, "A")]
    asks = [(q, (centres[q % 30] + rng.normal(0, 0.5, 24)).tolist(), q % 4, ["ABC"[q % 3]] if q % 2 else []) for q in range(40)]
    asks += [(90, [1.0, 2.0], 1, ["A"]), (91, None, 1, []), (92, [0.0] * 24, 1, [])]
    queries = spark.createDataFrame(asks, "query_id long, vector array<double>, user_id int, tags array<string>")
    return spark.createDataFrame(rows, SCHEMA).repartition(4), queries


def _found(rows):
    return {(r.query_id, r.chunk_id): r.score for r in rows.collect()}


@pytest.mark.parametrize("permissions", [False, True])
def test_most_neighbours_are_found_and_scores_are_exact(clustered, permissions):
    chunks, queries = clustered
    quantizer = ann.train(chunks, 50)
    assert 1 <= quantizer.probes < len(quantizer.centroids) / 2
    indexed = ann.index(chunks, quantizer)
    assert indexed.count() == chunks.count()
    got = _found(ann.search(indexed, quantizer, queries, 50, permissions))
    want = _found(retrieval.knn(chunks, queries, 50, permissions))
    both = got.keys() & want.keys()
    assert len(both) >= 0.9 * len(want) and len(got) == len(want)
    assert all(got[p] == pytest.approx(want[p], abs=2e-9) for p in both)
    assert {c for q, c in got if q == 90} == {9003, 9004} and not {q for q, _ in got} & {91, 92}


def test_all_lists_and_all_candidates_are_the_exact_way(clustered):
    chunks, queries = clustered
    quantizer = ann.train(chunks, 20, lists=8, target=1.0)
    whole = ann.Quantizer(quantizer.centroids, quantizer.parts, quantizer.books, len(quantizer.centroids))
    got = _found(ann.search(ann.index(chunks, whole), whole, queries, 20, widen=400))
    assert got.keys() == _found(retrieval.knn(chunks, queries, 20)).keys()


def test_blocks_and_cuts_change_nothing(clustered, monkeypatch):
    chunks, queries = clustered
    quantizer = ann.train(chunks, 20)
    indexed = ann.index(chunks, quantizer)
    want = _found(ann.search(indexed, quantizer, queries, 20))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 15)
    assert _found(ann.search(indexed, quantizer, queries, 20)) == want
    best = ann._Best(1, 2)
    monkeypatch.setattr(ann, "PENDING", 1)
    for at in range(6):
        best.see(np.array([0]), np.array([[float(at % 4)] * 2], np.float32), np.array([2 * at, 2 * at + 1]))
    best.cut()
    assert best.rows[0][2].tolist() == [6, 7]


def test_ties_repeats_and_nothing(spark):
    same = spark.createDataFrame([(k, [1.0, 0.0, 0.0], 1, True, "A") for k in range(40)] + [(1, [1.0, 0.0, 0.0], 1, True, "A")], SCHEMA)
    ask = spark.createDataFrame([(5, [2.0, 0.0, 0.0])], "query_id long, vector array<double>")
    quantizer = ann.train(same, 10)
    rows = ann.search(ann.index(same, quantizer), quantizer, ask, 10).collect()
    assert len(rows) == 10 and {r.score for r in rows} == {1.0} and sorted(r["rank"] for r in rows) == list(range(1, 11))
    assert ann.train(same.limit(0)) is None and ann.train(same.withColumn("vector", same.vector.cast("array<double>")).where("chunk_id < 0")) is None
    assert ann.search(ann.index(same, quantizer), quantizer, ask.limit(0), 10).count() == 0
    assert ann.search(ann.index(same.limit(0), quantizer), quantizer, ask, 10).count() == 0


def test_recall_over_the_table(spark):
    rows = plans.queries()["knn_lists_recall"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows)
    assert len(rows) == plans.queries()["knn_cosine_topk"](spark, "/root/testdata/sf0.01").select("query_id").distinct().count()
    assert table(spark, "/root/testdata/sf0.01", "benchmark").count() >= len(rows)
