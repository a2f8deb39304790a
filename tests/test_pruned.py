"""Pruned search against the exhaustive one, and how much of the postings it scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pruned, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60_000)]
    texts = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 20, 60]))), k % 4, k % 9 == 0, rng.choice(["A", "B", None])) for k in range(600)]
    texts += [(1000, None, 1, None, "A"), (1001, "w1 w1", None, False, None), (1002, texts[5][1], 0, False, "A")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string, owner_id int, is_public boolean, org_tag string").repartition(3)
    asks = [(q, " ".join(rng.choices(words, k=rng.choice([1, 3, 30]))) if q else None, q % 5, ["A", None] if q % 2 else ["B"] if q % 3 else None) for q in range(40)]
    asks += [(90, "nowhere words", 1, ["A"]), (91, "", 1, ["A"])]
    queries = spark.createDataFrame(asks, "query_id long, query_text string, user_id int, tags array<string>")
    return chunks, queries


def rows(df):
    return {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 10, 1000])
@pytest.mark.parametrize("block, shard", [(16, 20_000), (3, 50)])
def test_pruned_search_equals_the_exhaustive_one(corpus, monkeypatch, k, block, shard):
    chunks, queries = corpus
    monkeypatch.setattr(pruned, "BLOCK", block)
    monkeypatch.setattr(pruned, "SHARD", shard)
    asked = queries.select("query_id", "query_text")
    got, want = rows(pruned.bm25_top(chunks, asked, k)), rows(retrieval.top(retrieval.bm25(chunks, asked), k))
    assert got == want and got


def test_pruned_search_under_permissions(corpus):
    chunks, queries = corpus
    asked, who = queries.select("query_id", "query_text"), queries.select("query_id", "user_id", "tags")
    plain = chunks.withColumns({"is_public": F.coalesce("is_public", F.lit(False)), "owner_id": F.coalesce("owner_id", F.lit(-1))})
    want = rows(retrieval.top(retrieval.bm25(plain, asked, who.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))), 10))
    assert rows(pruned.bm25_top(plain, asked, 10, who)) == want
    access = plain.select("chunk_id", "owner_id", "is_public", "org_tag")
    assert rows(pruned.bm25_top(chunks.select("chunk_id", "text"), asked, 10, who, access)) == want


def test_queries_in_blocks_and_empty_tables(corpus, monkeypatch):
    chunks, queries = corpus
    asked = queries.select("query_id", "query_text")
    want = rows(pruned.bm25_top(chunks, asked, 5))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 17)
    assert rows(pruned.bm25_top(chunks, asked, 5)) == want
    assert rows(pruned.bm25_top(chunks.limit(0), asked, 5)) == {} and rows(pruned.bm25_top(chunks, asked.limit(0), 5)) == {}


@pytest.mark.parametrize("draws, share", [(15, 0.5), (90, 0.1)])
def test_common_words_are_not_scored_everywhere(draws, share):
    """Twenty words in about half of the passages, then in nearly all; four rare ones."""
    rng = np.random.default_rng(0)
    n, rare = 20_000, 300
    sets = [np.unique(np.append(rng.integers(0, 20, draws), 20 + rng.integers(0, rare, 3))) for _ in range(n)]
    codes, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    df = np.bincount(codes, minlength=20 + rare)
    shard = pruned.Shard(np.full(n, 30), sizes, codes, np.ones(len(codes), np.int64), np.log(1 + (n - df + 0.5) / (df + 0.5)), 30.0)
    exact = lambda words: np.bincount(shard.doc[m := np.isin(np.repeat(np.arange(20 + rare), np.diff(shard.post)), words)], weights=shard.weight[m], minlength=n)
    for _ in range(20):
        words = np.append(np.arange(20), 20 + rng.choice(rare, 4, replace=False))
        docs, scores = shard.search(words, 10, 0.0)
        assert np.allclose(np.sort(scores)[::-1][:10], np.sort(exact(words))[::-1][:10])
    assert shard.scored < share * shard.held
