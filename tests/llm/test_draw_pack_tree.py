"""Importance resampling, packing and the Merkle manifest against plain versions, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import importance, merkle, packing
from tessera.llm.common import NO_WORD_BEFORE, written
from tessera.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = tokenizer_file("byte_bpe_50k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéßXYZ'09") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = [(k * 37 - 400, prose(rng, rng.choice([0, 3, 19, 20, 40, 400])), rng.choice(["de", "en", "en", "fr", None]), rng.choice(["a", None]), rng.choice([None, 5, 9, 99])) for k in range(300)]
    found += [found[7]] * 40 + [(None, None, None, None, None), (None, "", "en", "a", 0), (None, "x y", "en", "a", 3), (10**15, "Z" * 30_000 + " \n\n \t" + "9 " * 5000, "zz", "é", 7), (-(2**63), " ", "en", "a", 1), (2**63 - 1, "漢字 🙂 \x00 ▁ don't", "en", "b", 3)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, with columns that are named like the operators' own."""
    names = ["_g", "_rank", "_uid", "size", "bin", "gap", "key", "part", "rank", "score", "leaf", "path", "ids", "length", "_range", "_k1", "n_words", "node"]
    return spark.createDataFrame(rows, DOCS).repartition(5).withColumns({n: F.lit(f"own-{n}") for n in names})


# ---------------------------------------------------------------- importance resampling


def plain_features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain_draw(rows, target, percent=25, least=20):
    s, t = Counter(), Counter()
    held = [(r[0], *plain_features(r[1])) for r in rows]
    for _, _, f in held:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in s}
    out = []
    for key, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0]))
    draws = percent * len(order) // 100
    return Counter([(*r[:4], k + 1 if k < draws else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in out if r[4] < least])


TARGET = ["abc dee 09 abc", None, "", "é é é", prose(random.Random(9), 500)]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(x, "other") for x in TARGET], "text string, bucket string")


def test_draw_equals_a_plain_version(docs, rows, target):
    got = importance.resample(docs, target).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == plain_draw(rows, TARGET)


@pytest.mark.parametrize("percent, run_rows, range_rows", [(25, 7, 3), (100, 50, 10), (0, 9, 9), (60, 100_000, 100_000)])
def test_runs_and_ranges_of_any_size_give_the_same_draw(docs, rows, target, percent, run_rows, range_rows):
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(target))
    got = importance.draw(importance.scored(docs, gain, run_rows=run_rows), percent, range_rows=range_rows).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == plain_draw(rows, TARGET, percent)


def test_one_score_for_all_is_cut_by_id(spark):
    rows = written(spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id"), F.lit(3).cast("long").alias("n_features"), F.lit(20).cast("long").alias("n_words"), F.lit(1).cast("long").alias("weight"), (F.col("id") % 2).alias("score")), "one-score")
    got = {r.doc_id: r.rank for r in importance.draw(rows, 70, range_rows=40).where("rank IS NOT NULL").collect()}
    order = sorted((-(r.score), r.doc_id) for r in rows.collect())[:700]
    assert got == {key: k + 1 for k, (_, key) in enumerate(order)}
    parts = importance._parts_of_large(rows, {0: 500, 1: 500}, 40)
    assert all(sum(n for _, n in p) == 500 and max(n for _, n in p) <= 80 for p in parts.values())


def test_draw_of_an_empty_table_and_target(spark, docs, rows, target):
    assert importance.resample(docs.limit(0), target).collect() == []
    got = importance.resample(docs, target.limit(0)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == plain_draw(rows, [])


def test_tournament_merges_and_stops():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randint(0, 50), rng.randint(0, 9)) for _ in range(rng.randint(1, 30))) for _ in range(k)]
        every = sorted(e for r in runs for e in r)
        for most in (0, 1, len(every) // 2, len(every), len(every) + 5):
            first, rest = importance.merged(runs, most)
            assert first == every[:most] and sorted(first + rest) == every


def test_words_go_on_over_the_borders_of_pieces(monkeypatch):
    text = "Ab cD é9 " * 50
    whole = np.sort(np.concatenate([f for _, f in importance.buckets_of(text)]))
    monkeypatch.setattr(importance, "PIECE", 10)
    cut = list(importance.buckets_of(text))
    assert len(cut) > 5 and np.array_equal(whole, np.sort(np.concatenate([f for _, f in cut])))


# ---------------------------------------------------------------- packing


def check_packed(got, capacity):
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def best_fit_decreasing(sizes, capacity):
    gaps, n = Counter(), 0
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s and gaps[g]), default=None)
        if fit is None:
            n, fit = n + 1, capacity
        else:
            gaps[fit] -= 1
        gaps[fit - s] += 1
    return n


def test_packing_holds_the_librarys_ids(docs, rows):
    library = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    check_packed(got, 2048)
    want = Counter()
    for key, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (at, n) in enumerate(packing.pieces_of(len(ids))):
            want[key, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), tuple(ids[at : at + n].tolist())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    assert len({r.sequence_id for r in got}) <= best_fit_decreasing([r.length for r in got], 2048) + 1


def test_sequences_hold_their_pieces_in_order(docs):
    packed = written(packing.pack(docs.where("doc_id < 500"), VOCABULARY, with_ids=True), "packed")
    whole = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: r.offset):
        whole[r.sequence_id] += r.ids
    got = packing.sequences(packed).collect()
    assert {r.sequence_id: r.ids for r in got} == whole and all(r.n_ids == len(r.ids) for r in got)
    assert sum(packing.sizes_after(packed).values()) == len(got)


WHITE = ["a  b", "a \nb", "a\n\n\nb", "a\n\n b ", "\t a\tb", "a  b　\nc", " ", "\n", "  x", "x\n", "a\x1c b\x1c\x1cc", "don't I'll x's", "q<|endoftext|> r  <|endoftext|>", "a\r\nb \r\n c", "é   z 12 345\n67", "\x85 \x85a"]


def test_units_equal_the_library_on_white_space():
    library = Tokenizer.from_file(VOCABULARY)
    encoder = packing.UnitEncoder(VOCABULARY)
    rng = random.Random(3)
    texts = WHITE + ["".join(rng.choice(["a", "B", "é", "1", "'s", " ", " ", "\n", "\t", " ", "!", "漢", "\x1c", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_unit_memory_is_bounded_by_bytes():
    encoder = packing.UnitEncoder(VOCABULARY, cache=20_000)
    rng = random.Random(4)
    library = Tokenizer.from_file(VOCABULARY)
    for _ in range(30):
        texts = [prose(rng, 50) + " " + "k" * 5000 for _ in range(4)]
        for text, ids in zip(texts, encoder.batch(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.size < 20_000 + 4 * 52 * 400 and all(len(k) <= packing.LONGEST for k in encoder.young)


@pytest.mark.parametrize("name, finish", [("mixed", 0), ("mixed", 300), ("halves", 0), ("halves", 10_000), ("tiny", 0), ("one size", 0), ("few", 10)])
def test_best_fit_needs_few_sequences(spark, name, finish):
    rng = random.Random(1)
    sizes = {"mixed": [rng.randint(1, 100) for _ in range(900)], "halves": [rng.randint(45, 60) for _ in range(500)], "tiny": [rng.randint(1, 3) for _ in range(4000)], "one size": [34] * 500, "few": [100, 1]}[name]
    rows = written(spark.createDataFrame(list(enumerate(sizes)), "uid long, size int"), "sizes")
    got = packing.best_fit(rows, 100, range_rows=150, finish=finish).join(rows, "uid").withColumnRenamed("size", "length").collect()
    assert sorted(r.uid for r in got) == list(range(len(sizes)))
    held = check_packed(got, 100)
    assert len(held) <= best_fit_decreasing(sizes, 100) * 1.02 + 2
    assert len(held) >= packing.least_sequences(Counter(sizes), 100)


def test_ranges_match_like_brackets():
    rng = random.Random(8)
    for _ in range(200):
        counts = [(p, rng.randint(0, 4), rng.randint(0, 4)) for p in range(rng.randint(1, 6))]
        want, stack = [], []
        for p, gaps, free in counts:
            want += [(*stack.pop(), p, g) for g in range(gaps) if stack]
            stack += [(p, k) for k in range(free)]
        got = [(fp, fhi - 1 - k, gp, glo + k) for _, fp, flo, fhi, gp, glo, ghi in packing.matched_ranges(counts) for k in range(ghi - glo)]
        assert got == want


def test_packing_of_an_empty_table(docs):
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


# ---------------------------------------------------------------- manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(r, more=0):
    key, text, lang, source, n = r
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(part(key), part(source), part(lang), part(None if n is None else n + more), part(text))


def plain_tree(nodes, fanout):
    tiers = [nodes]
    while len(tiers[-1]) > 1:
        tiers.append([H(*tiers[-1][k : k + fanout]) for k in range(0, len(tiers[-1]), fanout)])
    return tiers


def plain_path(tiers, at, fanout):
    path = []
    for tier in tiers[:-1]:
        run = at - at % fanout
        path.append((tier[run:at], tier[at + 1 : run + fanout]))
        at //= fanout
    return path


def plain_manifest(rows, fanout=2):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = plain_tree([plain_leaf(r) for r in by[lang]], fanout)
    top = plain_tree([trees[k][-1][0] for k in order], fanout)
    out = Counter()
    for s, lang in enumerate(order):
        for k, r in enumerate(by[lang]):
            path = plain_path(trees[lang], k, fanout) + plain_path(top, s, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = plain_leaf(r, int(hit))
            for left, right in path:
                node = H(*left, node, *right)
            out[r[0], plain_leaf(r), trees[lang][-1][0], top[-1][0], H(*(x for p in path for side in p for x in side)), node, node == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("fanout, levels, cell", [(2, 10, 4096), (2, 2, 5), (3, 2, 16), (16, 1, 1)])
def test_manifest_equals_a_plain_version(docs, rows, fanout, levels, cell):
    got = merkle.Manifest(docs, fanout, levels, cell).checked().collect()
    assert Counter(tuple(r)[:7] for r in got) == plain_manifest(rows, fanout)


def test_manifest_of_one_row_and_of_none(spark, docs, rows):
    one = spark.createDataFrame(rows[:1], DOCS)
    got = merkle.manifest(one).collect()
    assert Counter(tuple(r)[:7] for r in got) == plain_manifest(rows[:1]) and got[0].leaf == got[0].root
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_radix_ranks_over_all_64_bits(spark):
    rng = random.Random(6)
    keys = [rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(-50, 50), 2**63 - 1, -(2**63), 7]) for _ in range(2000)]
    rows = written(spark.createDataFrame([("g" if k % 3 else "h", v, k) for k, v in enumerate(keys)], "_g string, a long, b long"), "keys")
    got = {(r._g, r.a, r.b): (r._rank, r._n) for r in merkle.radix_ranks(rows, ["a", "b"], 4).collect()}
    for g in "gh":
        order = sorted((v, k) for k, v in enumerate(keys) if ("g" if k % 3 else "h") == g)
        assert all(got[g, v, k] == (i, len(order)) for i, (v, k) in enumerate(order))


def test_digits_cover_the_bits_that_differ():
    assert merkle._digits(5, 5) == [] and merkle._digits(0, 3) == [(0, 3)]
    assert merkle._digits(-1, 0) == [(56 - 8 * k, 255) for k in range(8)]


def test_signs_without_a_word_before_are_found():
    """Against the rule in words; all 5-character texts of these, so signs meet texts' ends, signs, blanks and UTF-8 tails."""
    def plain(text):
        return any(b in ",." and c == " " and not (a.isascii() and a.isalnum() or "À" <= a <= "ÿ" and a not in "×÷") for a, b, c in zip("\n" + text, text, text[1:], strict=False))

    for x in itertools.product("a9, .é×ā漢", repeat=5):
        text = "".join(x)
        assert bool(NO_WORD_BEFORE.search(text.encode())) == plain(text), repr(text)
