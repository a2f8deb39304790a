"""Whole queries and pipeline stages against plain versions written without Spark."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import classifier, common, langid, mixing, pii, quality, simhash, spm, tokens, warc
from tessera.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF), duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def test_archives_equal_a_plain_version(spark):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for key, html in pages:
        last[html] = max(last.get(html, key), key)
    want = {(key, len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), "response" if last[html] == key else "revisit", None if last[html] == key else last[html]) for key, html in pages}
    assert {tuple(r)[:5] for r in Q.op1_warc(spark, SF).collect()} == want


def test_archives_give_back_payloads_and_blocks(spark):
    pages = spark.createDataFrame([(1, "http://a/x?q", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, "http://c", "")], "page_id long, url string, html string")
    path = common.scratch(spark, "test-warc")
    warc.write_warc(pages, path)
    rows = {r.response.page_id: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert bytes(rows[2].response.payload).decode() == "<p>é</p>" and rows[1].response.payload is None and bytes(rows[3].response.payload) == b""
    assert bytes(rows[1].request.block).startswith(b"GET /x?q HTTP/1.1\r\nHost: a") and bytes(rows[3].metadata.block) == b"payload-length: 0\r\n"


# ------------------------------------------------------------------ near-duplicates as a stage


def _plain_kept(rows):
    """The rows that stay, as (doc_id, text), one of each class of links between fingerprints."""
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row)
    return groups.values()


def test_one_row_of_each_class_stays(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    kept = Counter((r.doc_id, r.text) for r in simhash.one_per_class(documents).collect())
    for group in _plain_kept(rows):
        assert [r for r in group if kept[r]] == [min(group)] and kept[min(group)] == 1


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black", "no id but a text of its own")
    rows = [(1, a), (5, a), (5, b), (5, c), (5, c), (None, b), (None, d), (None, d), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _th int")
    out = simhash.one_per_class(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (5, b), (5, c), (None, d), (8, "")])


# ------------------------------------------------------------------ quality


def _mcd(x):
    """The estimate of a group in numpy: two starts, concentration until the determinant settles."""
    floors = np.array(quality.FLOORS) ** 2
    pairs = [(np.median(x, axis=0), np.diag(((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349) ** 2 + floors)), (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floors))]
    best = None
    for centre, cov in pairs:
        det, first = math.inf, True
        while True:
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d <= np.sort(d)[math.ceil(quality.NEAR * len(d)) - 1]]
            centre, cov = near.mean(axis=0), quality.CONSISTENT * np.cov(near.T, bias=True) + np.diag(floors)
            now = np.linalg.det(cov)
            if not first and det / now < quality.SETTLED:
                break
            det, first = now, False
        if best is None or now < best[0]:
            best = (now, centre, cov)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_estimate_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(0, 1, (4, 4)) * 0.2
    x = np.concatenate([rng.normal(0, 1, (240, 4)) @ mixed + 1.0, rng.normal(4, 0.3, (50, 4))])
    row = quality.estimates(spark.createDataFrame([("g", *map(float, r)) for r in x], "_g string, x0 double, x1 double, x2 double, x3 double")).first()
    det, centre, cov = _mcd(x)
    assert row["_det"] == pytest.approx(det, rel=1e-6)
    assert [row[f"m{k}"] for k in range(4)] == pytest.approx(centre.tolist(), rel=1e-6)
    white = np.array([[row[f"w_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert white.T @ white == pytest.approx(np.linalg.inv(cov), rel=1e-5)
    # no random start of many finds a determinant that is much smaller
    floors = np.diag(np.array(quality.FLOORS) ** 2)
    least = det
    for _ in range(60):
        near = x[rng.choice(len(x), 12, replace=False)]
        for _ in range(30):
            centre, cov = near.mean(axis=0), quality.CONSISTENT * np.cov(near.T, bias=True) + floors
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d <= np.sort(d)[math.ceil(quality.NEAR * len(d)) - 1]]
        least = min(least, np.linalg.det(quality.CONSISTENT * np.cov(near.T, bias=True) + floors))
    assert det <= 1.05 * least


def test_groups_end_alone(spark):
    """Groups that settle at once, groups of ties and one row, and a group that takes many steps: each as if it were alone."""
    rng = np.random.default_rng(5)
    groups = {
        "ties": np.repeat(rng.integers(0, 2, (30, 4)), 4, axis=0).astype(float),
        "same": np.full((60, 4), 0.25),
        "one": np.array([[1.0, 0.0, 0.5, 0.0]]),
        "two": np.array([[1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.5]]),
        "many": np.concatenate([rng.normal(0, 1, (400, 4)), rng.normal(1.5, 0.7, (300, 4)), rng.normal(-2, 2, (100, 4))]),
    }
    schema = "_g string, x0 double, x1 double, x2 double, x3 double"
    rows = {g: [(g, *map(float, r)) for r in x] for g, x in groups.items()}
    together = {r["_g"]: r for r in quality.estimates(spark.createDataFrame([r for part in rows.values() for r in part], schema)).collect()}
    assert set(together) == set(groups)
    for g in ("ties", "many"):
        alone = quality.estimates(spark.createDataFrame(rows[g], schema)).first()
        assert [together[g][c] for c in ("_det", "m0", "m3")] == pytest.approx([alone[c] for c in ("_det", "m0", "m3")], rel=1e-9)
    least = math.prod(f * f for f in quality.FLOORS)
    assert together["same"]["_det"] == pytest.approx(least) and together["one"]["_det"] == pytest.approx(least)
    assert together["many"]["_det"] == pytest.approx(_mcd(groups["many"])[0], rel=0.01)


def test_verdicts_equal_numpy(spark, documents):
    """Every document of the table: the stage keeps what the plain version keeps."""
    rows = quality._judged(*quality._fit(documents)).select("doc_id", "lang", "source", "base_failed", "n_words", "x0", "x1", "x2", "x3", "kept").collect()
    pairs, langs, every = defaultdict(list), defaultdict(list), []
    for r in rows:
        if not r.base_failed:
            for group in (pairs[r.lang, r.source], langs[r.lang], every):
                group.append((r.x0, r.x1, r.x2, r.x3))
    fitted = {}

    def estimate(r):
        key = next(((kind, k) for kind, k, g in (("pair", (r.lang, r.source), pairs[r.lang, r.source]), ("lang", r.lang, langs[r.lang])) if len(g) >= quality.MIN_GROUP), ("all", None))
        if key not in fitted:
            fitted[key] = _mcd(np.array(pairs[key[1]] if key[0] == "pair" else langs[key[1]] if key[0] == "lang" else every))
        return fitted[key]

    near_limit = 0
    for r in rows:
        if r.base_failed:
            assert not r.kept
            continue
        _, centre, cov = estimate(r)
        z = np.array([r.x0, r.x1, r.x2, r.x3]) - centre
        d = z @ np.linalg.inv(cov) @ z
        near_limit += abs(d / quality.CUTOFF - 1) < 0.02
        assert abs(d / quality.CUTOFF - 1) < 0.02 or r.kept == (d <= quality.CUTOFF)
    assert near_limit <= 2
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.kept_documents(documents).select("doc_id").collect()} == kept


# ------------------------------------------------------------------ classifier


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, len(classifier.STATS)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 400) > 0.4).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in classifier.STATS) + ", label int")
    model = classifier.fit(rows.repartition(3))
    z = np.sqrt(2 / classifier.FEATURES) * np.cos(np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8) @ model.w + model.b)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    ridge = lambda a, b: np.linalg.solve(a.T @ a + np.eye(a.shape[1]) * classifier.RIDGE * len(a), a.T @ b)
    assert model.beta == pytest.approx(ridge(z, y), rel=1e-5, abs=1e-7)
    fold = np.array([r.f for r in rows.select(F.pmod(F.xxhash64(*classifier.STATS), F.lit(classifier.FOLDS)).alias("f")).collect()])
    raw = np.zeros(len(y))
    for k in range(classifier.FOLDS):
        raw[fold == k] = z[fold == k] @ ridge(z[fold != k], y[fold != k])
    at = classifier.bins_of(raw)
    weight, positive = np.bincount(at, minlength=classifier.BINS), np.bincount(at, weights=y, minlength=classifier.BINS)
    # least squares among non-decreasing curves, by the max-min formula
    full = np.flatnonzero(weight)
    w, p = np.cumsum([0, *weight[full]]), np.cumsum([0, *positive[full]])
    want = [max(min((p[b] - p[a]) / (w[b] - w[a]) for b in range(k + 1, len(full) + 1)) for a in range(k + 1)) for k in range(len(full))]
    assert model.curve[full] == pytest.approx(want)


def test_one_label_an_id(spark):
    text = "some words of a text that has no end and then again more words to come"
    docs = spark.createDataFrame([(1, text, False), (1, text + " x", False), (2, text * 2, False), (3, None, True)], "doc_id long, text string, held_out boolean")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert classifier.classify(docs.withColumn("label", F.lit("own")), labels.withColumn("text", F.lit("own"))).count() == 4


# ------------------------------------------------------------------ token ids


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files_equal_a_plain_version(spark, documents, monkeypatch, parts):
    monkeypatch.setattr(tokens, "partitions_of", lambda docs: parts)
    library = tokens.encoder_of(Q.tokenizer_file("word_bpe_49k.json")).library
    want, start = [], 0
    for r in sorted(documents.select("doc_id", "text").collect()):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in Q.op8_tokens(spark, SF).collect()) == want


def test_rows_of_one_id_are_dealt_over_partitions(spark):
    docs = spark.createDataFrame([(7, f"text number {k}") for k in range(400)], "doc_id long, text string")
    path = common.scratch(spark, "test-tokens")
    tokens.write_tokens(docs, path, Q.tokenizer_file("word_bpe_49k.json"))
    assert spark.read.parquet(path).select("part").distinct().count() > 1
    rows = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist() and len(rows) == 400


# ------------------------------------------------------------------ piece ids


def test_long_units_equal_the_library():
    import sentencepiece

    path = Q.tokenizer_file("piece_bpe_32k.model")
    encoder, library = spm.encoder_of(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    for n in (1, 80, 700, 2500):
        text = "".join(rng.choice("abcdehinorsteeeaaxq{}();=,.漢é🙂0129") for _ in range(n))
        want = library.encode(text)
        assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == want
        for span in (70, 5000):
            assert np.frombuffer(spm.encode_long(spm.MARK + text, encoder.vocab, span), "<u4").tolist() == want
    for text in ("x" * 900 + "ab" * 900, "漢字" * 2000, "if(a){b();}" * 500):
        assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == library.encode(text)


# ------------------------------------------------------------------ languages


def test_scores_equal_a_plain_version(spark, documents):
    labelled = documents.where(~common.held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    model = langid.train(labelled)
    counts = langid.count_grams((r.text, r.lang) for r in labelled.collect())  # fewer rows than the bound: all are drawn
    kept = defaultdict(dict)
    for lang, kind in {k[:2] for k in counts}:
        rows = sorted((-n, g) for (a, b, g), n in counts.items() if (a, b) == (lang, kind))
        for n, g in rows[: langid.MAX_WORDS if kind == 0 else langid.MAX_GRAMS]:
            kept[kind].setdefault(g, {})[lang] = -n
    langs = sorted({k[0] for k in counts})
    total = {(kind, lang): sum(v.get(lang, 0) for v in table.values()) + 0.5 * len(table) for kind, table in kept.items() for lang in langs}

    def word_logs(word):
        for kind in (0, *langid.ORDERS):
            grams = [g for g in ([word] if kind == 0 else langid.grams_of(word, kind)) if g in kept[kind]]
            if grams:
                return [sum(math.log((kept[kind][g].get(lang, 0) + 0.5) / total[kind, lang]) for g in grams) / len(grams) for lang in langs]
        return [0.0] * len(langs)

    rows = langid.identify(documents.where(common.held_out()).select("doc_id", "text"), model).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows:
        words = langid.words_of(texts[r.doc_id] or "")
        sums = np.sum([word_logs(w) for w in words], axis=0) * min(1.0, 20 / len(words))
        p = np.exp(sums - sums.max())
        assert (r.lang_pred, r.score) == (langs[int(p.argmax())], pytest.approx(p.max() / p.sum(), rel=1e-3))


def test_letters_and_marks():
    assert langid.words_of("² ½ 3 _ ①") == []
    assert langid.words_of("हिन्दी में Été_x2y") == ["हिन्दी", "में", "été", "x", "y"]


def test_rows_without_an_id_are_learned_and_bounded(spark):
    rows = [(None, f"the words of row {k} are english {'again ' * (k % 7)}", "en") for k in range(3000)] + [(None, "same row", "en")] * 500 + [(1, "ein deutscher satz", "de")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=200)
    assert model.langs == ["de", "en"] and langid.Scorer(model).score("the words again")[0] == "en"


# ------------------------------------------------------------------ mixing and the pipeline


def test_many_sources_are_ranked_and_filled(spark):
    rng = random.Random(2)
    sizes = {f"0s{k:05d}": rng.randint(0, 50) for k in range(3000)} | {"1": 40}
    got = {r["_key"]: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_key string, source_size long")).collect()}
    weight = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(sorted(sizes))}
    level, budget = 0.0, 1.5 * sum(sizes.values())
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[k]) for k, n in sizes.items()) < budget else (low, level)
    assert got == pytest.approx({k: min(2 * n, level * weight[k]) for k, n in sizes.items()}, abs=1e-6)


def test_pipeline_equals_plain_stages(spark):
    """Every stage on what its predecessor kept, from the tables to the ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect() if judged[r.doc_id]}
    left = {min(g)[0] for g in _plain_kept([(r.doc_id, r.text) for r in rows.values()])}
    texts = [rows[k].text for k in sorted(left)]
    clean = [pii.redact(t, every) for t, (_, every) in zip(texts, pii.find_spans(texts, pii.default_model()), strict=True)]
    table = spark.createDataFrame([(k, t, rows[k].source) for k, t in zip(sorted(left), clean, strict=True)], "doc_id long, text string, source string")
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(table).collect()}
    encoder = spm.encoder_of(Q.tokenizer_file("piece_bpe_32k.model"))
    want = Counter()
    for k, text in zip(sorted(left), clean, strict=True):
        words, size = taken[k]
        for part in [text] * (words // size) + ([" ".join(text.split()[: words % size])] if words % size else []):
            want[k, zlib.crc32(encoder.batch([part])[0])] += 1
    assert Counter((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == want
