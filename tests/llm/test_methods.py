"""The methods against plain versions of themselves."""

import io
import random
import re
import string
import struct
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import avi, classifier, langid, mixing, pii, quality, simhash, spm, tokens, warc
from tessera.llm.common import held_out
from tessera.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------------ mixing


def test_mix_equals_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(mixing.MIX_SQL).fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(documents).collect()}
    assert got == want


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 0}, {"a": 7}])
def test_water_filling_equals_a_loop(spark, sizes):
    rows = [("0" + k, v) for k, v in sizes.items()]
    got = {r["_key"]: r.target for r in mixing.targets(spark.createDataFrame(rows, "_key string, source_size long")).collect()}
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(got))}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:  # clamp, reshare, until none is above
        free = [k for k in got if k not in full]
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] >= 2 * sizes[k[1:]]]
        if not over:
            break
        for k in over:
            full[k] = 2.0 * sizes[k[1:]]
            left -= full[k]
        if len(full) == len(got):
            break
    want = full | {k: v for k, v in share.items() if k not in full}
    assert got == pytest.approx(want)


def test_mixed_documents_hold_the_taken_words(documents):
    want = {r[0]: r[1] for r in mixing.mix(documents).select("doc_id", "taken").collect() if r[1]}
    got = Counter()
    for r in mixing.mixed_documents(documents).select("doc_id", "text").collect():
        got[r.doc_id] += len(r.text.split())
    assert dict(got) == want


# ------------------------------------------------------------------ SimHash


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aAbB é\t\n\x0b\x1c 漢", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _plain_fingerprint(text)


def _plain_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def _planted(seed, centres=12, around=10):
    rng = random.Random(seed)
    fps = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(around):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    return np.array(sorted(fps, key=lambda _: rng.random()), dtype=np.uint64)


@pytest.mark.parametrize("seed", range(3))
def test_bit_sliced_forest(seed):
    fps = _planted(seed)
    rows, roots = simhash.bit_sliced_forest(fps, np.zeros(len(fps), int))
    parent = np.arange(len(fps))
    parent[rows] = roots
    want = _plain_classes(fps)
    assert len(set(zip(parent.tolist(), want, strict=True))) == len(set(want)) == len(set(parent.tolist()))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_links_find_every_class(spark, bucket):
    """Also where buckets are split under longer masks."""
    fps = _planted(5)
    signed = [simhash._signed(int(x)) for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket)
    root = {r.node: r.root for r in simhash.components(found).collect()}
    got = [root.get(x, x) for x in signed]
    want = _plain_classes(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_masks_leave_at_most_a_bucket():
    for mask in simhash.first_masks():
        level = [mask]
        for _ in range(5):
            level = [m for x in level[:4] for m in simhash.next_masks(x)]
        assert all(1 << (64 - bin(m).count("1")) <= simhash.BUCKET for m in level)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


# ------------------------------------------------------------------ personal data

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(_PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in string.digits]
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card":
                doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(["a", "@", ".", "b.co", "1", "4", "4111111111111111", "255", "256", ".", " ", "-", "+", "(", ")", "é", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "\n"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == _plain_spans(text)


def test_base_spans_in_documents(documents):
    for r in documents.select("text").collect():
        assert pii.base_spans(r.text) == _plain_spans(r.text)


def test_gradients():
    model = pii.Model(hidden=3)
    rows = list(pii.labelled_examples(3, 30, 1))
    ids, tags = np.zeros((3, 30), int), np.zeros((3, 30), int)
    for k, (text, spans) in enumerate(rows):
        ids[k, : len(text)], tags[k, : len(text)] = pii.classes_of(text), pii.tags_of(len(text), spans)
    _, grads = model.step(ids, tags)
    for name, value in model.p.items():
        flat, at = value.reshape(-1), int(np.abs(grads[name]).argmax())
        kept = flat[at]
        losses = []
        for d in (1e-5, -1e-5):
            flat[at] = kept + d
            losses.append(model.step(ids, tags)[0])
        flat[at] = kept
        assert grads[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4)


def test_tagger_finds_held_out_spans():
    model, hits, said, total = pii.default_model(), Counter(), Counter(), Counter()
    for text, spans in pii.labelled_examples(400, pii.LENGTH, 77):
        found = {x[:3] for x in pii.model_spans([text], model)[0]}
        hits.update(k for _, k, _ in found & set(spans))
        said.update(k for _, k, _ in found)
        total.update(k for _, k, _ in spans)
    assert sum(hits.values()) >= 0.93 * sum(total.values()) and sum(hits.values()) >= 0.93 * sum(said.values())
    assert all(hits[k] >= 0.9 * total[k] for k in range(len(pii.KINDS)))


def test_added_spans_are_right():
    """On further examples, what is added to the base spans by the calibrated thresholds."""
    model, right, added, left = pii.default_model(), 0, 0, 0
    rows = list(pii.labelled_examples(400, pii.LENGTH, 78))
    for (_, spans), (base, every) in zip(rows, pii.find_spans([t for t, _ in rows], model), strict=True):
        new = set(every) - set(base)
        added, right = added + len(new), right + len(new & set(spans))
        left += sum(not any(s < e2 and s2 < e for s2, _, e2 in base) for s, _, e in spans)
    assert right >= 0.95 * added and right >= 0.5 * left


def test_model_adds_and_base_stays():
    text = "x" * 200 + " call (743) 555-3824 today, card 12 4111111111111111 or a@b.co, password=3d4bc476f7469ffa8a now " + "y" * 200
    base, every = pii.find_spans([text], pii.default_model())[0]
    assert set(base) <= set(every)
    assert {"(743) 555-3824", "3d4bc476f7469ffa8a"} <= {text[a:z] for a, _, z in every}


CLEAN = [
    "the 1st Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft of 7",
    "see 3 at //www.verylongdomainnamewithoutanydigitsinitatall.com/path and https://docs.example.org/a/b/c.html 9",
    "7 " + "z" * 100 + " 8 " + "y" * 72 + " 5",
    "x = some_function_name(arg) : 3 items, key: value, commit=3d4bc476f7469ffa8a, ratio: 3/4",
    "at 10:30 p=q, a@ b, version 1.2.3.4567, 12345678901234",
]


def test_long_words_and_addresses_are_no_personal_data():
    assert [x[1] for x in pii.find_spans(CLEAN, pii.default_model())] == [[]] * len(CLEAN)


@pytest.mark.parametrize("size", [9, 60, 130, 200, 5000])
@pytest.mark.parametrize("before", ["", "word " * 30, "é" * 77])
def test_secrets_of_any_length_are_whole(size, before):
    secret = "".join(random.Random(size).choices("0123456789abcdef", k=size))
    text = f'{before}a token = "{secret}" and more 4 words'
    at = text.index(secret)
    assert (at, pii.SECRET, at + size) in pii.find_spans([text], pii.default_model())[0][1]
    assert secret[-9:] not in pii.redact(text, pii.find_spans([text], pii.default_model())[0][1])


def test_passwords_without_a_digit_are_found():
    text = "so password=correcthorsebattery it is"
    assert "correcthorsebattery" in {text[a:z] for a, _, z in pii.find_spans([text], pii.default_model())[0][1]}


def test_planted_tokens_are_found(spark):
    """Recall after thresholds on the tokens that the tables hold, and precision of what is added beside base spans."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    planted = found = others = 0
    for text, (base, every) in zip(rows, pii.find_spans(rows, pii.default_model()), strict=True):
        want = {m.span(1) for m in re.finditer('token = "([0-9a-f]{40})"', text)}
        new = {(a, z) for a, _, z in set(every) - set(base)}
        planted, found, others = planted + len(want), found + len(want & new), others + len(new - want)
    assert planted > 100 and found >= 0.9 * planted and others <= 0.1 * planted


def test_training_is_the_same_whatever_the_order_of_sums(monkeypatch):
    """Gradients that differ in their last bits, as on another machine, give the same parameters."""
    plain = pii.train(pii.labelled_examples(60), epochs=2)
    exact = pii.Model.step

    def other(self, ids, tags):
        loss, grads = exact(self, ids, tags)
        rng = np.random.default_rng(len(ids))
        return loss, {k: g * (1 + rng.uniform(-4e-16, 4e-16, g.shape)) for k, g in grads.items()}

    monkeypatch.setattr(pii.Model, "step", other)
    moved = pii.train(pii.labelled_examples(60), epochs=2)
    assert all(np.array_equal(plain.p[k], moved.p[k]) for k in plain.p)


def test_clean_texts_stay_clean(spark):
    """Texts without a base span, password or token: nothing is added to nearly all of them."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = pii.find_spans(rows, pii.default_model())
    clean = [k for k, t in enumerate(rows) if not found[k][0] and not re.search("password|token", t)]
    assert len(clean) > 500 and sum(bool(found[k][1]) for k in clean) <= 0.002 * len(clean)
    assert sum(len(every) - len(base) for base, every in found) > 0


def test_reconcile_is_the_best_set():
    rng = random.Random(3)
    for _ in range(50):
        rows = [(a := rng.randint(0, 20), rng.randint(0, 3), a + rng.randint(1, 8), rng.random()) for _ in range(7)]
        got = pii.reconcile(rows)
        best = 0.0
        for mask in range(1 << len(rows)):
            pick = [r for k, r in enumerate(rows) if mask >> k & 1]
            if all(x[2] <= y[0] or y[2] <= x[0] for i, x in enumerate(pick) for y in pick[:i]):
                best = max(best, sum(r[3] for r in pick))
        assert sum(x[3] for x in got) == pytest.approx(best)


# ------------------------------------------------------------------ quality


def test_base_statistics(spark, documents):
    extra = spark.createDataFrame([(-1, "a b a b a b c"), (-2, "x x x x"), (-3, "a b c\na b c\n\n \nd"), (-4, "p q"), (-5, "#% a|b")], "doc_id long, text string")
    rows = quality.base_statistics(documents.select("doc_id", "text").unionByName(extra)).collect()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", r.text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(0)
    clean, bad = rng.normal(1.0, 0.1, (800, 4)), rng.normal(6.0, 0.1, (160, 4))
    rows = [("g", *map(float, x)) for x in np.concatenate([clean, bad])]
    params = quality.estimates(spark.createDataFrame(rows, "_g string, x0 double, x1 double, x2 double, x3 double")).first()
    assert all(abs(params[f"m{k}"] - 1.0) < 0.05 for k in range(4))


def test_rules_keep_good_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(documents).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)


def test_a_small_group_is_held_against_its_whole_language(spark):
    """Rare sources beside a large one: their estimate is of all rows of the language, or of the table."""
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    clean = lambda k: " ".join(random.Random(k).sample(words, 80))
    junk = " ".join(w + "#$%&" * 3 for w in clean(-1).split())
    rows = [(k, clean(k), "en", "large") for k in range(200)]
    rows += [(1000, junk, "en", "rare"), (1001, clean(1001), "en", "rare")]
    rows += [(2000, junk, "en", "lone"), (3000, junk, "xx", "large"), (3001, clean(3001), "xx", "other")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if not r.kept} == {1000, 2000, 3000}


def test_isotonic():
    curve = classifier.isotonic(np.array([1, 1, 0, 2, 1.0]), np.array([0, 1, 0, 0, 1.0]))
    assert (np.diff(curve) >= 0).all() and curve[0] == 0 and curve[-1] == 1 and curve[1] == pytest.approx(1 / 3)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", held_out().alias("held_out"), "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_languages_on_held_out_rows(documents):
    model = langid.train(documents.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    rows = langid.identify(documents.where(held_out()).select("doc_id", "text", "lang"), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_every_language_is_learned(spark):
    """Over 200 values of lang, of which the largest sorts last."""
    rows = [(k, f"kata{chr(97 + k % 26)}{chr(97 + k // 26)} " * 3, f"a{k:03d}") for k in range(230)]
    rows += [(1000 + k, "dobry wieczor panstwu", "zz") for k in range(40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows})
    assert langid.Scorer(model).score("dobry wieczor")[0] == "zz"


def test_backoff_order():
    model = langid.Model(langid.count_grams([("shoe house", "en"), ("schuh haus", "de")]) and [(k[0], k[1], k[2], n) for k, n in langid.count_grams([("shoe house", "en"), ("schuh haus", "de")]).items()])
    assert model.vector("shoe").tolist() == model.tables[0]["shoe"].tolist()
    longest = model.vector("shoes")
    assert longest.tolist() == pytest.approx((sum(model.tables[4][g] for g in ("<sho", "shoe")) / 2).tolist())
    assert model.vector("漢").tolist() == [0.0, 0.0]


def test_langid_vectors_of_many_words_are_made_at_once():
    counts = langid.count_grams([("shoe house shoes", "en"), ("schuh haus häuser", "de"), ("dom but", "pl")])
    model = langid.Model((*k, n) for k, n in counts.items())
    words = ["shoe", "shoes", "haus", "mauser", "xshx", "漢", "b", "𐐨a"]
    for word, row in zip(words, model.vectors(words), strict=True):
        kinds = [(k, [g for g in ([word] if k == 0 else langid.grams_of(word, k)) if g in model.tables[k]]) for k in (0, *langid.ORDERS)]
        kind, grams = next(((k, g) for k, g in kinds if g), (0, []))
        assert row.tolist() == pytest.approx(np.mean([model.tables[kind][g] for g in grams], axis=0).tolist() if grams else [0.0] * 3)
    asked = []
    model.vectors = lambda some, f=model.vectors: asked.append(list(some)) or f(some)
    scorer = langid.Scorer(model)
    once = scorer.score("shoe mauser xshx shoe")
    assert asked == [["shoe", "mauser", "xshx"]] and scorer.score("Shoe mauser, xshx shoe") == once and len(asked) == 1


def test_langid_words_of_any_alphabet():
    def plain(text):
        found, inside = [], False
        for c in text.lower():
            kind = unicodedata.category(c)[0]
            if kind == "L" or (inside and kind == "M"):
                found[-1:] = [found[-1] + c] if inside else [*found[-1:], c]
            inside = kind == "L" or (inside and kind == "M")
        return found

    for text in ("", "A b2c_d\x00e\x7f", "Kelvin \u212a x² ½é", "हिन्दी İstanbul ŉ a\u0301", "\U00010400b \U0001f600c 漢\U00020000 \u0301x"):
        assert langid.words_of(text) == plain(text)


# ------------------------------------------------------------------ media, tokens, archives


@settings(deadline=None, max_examples=30)
@given(st.binary(min_size=1, max_size=9000))
def test_avi_round_trip(raw):
    payload = raw + b"\x00" * (-len(raw) % 64)
    media = avi.encode_avi(payload)
    assert avi.decode_avi(media)[0] == payload
    without = media[: media.index(b"idx1")]
    again = without[:4] + (len(without) - 8).to_bytes(4, "little") + without[8:]
    assert avi.decode_avi(again)[0] == payload


def test_general_jpeg_decoder_agrees(monkeypatch):
    frame = avi.read_riff(avi.encode_avi(bytes(range(256)) * 3))[1][0]
    fast = avi.decode_frame(frame).parts[0].blocks
    monkeypatch.setattr(avi, "_ONE_CODE", b"")
    assert (avi.decode_frame(frame).parts[0].blocks == fast).all()


def _scene(spark, k, width=40, height=24):
    """A colour frame by another encoder (three components, the colours subsampled), and its samples."""
    image = spark._jvm.java.awt.image.BufferedImage(width, height, 1)
    y, x = np.mgrid[0:height, 0:width]
    want = np.stack([(60 * k + 2 * x) % 256, (20 * k + 3 * y) % 256, (90 * k + x + y) % 256], axis=2)
    for i in range(height):
        for j in range(width):
            r, g, b = (int(v) for v in want[i, j])
            image.setRGB(j, i, r << 16 | g << 8 | b)
    out = spark._jvm.java.io.ByteArrayOutputStream()
    assert spark._jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray()), want


def _without(jpeg, marker):
    """jpeg without the segments of a marker, and with fill bytes before the others."""
    at, out = 2, jpeg[:2]
    while True:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] != marker:
            out += b"\xff\xff" + jpeg[at : at + 2 + size]
        if jpeg[at + 1] == 0xDA:
            return out + jpeg[at + 2 + size :]
        at += 2 + size


def test_colour_frames_of_another_encoder(spark):
    jpeg, want = _scene(spark, 0)
    frame = avi.decode_frame(jpeg)
    assert [(p.h, p.v) for p in frame.parts] == [(2, 2), (1, 1), (1, 1)]
    assert np.abs(avi.rgb(frame).astype(int) - want).mean() < 4
    usual = avi.decode_frame(_without(jpeg, 0xC4))  # the customary tables are meant
    assert all((a.blocks == b.blocks).all() for a, b in zip(frame.parts, usual.parts, strict=True))


def _riff(kind, *chunks):
    return avi._chunk(b"RIFF", kind + b"".join(chunks))


def test_files_of_other_writers(spark):
    """Index offsets from the start of the file, frames in a second RIFF chunk, and an OpenDML index."""
    frames = [_scene(spark, k)[0] for k in (0, 0, 0, 2, 2, 1)]
    avih = avi._chunk(b"avih", struct.pack("<14I", 40_000, 0, 0, 0x10, 6, 0, 1, 0, 40, 24, 0, 0, 0, 0))
    strh = avi._chunk(b"strh", b"vidsMJPG" + bytes(48))
    chunks = [avi._chunk(b"00dc", f) for f in frames]
    movi = lambda parts: avi._chunk(b"LIST", b"movi" + b"".join(parts))
    hdrl = lambda more=b"": avi._chunk(b"LIST", b"hdrl" + avih + avi._chunk(b"LIST", b"strl" + strh + more))
    at, index = 12 + len(hdrl()) + 12, b""
    for c, f in zip(chunks[:4], frames, strict=False):
        index += struct.pack("<4sIII", b"00dc", 0x10, at, len(f))
        at += len(c)
    two = _riff(b"AVI ", hdrl(), movi(chunks[:4]), avi._chunk(b"idx1", index)) + _riff(b"AVIX", movi([avi._chunk(b"LIST", b"rec " + chunks[4]), chunks[5]]))
    assert avi.read_riff(two)[1] == frames
    head = len(hdrl(avi._chunk(b"indx", bytes(40)))) + 12
    base, entries = head + 12, b""
    for c, f in zip(chunks, frames, strict=True):
        entries += struct.pack("<II", base + 8 - head, len(f))
        base += len(c)
    standard = struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", head, 0) + entries
    body = movi([*chunks, avi._chunk(b"ix00", standard)])
    superindex = struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", base, len(standard), 6)
    assert avi.read_riff(_riff(b"AVI ", hdrl(avi._chunk(b"indx", superindex)), body))[1] == frames
    rows = avi.clips(spark.createDataFrame([(1, two), (2, None), (1, two)], "doc_id long, media binary")).collect()
    assert sorted(r.clip for r in rows) == [0, 0, 1, 1, 2, 2]
    assert {(r.first_frame, r.last_frame, r.start_s, r.end_s) for r in rows} == {(0, 2, 0.0, 0.12), (3, 4, 0.12, 0.2), (5, 5, 0.2, 0.24)}


def test_clips_of_written_texts(spark, documents):
    stored = avi.write_avi(documents.orderBy(F.length("text").desc()).limit(20))
    clips = {}
    for r in avi.clips(stored).collect():
        clips.setdefault(r.doc_id, []).append(r)
    for r in avi.read_avi(stored).collect():
        said = dict(x.split("=") for x in r.feature.split(";"))
        found = sorted(clips[r.doc_id], key=lambda x: x.clip)
        assert len(found) == int(said["shots"]) and found[-1].first_frame == int(said["last_cut"]) and found[-1].last_frame == int(said["frames"]) - 1
        assert all(a.last_frame + 1 == b.first_frame and a.end_s == b.start_s for a, b in zip(found, found[1:], strict=False))


def test_transform_is_the_inverse_cosine_transform():
    flat = np.zeros((1, 64), np.int32)
    flat[0, 0] = 80  # only the mean: every sample is 128 + 80 / 8
    assert (avi.samples(flat, np.ones(64, np.int32)) == 138).all()


def test_shots():
    scene = lambda k: np.eye(avi.BINS)[k]
    assert avi.shots(np.array([scene(1)] * 5 + [scene(9)] * 4 + [scene(2)] * 6)) == [0, 5, 9]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([1, 8]), st.sampled_from([7, 64, 65536]))
def test_segments(ids, bits, block):
    array = np.array(ids, "<u4")
    data = tokens.encode_segment(array, bits, block)
    assert tokens.decode_segment(data).tolist() == ids
    for k in range(-(-len(ids) // block)):
        assert tokens.decode_segment(data, k).tolist() == ids[k * block : (k + 1) * block]


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="aB 'stİΣςé\t\n\x1c 漢.,1<|endoftext>", max_size=40))
def test_word_encoder_equals_the_library(text):
    encoder = tokens.encoder_of(tokenizer_file("word_bpe_49k.json"))
    assert next(encoder.batch([text])).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    return spm.encoder_of(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.text(alphabet="abcdefghinorst ABC.,é漢🙂\n0123456789", max_size=30), min_size=1, max_size=20))
def test_pieces_equal_the_library(pieces, texts):
    encoder, library = pieces
    for text, raw in zip(texts, encoder.batch(texts), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode(text)
        assert encoder.decode(ids) == text


def test_every_piece_next_to_others(pieces):
    encoder, library = pieces
    rng = random.Random(8)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choice(names) for _ in range(6)) for _ in range(3000)]
    for text, raw in zip(texts, encoder.batch(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text)


def test_suffix_array():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, 300)
    order = spm.suffix_array(codes, 16)
    key = [tuple(codes[i : i + 16]) for i in order]
    assert key == sorted(key)


def test_warc_parser():
    block = b"a\r\n\r\nWARC/1.1\r\n"
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)
    assert [b for _, b in warc.parse_warc(io.BytesIO(raw * 2))] == [block, block]
    with pytest.raises(ValueError):
        list(warc.parse_warc(io.BytesIO(raw[:-10])))


def test_warc_joins_out_of_order_records(spark):
    rows = [("r1", None, "response"), ("q1", "r1", "request"), ("m1", "r1", "metadata"), ("m0", "r1", "metadata"), ("q9", "r9", "request")]
    records = spark.createDataFrame([(a, b, k, None, None, None, 0, "", None, a.encode()) for a, b, k in rows], warc.RECORD_SCHEMA)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m0" and got["r1"].metadatas == 2
    assert bytes(got["r1"].request.block) == b"q1"
    assert {(r.capture_id, r.record_id, bytes(r.block)) for r in warc.side_records(records).collect()} == {("r1", "q1", b"q1"), ("r1", "m1", b"m1"), ("r1", "m0", b"m0"), ("r9", "q9", b"q9")}
    assert got["r9"].response is None


def test_long_words_are_encoded_and_not_remembered():
    encoder = tokens.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    texts = [f"some words {'k' * 9000}{n} and {n:070d} end\nof text" for n in range(20)]
    for text, ids in zip(texts, encoder.batch(texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert max(map(len, encoder.young)) <= tokens.LONGEST


def test_signs_that_end_words_are_words_of_their_own():
    encoder = tokens.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    texts = ["Alpha, beta. gamma,\nalpha beta, 1. 2, é. Ü, it's, end.", "x), y", ", a. b", "a ,, b. c", "<|endoftext|> a, b. C", "× , ×, a", "漢, a. b", "a.́ b, c", "́, a, b", "a\x01, b. c"]
    for text in texts:
        (ids,) = encoder.batch([text])
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)
    fresh = tokens.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    list(fresh.batch(["alpha, beta. gamma"]))
    assert set(fresh.young) == {b"alpha", b",", b"beta", b".", b"gamma"}
