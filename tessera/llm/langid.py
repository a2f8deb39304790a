"""Language identification by words first, then by progressively shorter character n-grams.

Training counts words and the character n-grams of distinct words (orders 1 to 4, with word ends marked) per language on
a bounded sample of labelled documents, and keeps the most frequent of each: the model has at most
``MAX_WORDS + 4 * MAX_GRAMS`` entries per language, and is broadcast. A known word is scored by its smoothed log frequency
in every language; an unknown word backs off to the longest order of which the model knows a gram, and takes the mean of
those grams. A document's score is the sum over its words.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, written

#: Training documents per language, the words and the n-grams of each order kept per language: documented bounds.
PER_LANGUAGE = 1000
MAX_WORDS = 20_000
MAX_GRAMS = 5_000
#: Entries of a model in all: with very many languages each keeps its share of them, so the driver's memory is bounded.
MODEL_ENTRIES = 2_000_000
ORDERS = (4, 3, 2, 1)
#: Vectors of words that a Python worker remembers.
CACHE = 400_000
#: Words times languages that a Python worker remembers.
CELLS = 80_000_000
#: Words times languages whose vectors are made together.
PART_CELLS = 100_000


def _ranges(categories: str, last: int = sys.maxunicode) -> str:
    """The code points up to last of general categories that begin with one of the given letters, as ranges of a character class."""
    found: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] in categories:
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in found)


@lru_cache(maxsize=2)
def _letters(last: int = sys.maxunicode) -> re.Pattern:
    # a letter, then letters and marks: vowel signs belong to their word, and superscripts or fractions are no letters
    return re.compile(f"[{_ranges('L', last)}][{_ranges('LM', last)}]*")


#: ASCII letters as they are and a blank for all else: a plain split finds their runs.
_ASCII = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + b" " * 128
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters with their marks."""
    value = text.lower()
    if value.isascii():
        return value.encode().translate(_ASCII).decode().split()
    # classes are tables up to U+FFFF and lists of ranges beyond: each character that is not in them is compared with all
    return _letters(sys.maxunicode if _ASTRAL.search(value) else 0xFFFF).findall(value)


def grams_of(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def count_grams(pairs: Iterable[tuple[str, str]]) -> Counter:
    """(text, lang) pairs -> counts of (lang, kind, gram); kind 0 is words, else the order of the n-gram."""
    found: Counter = Counter()
    for text, lang in pairs:
        for word, n in Counter(words_of(text or "")).items():
            found[lang, 0, word] += n
            for order in ORDERS:
                for gram in grams_of(word, order):
                    found[lang, order, gram] += 1
    return found


class Table:
    """Gram -> log frequencies over languages. Only the languages that have a gram are stored for it."""

    def __init__(self, counts: list[tuple[int, str, int]], n_langs: int):
        self.at: dict[str, int] = {}
        rows = np.array([self.at.setdefault(gram, len(self.at)) for _, gram, _ in counts], dtype=np.int64)
        order = np.argsort(rows, kind="stable")
        langs = np.array([c[0] for c in counts], dtype=np.int32)[order]
        n = np.array([c[2] for c in counts], dtype=np.float64)[order]
        floor = 0.5
        total = np.maximum(np.bincount(langs, weights=n, minlength=n_langs), 1.0) + floor * len(self.at)
        self.unseen = np.log(floor / total).astype(np.float32)
        self.langs, self.logs = langs, np.log((n + floor) / total[langs]).astype(np.float32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.at)))])

    def __contains__(self, gram: str) -> bool:
        return gram in self.at

    def __getitem__(self, gram: str) -> np.ndarray:
        return self.rows([self.at[gram]])[0]

    def rows(self, at: list[int]) -> np.ndarray:
        """The log frequencies of grams, given by their places, a row each."""
        places = np.array(at, dtype=np.int64)
        starts, sizes = self.ends[places], self.ends[places + 1] - self.ends[places]
        held = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = np.tile(self.unseen, (len(places), 1))
        found[np.repeat(np.arange(len(places)), sizes), self.langs[held]] = self.logs[held]
        return found


class Model:
    """Log frequency vectors over languages for words and n-grams; its size grows with the entries, not with entries x languages."""

    def __init__(self, counts: Iterable[tuple[str, int, str, int]]):
        rows = list(counts)
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        kinds: dict[int, list[tuple[int, str, int]]] = {}
        for lang, kind, gram, n in rows:
            kinds.setdefault(kind, []).append((at[lang], gram, n))
        self.tables = {kind: Table(found, len(at)) for kind, found in kinds.items()}

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, else the mean of the known grams of the longest order that has any, else zeros."""
        found = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        known = {kind: table.at.get for kind, table in self.tables.items()}
        whole = known.get(0, {}.get)
        orders = [(order, known[order]) for order in ORDERS if order in known]
        # by kind: the words, the grams of all of them, and how many of these each has
        held: dict[int, tuple[list[int], list[int], list[int]]] = {kind: ([], [], []) for kind in known}
        for k, word in enumerate(words):
            kind, got = 0, [at] if (at := whole(word)) is not None else []
            if not got:
                for kind, get in orders:  # noqa: B007
                    got = [at for gram in grams_of(word, kind) if (at := get(gram)) is not None]
                    if got:
                        break
            if got:
                rows, places, sizes = held[kind]
                rows.append(k)
                places += got
                sizes.append(len(got))
        for kind, (rows, places, sizes) in held.items():
            if rows:
                n = np.array(sizes)
                sums = np.add.reduceat(self.tables[kind].rows(places), np.cumsum(n) - n, axis=0)
                found[rows] = sums / n[:, None].astype(np.float32)
        return found

    def vector(self, word: str) -> np.ndarray:
        return self.vectors([word])[0]


class Scorer:
    """Scores texts with a model; remembers word vectors up to a bound."""

    def __init__(self, model: Model, cache: int = CACHE):
        self.model, self.most, self.seen = model, min(cache, max(1024, CELLS // max(1, len(model.langs)))), {}
        self.matrix = np.zeros((1024, max(1, len(model.langs))), dtype=np.float32)

    def _add(self, words: list[str]) -> None:
        part = max(1, PART_CELLS // max(1, len(self.model.langs)))
        for at in range(0, len(words), part):
            some = words[at : at + part]
            k = len(self.seen)
            while k + len(some) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[k : k + len(some)] = self.model.vectors(some)
            self.seen.update(zip(some, range(k, k + len(some)), strict=True))

    def score(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text or ""))
        if not counts or not self.model.langs:
            return "und", 0.0
        if len(self.seen) + len(counts) > self.most:
            self.seen.clear()
        seen = self.seen
        new = [w for w in counts if w not in seen]
        if new:
            self._add(new)
        at = [seen[w] for w in counts]
        n = np.fromiter(counts.values(), dtype=np.float32, count=len(at))
        total = n @ self.matrix[at]
        total = (total - total.max()).astype(np.float64) * min(1.0, 20.0 / float(n.sum()))
        p = np.exp(total)
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


#: The last scorer of this Python worker: its word vectors serve all tasks of a query.
_SCORERS: dict[str, Scorer] = {}


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """labelled (doc_id, text, lang), lang not null -> model from per_language documents of each language.

    The documents are those with the smallest seeded hash of id and text, so reruns agree and the sample spreads over the
    table, rows without an id included. Rows that repeat id and text are one document. No language is left out. Counting is
    distributed; at most max_words + 4 * max_grams entries per language, and about MODEL_ENTRIES in all, reach the driver.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id", "text"), 1)
    # a share of each language that holds per_language rows almost surely is drawn first, so the window stays small
    drawn_by = labelled.select("lang", draw.alias("_draw"))
    sizes = written(drawn_by.groupBy("lang").agg(F.approx_count_distinct("_draw", 0.02).alias("_n")), "langid-sizes")
    share = F.least(F.lit(1.0), F.lit(1.2 * per_language + 6 * per_language**0.5) / F.col("_n"))
    drawn = lookup(drawn_by, sizes, ["lang"], F.col("_draw")).where(F.col("_draw") <= share * F.lit(float(2**63)))
    order = Window.partitionBy("lang").orderBy("_draw")
    picked = drawn.select("lang", "_draw").distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language)
    last = written(picked.groupBy("lang").agg(F.max("_draw").alias("_last")), "langid-last")
    found = lookup(labelled.select("text", "lang", draw.alias("_draw")), last, ["lang"], F.col("_draw")).where(F.col("_draw") <= F.col("_last"))
    sample = found.dropDuplicates(["lang", "_draw"])
    room = max(1.0, sizes.count() * (max_words + len(ORDERS) * max_grams) / MODEL_ENTRIES)
    max_words, max_grams = max(100, int(max_words / room)), max(100, int(max_grams / room))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_grams(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang string, kind int, gram string, n long")
    grams = grams.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    kept = grams.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams))
    return Model(tuple(r) for r in kept.select("lang", "kind", "gram", "n").collect())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held columns of docs, lang_pred and score for each row of docs (text and further slim columns).

    Null texts and texts without a letter give ``und`` and 0. Ties go to the first language in code point order. Columns
    of docs that are named like ours are replaced; repeated rows give a row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        for batch in batches:
            got = [scorer.score(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest, "text").mapInArrow(run, schema)
