"""SentencePiece encoding and decoding by suffix arrays.

Encoding a batch. Texts are split into units at places that no piece spans (a blank mark after another character, and line
feeds), and the distinct units not seen before are concatenated. The concatenation is indexed
by a suffix array (prefix doubling up to the longest piece), every piece is binary-searched for the range of its
occurrences, and the occurrences, edges of a lattice, are sorted by end position and relaxed from left to right.

Relaxing. For merge-rank (BPE) vocabularies the encoding is the one path on which every two neighbours are the encoding of
their concatenation, and the encoding of a prefix ending at a token border is a prefix of the encoding. So a position
needs one token: the edge that ends there whose left neighbour, the token kept at its start, is compatible. Two pieces are
compatible unless, in the order of merges, a merge across their border comes before those that close the border: the pair
of symbols at the border is followed up the two derivations. Derivations are found once per vocabulary.

A unit of over UNIT_CHARS characters (prose without blanks, minified code) is cut where two neighbouring characters stand
together in no piece. What then still has over INDEX_CHARS characters (a run of one letter) is taken in spans that overlap
by the longest piece, so memory beyond one token a character does not grow with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MARK = "▁"
#: Encoded units that a Python worker remembers, in each of two generations.
CACHE = 100_000
#: Texts are taken together up to so many characters.
BATCH_CHARS = 500_000
#: Distinct units are indexed together up to so many characters: the lattice takes some 500 bytes for each.
INDEX_CHARS = 100_000
#: Units of over so many characters are cut further, at safe borders.
UNIT_CHARS = 100
_FAR = np.int64(1) << 40


def merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge neighbours, smallest rank first and leftmost on ties: the final symbols and the last merge."""
    symbols, last = list(symbols), None
    while len(symbols) > 1:
        best, at = min((rank.get(a + b, _FAR), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best == _FAR:
            break
        last = (symbols[at], symbols[at + 1])
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols, last


class Vocabulary:
    """Pieces of a model file with their ranks, derivations and codes; arrays are indexed by piece id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.size = n
        self.bytes_at = {int(names[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        rank = {names[i]: -model.get_score(i) for i in normal}
        # pieces of equal score (runs of blank marks) have equal ranks: the leftmost merge is then first
        dense = {x: k for k, x in enumerate(sorted(set(rank.values())))}
        rank = {name: dense[x] for name, x in rank.items()}
        at = {names[i]: i for i in normal}
        if any(MARK in x.lstrip(MARK) for x in at):
            raise ValueError("a piece spans a blank")
        self.longest = max(map(len, at))
        parts: dict[int, tuple[int, int]] = {}
        self.reachable = np.zeros(n + 1, bool)
        for name, i in at.items():
            done, last = merge(list(name), rank) if len(name) > 1 else ([name], None)
            if done == [name]:
                self.reachable[i] = True
                if last:
                    parts[i] = (at[last[0]], at[last[1]])
        # the chain of symbols at the right (left) border of a piece, from a character up to the piece itself
        right, left = [[n]] * (n + 1), [[n]] * (n + 1)
        for i in sorted(np.flatnonzero(self.reachable), key=lambda i: len(names[i])):
            l, r = parts.get(i, (None, None))
            right[i] = [*(right[r] if r is not None else []), i]
            left[i] = [*(left[l] if l is not None else []), i]
        depth = max(max(map(len, right)), max(map(len, left)))
        table = lambda chains: np.array([c + [c[-1]] * (depth - len(c)) for c in chains], np.int32)
        self.right, self.left = table(right), table(left)
        self.right_n, self.left_n = (np.array([len(c) for c in x], np.int32) for x in (right, left))
        self.rank = np.full(n + 1, _FAR)
        for name, i in at.items():
            self.rank[i] = rank[name]
        keys, ranks = [], []
        for name, i in at.items():
            for k in range(1, len(name)):
                a, b = at.get(name[:k]), at.get(name[k:])
                if a is not None and b is not None and self.reachable[a] and self.reachable[b]:
                    keys.append(a * (n + 1) + b)
                    ranks.append(rank[name])
        order_k = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order_k], np.array(ranks, np.int64)[order_k]
        self.alphabet = {c for x in at for c in x}
        self.code = {c: k + 1 for k, c in enumerate(sorted(self.alphabet))}
        within = {self.code[a] * (len(self.code) + 1) + self.code[b] for x in at for a, b in zip(x, x[1:], strict=False)}
        self.neighbours = np.array(sorted(within), np.int64)
        usable = [i for i in at.values() if self.reachable[i]]
        self.pieces = np.array(usable, np.int64)
        self.length = np.ones(n + 1, np.int64)
        self.length[self.pieces] = [len(names[i]) for i in usable]
        self.letters = np.zeros((len(usable), self.longest), np.int32)
        for k, i in enumerate(usable):
            self.letters[k, : len(names[i])] = [self.code[c] for c in names[i]]
        self.raw = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.bytes_at.items():
            self.raw[i] = bytes([value])
        for i in range(n):
            if model.is_control(i):
                self.raw[i] = b""
        self.unknown_raw = " ⁇ ".encode()
        self.raw[self.unknown] = self.unknown_raw

    def parts(self, unit: str) -> list[str]:
        """unit cut wherever two neighbouring characters stand together in no piece, so that no merge crosses a cut."""
        codes = _codes(np.frombuffer(unit.encode("utf-32-le"), "<u4"), self).astype(np.int64)
        pair = codes[:-1] * (len(self.code) + 1) + codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        cuts = [0, *(np.flatnonzero(self.neighbours[at] != pair) + 1).tolist(), len(unit)]
        return [unit[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (ids; self.size stands for an unknown character) stay apart next to each other."""
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(open_):
            x, y = a[open_], b[open_]
            up_x = np.where(i + 1 < self.right_n[x], self.rank[self.right[x, np.minimum(i + 1, self.right.shape[1] - 1)]], _FAR)
            up_y = np.where(j + 1 < self.left_n[y], self.rank[self.left[y, np.minimum(j + 1, self.left.shape[1] - 1)]], _FAR)
            across = self.pair_rank(self.right[x, i], self.left[y, j])
            bad = (across < _FAR) & (across < up_x) & (across <= up_y)
            good[open_[bad]] = False
            more = ~bad & ((up_x < _FAR) | (up_y < _FAR))
            first = up_x <= up_y
            i, j = (i + first)[more], (j + ~first)[more]
            open_ = open_[more]
        return good


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes in the order of their first depth (or more) codes; beyond the end counts as 0."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range [low, high) of order whose suffixes begin with it; all pieces are searched at once."""
    n = len(order)
    padded = np.concatenate([codes, np.zeros(letters.shape[1] + 1, codes.dtype)])
    low, high = np.zeros(len(letters), np.int64), np.full(len(letters), n, np.int64)
    for d in range(letters.shape[1]):
        at = np.flatnonzero((lengths > d) & (low < high))
        if not len(at):
            break
        want = letters[at, d]
        edges = []
        for side in (0, 1):  # first suffix whose code at d is not below, then not below or equal
            a, z = low[at].copy(), high[at].copy()
            while True:
                going = a < z
                if not going.any():
                    break
                mid = (a + z) >> 1
                here = padded[order[np.minimum(mid, n - 1)] + d]
                below = here < want if side == 0 else here <= want
                a = np.where(going & below, mid + 1, a)
                z = np.where(going & ~below, mid, z)
            edges.append(a)
        low[at], high[at] = edges
    return low, np.maximum(low, high)


def _edges(codes: np.ndarray, inside: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of every occurrence of a piece in codes, and of every character of inside that is not in the vocabulary."""
    order = suffix_array(codes, vocab.longest)
    low, high = occurrence_ranges(codes, order, vocab.letters, vocab.length[vocab.pieces])
    counts = high - low
    full = np.flatnonzero(counts)
    counts = counts[full]
    piece = np.repeat(vocab.pieces[full], counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = order[np.repeat(low[full], counts) + offset]
    # characters outside the vocabulary are edges of their own, compatible with everything
    odd = np.flatnonzero((codes == 0) & inside)
    return np.concatenate([piece, np.full(len(odd), vocab.size)]), np.concatenate([start, odd])


def _relax(kept: np.ndarray, piece: np.ndarray, start: np.ndarray, step: np.ndarray, vocab: Vocabulary) -> None:
    """Take the edges in the order of step: an edge whose left neighbour is compatible is the token that ends where it does."""
    by = np.argsort(step, kind="stable")
    piece, start, step = piece[by], start[by], step[by]
    end = start + vocab.length[piece]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]]) if len(step) else np.zeros(1, np.int64)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        before, now = kept[start[a:z]], piece[a:z]
        good = before == -1
        check = np.flatnonzero(before >= 0)
        if len(check):
            pair, back = np.unique(before[check].astype(np.int64) * (vocab.size + 1) + now[check], return_inverse=True)
            good[check] = vocab.compatible(pair // (vocab.size + 1), pair % (vocab.size + 1))[back]
        kept[end[a:z][good]] = now[good]


def _codes(points: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    distinct, where = np.unique(points, return_inverse=True)
    return np.array([vocab.code.get(chr(c), 0) if c else 0 for c in distinct], np.int32)[where]


def _octets(point: int, vocab: Vocabulary) -> list[int]:
    """Ids of a character outside the vocabulary."""
    return [vocab.bytes_at[o] for o in chr(point).encode()] if vocab.bytes_at else [vocab.unknown]


def encode_long(unit: str, vocab: Vocabulary, span: int = INDEX_CHARS) -> bytes:
    """Ids of one unit of any length. The lattice is made for span characters at a time.

    The edges that end in a span start at most the longest piece before it, so a window of span and that margin holds them
    all, and what is carried on is one token a position.
    """
    points = np.frombuffer(unit.encode("utf-32-le"), "<u4")
    n, margin = len(points), vocab.longest
    kept = np.full(n + 1, -2, np.int32)
    kept[0] = -1
    for at in range(0, n, span):
        low, high = max(0, at - margin), min(n, at + span)
        codes = _codes(points[low:high], vocab)
        piece, start = _edges(codes, np.ones(len(codes), bool), vocab)
        start = start + low
        end = start + vocab.length[piece]
        now = end > at
        _relax(kept, piece[now], start[now], end[now], vocab)
    ids: list[np.ndarray] = []
    at = n
    found: list[int] = []
    while at:
        token = int(kept[at])
        if token == -2:
            raise ValueError("a unit has no encoding")
        found += reversed(_octets(int(points[at - 1]), vocab)) if token == vocab.size else [token]
        at -= int(vocab.length[token])
        if len(found) >= INDEX_CHARS:
            ids.append(np.array(found, "<u4"))
            found = []
    ids.append(np.array(found, "<u4"))
    return np.concatenate(ids)[::-1].tobytes()


def encode_units(units: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each distinct unit as little-endian unsigned 32-bit integers."""
    sizes = np.array([len(u) for u in units], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # one separator after each unit
    text = "\x00".join(units) + "\x00"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    codes = _codes(points, vocab)
    n = len(codes)
    inside = np.ones(n, bool)
    inside[starts + sizes] = False
    piece, start = _edges(codes, inside, vocab)
    unit = np.repeat(np.arange(len(units)), sizes + 1)
    # kept[p]: the token that ends before position p; -1 at the start of a unit, -2 not reached
    kept = np.full(n + 1, -2, np.int64)
    kept[starts] = -1
    _relax(kept, piece, start, start + vocab.length[piece] - starts[unit[start]], vocab)
    # walk back from the ends of all units at once
    ends, found, owner = starts + sizes, [], []
    at, who = ends.copy(), np.arange(len(units))
    while len(at):
        token = kept[at]
        if (token == -2).any():
            raise ValueError("a unit has no encoding")
        going = token >= 0
        at, who, token = at[going], who[going], token[going]
        found.append((at, token))
        owner.append(who)
        at = at - vocab.length[token]
    if not found:
        return [b""] * len(units)
    position, token, who = np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found]), np.concatenate(owner)
    by = np.argsort(position, kind="stable")
    position, token, who = position[by], token[by], who[by]
    splits = np.searchsorted(who, np.arange(len(units) + 1)).tolist()
    if not (token == vocab.size).any():
        raw = token.astype("<u4").tobytes()
        return [raw[4 * a : 4 * z] for a, z in zip(splits, splits[1:], strict=False)]
    out = []
    for a, z in zip(splits, splits[1:], strict=False):
        ids: list[int] = []
        for p, t in zip(position[a:z].tolist(), token[a:z].tolist(), strict=True):
            ids += [t] if t != vocab.size else _octets(int(points[p - 1]), vocab)
        out.append(np.array(ids, "<u4").tobytes())
    return out


class Encoder:
    """Encodes texts; remembers units in two generations of at most CACHE each."""

    def __init__(self, vocab: Vocabulary, cache: int = CACHE):
        self.vocab, self.most = vocab, cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.units = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n").findall

    def batch(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            new = set().union(*split)
        missing = []
        for unit in new:
            known = self.old.get(unit)
            if known is None:
                missing.append(unit)
            else:
                self.young[unit] = known
        if missing:
            long = [u for u in missing if len(u) > INDEX_CHARS]
            self.young.update((u, encode_long(u, self.vocab)) for u in long)
            missing = sorted(u for u in missing if len(u) <= INDEX_CHARS)
            at = size = 0
            for k, unit in enumerate(missing):
                size += len(unit) + 1
                if size >= INDEX_CHARS or k == len(missing) - 1:
                    part = missing[at : k + 1]
                    self.young.update(zip(part, encode_units(part, self.vocab), strict=True))
                    at, size = k + 1, 0
        get = self.young.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def split(self, text: str) -> list[str]:
        units = self.units((MARK + text).replace(" ", MARK))
        if max(map(len, units)) <= UNIT_CHARS:
            return units
        return [p for u in units for p in ([u] if len(u) <= UNIT_CHARS else self.vocab.parts(u))]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.vocab.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process for a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = batch.column(column).to_pylist()
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS or k == len(texts) - 1:
            yield batch.slice(a, k + 1 - a), texts[a : k + 1]
            a, size = k + 1, 0


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip and, unless left out, ids.

    docs (text and others); the other columns are kept. round_trip tells whether decoding the ids gives the text again,
    which fails only for texts that hold the blank mark U+2581 itself. A null or empty text has no ids. Rows that repeat a
    text have equal ids; an empty table gives no rows. Columns of docs that are named like ours are replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids_crc32", "round_trip", "ids")]
    schema = docs.select(*rest).schema.add("n_tokens", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch, texts in _batches(whole, "text"):
                raw = encoder.batch([t or "" for t in texts])
                lists = [np.frombuffer(x, "<u4") for x in raw]
                same = [encoder.decode(ids) == (t or "") for ids, t in zip(lists, texts, strict=True)]
                columns = [batch.column(c) for c in rest] + [pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same)]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*rest, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids and others) -> the others with text; null ids give a null text."""
    rest = [c for c in encoded.columns if c != "ids"]
    schema = encoded.select(*rest).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*rest, F.col("ids")).mapInArrow(run, schema)
