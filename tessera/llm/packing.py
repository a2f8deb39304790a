"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Tokens. Documents are encoded unit by unit (a blank or line feed and what follows it): a byte-level tokenizer that splits
before it merges never looks across the last white space before a word, so the ids of a text are those of its units. A
document ends with an id of its own; only documents longer than a sequence are cut, and only their first piece is shorter.

Rounds. Pieces that fill a sequence are done. For the others a lower bound of the sequences is opened, from counts by
length; then, round by round, unplaced pieces and the gaps of open sequences are range-sorted together by length, gap and
id, so neither a common length nor a common gap meets in one task. Each task sweeps its range upwards, and each gap takes
the largest piece below it that is free: both best fit and successor, as the piece's next larger gap is that gap. What a
task cannot match is summed up by two numbers, its unmatched gaps and pieces, in the order of a bracket sequence; the
driver matches these numbers range against range, and pieces and gaps that meet get the same number by their rank, on
which they are joined: no gap is taken twice, and no conflict needs a second try. Gaps shrink, and the next round starts.
When no piece fits any gap, the bound for what is left is opened. Every state is a written table.

The last FINISH rows. When no more pieces and gaps than these are left, one range holds them all, and its task sweeps, and
opens what is needed, until every piece has a place.

Small pieces. Where more than ITEMS pieces would go to a sequence, pieces of up to 1 / SMALL of it are joined in bundles,
all but some LOOSE a sequence that remain to fill what is left at the end; so rounds don't grow with the number of pieces.

Defined cases. A null or empty text is its end id alone. Rows with a null or repeated doc_id are packed row by row. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_WORD_BEFORE, written

CAPACITY = 2048
END_ID = 0
#: Pieces a sequence on average beyond which small ones are bundled, what is small, and what stays loose.
ITEMS, SMALL, LOOSE = 16, 16, 8
#: Rows of a range, and rows at which one range holds all that is left.
RANGE_ROWS, FINISH = 100_000, 16_000
#: Bytes of units and ids that a Python worker remembers, in each of two generations; longer units are not remembered.
CACHE_BYTES, LONGEST = 128 << 20, 64
#: Bytes that Python needs for an entry beside its key and ids, and words that the library encodes together.
ENTRY, AT_ONCE = 200, 20_000

# ---------------------------------------------------------------- tokens

#: What Unicode calls white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNITS = re.compile(f"[ \\n]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: First bytes of white space beyond ASCII.
_LEADS = frozenset(b"\xc2\xe1\xe2\xe3")
#: Keys of a comma and a full stop that stand after a letter or digit and before a blank: there, too, no token goes on.
_COMMA, _STOP = b"\x01", b"\x02"
_SIGNS = {_COMMA: b",", _STOP: b"."}
_MARKS, _ALNUM = string.punctuation.encode(), frozenset((string.ascii_letters + string.digits).encode())
_STARTS_WHITE = re.compile(f"[{_WHITE}]")


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer, one distinct unit at a time.

    Texts whose only white space is single blanks and line feeds between words are split at those, and before commas and
    full stops that end a word; a key is the word after a blank, the line feed and its word, the sign's own, or, where a text
    begins, a blank and the word (no other key has a blank). Other texts are split by the pattern of units, and texts with a
    special token, or a character that stands for a sign, are left to the library. Unknown units are
    encoded together with line feeds between them. Units are remembered in two generations of CACHE_BYTES at most.
    """

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), cache
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.feed,) = self._library("\n")
        self.young: dict[bytes, bytes | bool] = {}
        self.old: dict[bytes, bytes | bool] = {}
        self.tails: dict[bytes, bytes] = {}
        self.size = 0

    def _library(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        found: list[tuple[list[bytes], list, list[int]] | None] = []
        for text in texts:
            raw = text.replace("\n", " \n").encode()
            if _COMMA in raw or _STOP in raw or any(s in text for s in self.special):
                found.append(None)
                continue
            if not NO_WORD_BEFORE.search(raw):
                raw = raw.replace(b", ", b" " + _COMMA + b" ").replace(b". ", b" " + _STOP + b" ")
            words: list[bytes] = raw.split(b" ") if raw else []
            if raw:
                words[0] = b" " + words[0]
            ids = list(map(self.young.get, words))
            holes, at = [], -1
            for _ in range(ids.count(None)):
                holes.append(at := ids.index(None, at + 1))
            found.append((words, ids, holes))
        new = self._learn({f[0][k] for f in found if f for k in f[2]})
        for text, held in zip(texts, found, strict=True):
            if held is None:
                yield np.array(self._library(text), "<u4")
                continue
            words, ids, holes = held
            for k in holes:
                ids[k] = new[words[k]]
            try:
                raw = b"".join(ids)
            except TypeError:  # a word that begins with white space has no ids of its own
                raw = self._by_units(text)
            yield np.frombuffer(raw, "<u4")

    def _by_units(self, text: str) -> bytes:
        """Ids of a text with runs of white space."""
        units = [u.encode() for u in _UNITS.findall(text)]
        # a blank and its word, or a word alone, has a key; white space and line feeds are encoded as they are
        keys = [u[1:] if u[:1] == b" " and len(u) > 1 else u if u[:1] == b"\n" and len(u) > 1 else b" " + u for u in units]
        found = self._learn(set(keys))
        return b"".join(found[k] or np.array(self._library(u.decode()), "<u4").tobytes() for k, u in zip(keys, units, strict=True))

    def _learn(self, keys: set[bytes]) -> dict[bytes, bytes | bool]:
        """The ids of these keys, False for those that have none of their own. All but long ones are remembered."""
        # an intersection with a dictionary would walk through all of it
        found = {k: self.young[k] for k in keys if k in self.young}
        new = {k: self.old[k] for k in keys if k in self.old and k not in found}
        names, ids = self._encoded([k for k in keys if k not in found and k not in new])
        new.update(zip(names, ids, strict=True))
        kept = new if not new or len(max(new, key=len)) <= LONGEST else {k: v for k, v in new.items() if len(k) <= LONGEST}
        self.young.update(kept)
        self.size += ENTRY * len(kept) + sum(map(len, kept)) + sum(map(len, filter(None, kept.values())))
        return found | new if found else new

    def _encoded(self, keys: list[bytes]) -> tuple[list[bytes], list[bytes | bool]]:
        """Keys with their ids, False for those that begin with white space."""
        plain, rest, tailed = [], [], []
        for key in keys:
            if not key or key[0] <= 32 or key[0] in _LEADS:
                rest.append(key)
                continue
            stem = key.rstrip(_MARKS)
            if len(stem) == len(key) or not stem or not (stem[-1] in _ALNUM or stem[-1] > 127 and stem.decode()[-1].isalnum()):
                plain.append(key)
            else:
                tailed.append((key, stem, key[len(stem) :]))
        # a run of marks after a letter or digit is split from it, so its ids follow those of the word
        tails = list({t for _, _, t in tailed} - self.tails.keys())
        self.tails.update(zip(tails, self._together(b"", tails), strict=True))
        # one difference each: a further argument would be walked through
        stems = {s for _, s, _ in tailed}.difference(plain).difference(self.young)
        words = {s: self.old[s] for s in stems if s in self.old}
        plain += stems.difference(words)
        ids = self._together(b" ", plain)
        words |= zip(plain, ids, strict=True)
        names = [*plain, *(k for k, _, _ in tailed)]
        ids += [(words.get(s) or self.young[s]) + self.tails[t] for _, s, t in tailed]
        if len(self.tails) > 10_000:
            self.tails = {}
        bare = []
        for key in rest:
            if key in _SIGNS:
                names, ids = [*names, key], [*ids, *self._together(b"", [_SIGNS[key]])]
                continue
            word = key[1:] if key[:1] in (b" ", b"\n") else key
            if not word or _STARTS_WHITE.match(word.decode()):
                names, ids = [*names, key], [*ids, False]
            elif word is key:
                names, ids = [*names, key], [*ids, *self._together(b" ", [key])]
            else:
                bare.append(key)
        feed = np.array([self.feed], "<u4").tobytes()
        found = self._together(b"", [k[1:] for k in bare])
        return names + bare, ids + [feed + v if k[:1] == b"\n" else v for k, v in zip(bare, found, strict=True)]

    def _together(self, before: bytes, words: list[bytes]) -> list[bytes]:
        """Ids of each word with what stands before it, encoded many at once with line feeds between them."""
        out: list[bytes] = []
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            ids = np.array(self._library((before + (b"\n" + before).join(part)).decode()), "<u4")
            cuts = 4 * np.flatnonzero(ids == self.feed)
            if len(cuts) != len(part) - 1:  # a word ends with white space, or has a line feed in it
                out += [np.array(self._library((before + w).decode()), "<u4").tobytes() for w in part]
                continue
            raw = ids.tobytes()
            out += [raw[a:z] for a, z in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    """The encoder of this Python worker for a vocabulary: loading one takes longer than many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole sequences at the end, what is over first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """_uid, doc_id, piece, start, length, ids_crc32 (and ids) of every piece; a written table, so _uid stays."""
    kind = "doc_id long, _uid long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer_path), np.array([end_id], "<u4")
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                rows = []
                for key, ids in zip(batch.column(0).to_pylist(), encoder.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        part = ids[start : start + length]
                        rows.append((key, uid, k, start, length, zlib.crc32(part.tobytes()), part))
                        uid += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                out = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, cols[6])])
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cols[6]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return written(docs.select("doc_id", "text").mapInArrow(run, kind), "packing-pieces")


# ---------------------------------------------------------------- rounds


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the sequences for pieces counted by length: by their sum, and by how few long ones share one."""
    best, longer = -(-sum(s * n for s, n in counts.items()) // capacity), 0
    order = sorted(counts, reverse=True)
    for k in range(1, capacity):
        while order and order[0] * (k + 1) > capacity:
            longer += counts[order.pop(0)]
        best = max(best, -(-longer // k))
        if not order:
            break
    return best


STATE = "uid long, size int, bin long, gap int, part int, rank long"


def swept(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(size, uid) and (gap, bin) in ascending order -> matches (uid, size, bin, gap), free pieces and free gaps in order.

    Upwards, each gap takes the largest free piece that is not larger than it."""
    matches, alone, free = [], [], []
    at, n = 0, len(pieces)
    for gap, name in gaps:
        while at < n and pieces[at][0] <= gap:
            free.append(pieces[at])
            at += 1
        if free:
            size, uid = free.pop()
            matches.append((uid, size, name, gap))
        else:
            alone.append((gap, name))
    return matches, free + pieces[at:], alone


def _sorted_range(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(size, uid) of the pieces and (gap, bin) of the gaps that reach a task, in order."""
    held: tuple[list, list] = ([], [])
    for batch in batches:
        for key, kind, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[kind].append((key, tie))
    return sorted(held[0]), sorted(held[1])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range's matches, of free pieces, and of gaps without a piece, the last two with their rank."""
    part = TaskContext.get().partitionId()
    matches, free, alone = swept(*_sorted_range(batches))
    rows: list[tuple] = [(*m, part, None) for m in matches]
    rows += [(None, None, name, gap, part, k) for k, (gap, name) in enumerate(alone)]
    rows += [(uid, size, None, None, part, k) for k, (size, uid) in enumerate(free)]
    if rows:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in STATE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def finished(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int, opened: int) -> Iterator[tuple]:
    """The rounds of one range that holds everything: matches until every piece has a place; sequences are numbered on from opened."""
    while pieces:
        if not gaps or gaps[-1][0] < pieces[0][0]:
            new = least_sequences(Counter(size for size, _ in pieces), capacity)
            gaps = [(capacity, -1 - k) for k in range(opened, opened + new)]
            opened += new
        matches, pieces, gaps = swept(pieces, gaps)
        yield from matches
        gaps = sorted([*gaps, *((gap - size, name) for _, size, name, gap in matches if gap > size)])


def matched_ranges(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Of (range, free gaps, free pieces) in order: (number of the first match, range and first and last + 1 rank of
    pieces, range and first and last + 1 rank of gaps). All gaps of a range stand before its free pieces; a gap takes the
    last free piece before it, so the n-th gap of a match meets the n-th last piece."""
    stack: list[list[int]] = []
    found, number = [], 0
    for part, gaps, free in sorted(counts):
        at = 0
        while at < gaps and stack:
            top = stack[-1]
            take = min(gaps - at, top[1])
            found.append((number, top[0], top[1] - take, top[1], part, at, at + take))
            number, at, top[1] = number + take, at + take, top[1] - take
            if not top[1]:
                stack.pop()
        if free:
            stack.append([part, free])
    return found


def _items(loose: DataFrame, gaps: DataFrame) -> DataFrame:
    items = loose.select(F.col("size").alias("key"), F.lit(0).alias("kind"), F.col("uid").alias("tie"))
    return items.unionAll(gaps.select(F.col("gap").alias("key"), F.lit(1).alias("kind"), F.col("bin").alias("tie")))


def _round(loose: DataFrame, gaps: DataFrame, tasks: int) -> tuple[list[DataFrame], DataFrame, DataFrame, int, int, bool]:
    """Placements (uid, size, bin, gap), the pieces (uid, size) and gaps (bin, gap) that are left, their numbers, and whether
    a piece that is left may still fit a gap that is left."""
    spark = loose.sparkSession
    done = written(_items(loose, gaps).repartitionByRange(tasks, "key", "kind", "tie").mapInArrow(_sweep, STATE), "packing-round")
    free, open_ = done.where("bin IS NULL"), done.where("uid IS NULL")
    placed = [done.where("uid IS NOT NULL AND bin IS NOT NULL").select("uid", "size", "bin", "gap")]
    is_free, is_open = F.col("bin").isNull(), F.col("uid").isNull()
    counts = done.groupBy("part").agg(
        F.count_if(is_open).alias("gaps"), F.count_if(is_free).alias("free"), F.count_if(F.col("gap") > F.col("size")).alias("new"),
        F.min(F.when(is_free, F.col("size"))).alias("least"), F.max(F.col("gap") - F.coalesce("size", F.lit(0))).alias("wide"),
    ).collect()  # fmt: skip  a row a range
    ranges = matched_ranges([(r.part, r.gaps, r.free) for r in counts])
    met = sum(r[3] - r[2] for r in ranges)
    free, open_ = free.select("uid", "size", "part", "rank"), open_.select("bin", "gap", "part", "rank")
    if ranges:
        # two rows a range at most
        of = F.broadcast(spark.createDataFrame(ranges, "m long, free_part int, free_low long, free_high long, gap_part int, gap_low long, gap_high long"))
        inside = (F.col("part") == F.col("free_part")) & (F.col("rank") >= F.col("free_low")) & (F.col("rank") < F.col("free_high"))
        free = free.join(of, inside, "left").select("uid", "size", (F.col("m") + F.col("free_high") - 1 - F.col("rank")).alias("m"))
        inside = (F.col("part") == F.col("gap_part")) & (F.col("rank") >= F.col("gap_low")) & (F.col("rank") < F.col("gap_high"))
        open_ = open_.join(of, inside, "left").select("bin", "gap", (F.col("m") + F.col("rank") - F.col("gap_low")).alias("m"))
        placed.append(written(free.where("m IS NOT NULL").join(open_.where("m IS NOT NULL"), "m").select("uid", "size", "bin", "gap"), "packing-met"))
        free, open_ = free.where("m IS NULL"), open_.where("m IS NULL")
    open_ = open_.select("bin", "gap")
    for p in placed:
        open_ = open_.unionAll(p.where("gap > size").select("bin", (F.col("gap") - F.col("size")).alias("gap")))
    left = sum(r.free for r in counts) - met
    # of what the ranges matched among themselves no gap is wider than before, and no piece smaller
    least, wide = min((r.least for r in counts if r.least is not None), default=1), max((r.wide for r in counts if r.wide is not None), default=0)
    return placed, free.select("uid", "size"), open_, left, sum(r.gaps + r.new for r in counts), left > 0 and wide >= least


def _bundles(loose: DataFrame, share: float, most: int) -> DataFrame:
    """uid, size, bundle, inner: pieces of up to most ids in bundles of up to twice as many, but for a share of them; a written
    table. What is not bundled has a null bundle."""
    joined = (F.col("size") <= most) & (F.pmod(F.xxhash64("uid"), F.lit(1000)) >= int(1000 * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = None, 0
        for batch in batches:
            bundle, inner = [], []
            for uid, length, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not own:
                    bundle.append(None)
                    inner.append(0)
                    continue
                if name is None or size + length > 2 * most:
                    name, size = uid, 0
                bundle.append(name)
                inner.append(size)
                size += length
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bundle, pa.int64()), pa.array(inner, pa.int32())], names=["uid", "size", "bundle", "inner"])

    return written(loose.select("uid", "size", joined.alias("_own")).mapInArrow(run, "uid long, size int, bundle long, inner int"), "packing-bundles")


def _finish(loose: DataFrame, gaps: DataFrame, capacity: int, opened: int) -> DataFrame:
    """Placements (uid, size, bin, gap) of all pieces that are left, by one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(finished(*_sorted_range(batches), capacity, opened))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["uid", "size", "bin", "gap"])

    return written(_items(loose, gaps).repartition(1).mapInArrow(run, "uid long, size int, bin long, gap int"), "packing-last")


def best_fit(rows: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, finish: int = FINISH) -> DataFrame:
    """uid, sequence_id, offset of every row of a written table (uid, unique and not negative; size, 1 to capacity)."""
    spark = rows.sparkSession
    rows = rows.select("uid", F.col("size").cast("int").alias("size"))
    placed = [rows.where(F.col("size") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    loose = rows.where(F.col("size") < capacity)
    counted = lambda t: {r["size"]: r["count"] for r in t.groupBy("size").count().collect()}  # noqa: E731  at most capacity rows
    counts = counted(loose)
    bins = least_sequences(counts, capacity)
    inside = None
    if sum(counts.values()) > ITEMS * bins > 0:
        few = sum(n for s, n in counts.items() if s <= capacity // SMALL)
        inside = _bundles(loose, min(1.0, LOOSE * bins / max(1, few)), capacity // SMALL)
        loose = inside.groupBy(F.coalesce("bundle", "uid").alias("uid")).agg(F.sum("size").cast("int").alias("size"))
    found: list[DataFrame] = []
    opened, left, open_rows, fits = 0, loose.count(), 0, False
    gaps = spark.createDataFrame([], "bin long, gap int")
    cores = spark.sparkContext.defaultParallelism
    while left:
        if left + open_rows <= finish:
            found.append(_finish(loose, gaps, capacity, opened))
            break
        if not fits:
            # no piece that is left fits a gap that is left, so those gaps stay
            new = least_sequences(counted(loose), capacity)
            gaps, open_rows = spark.range(opened, opened + new).select((-1 - F.col("id")).alias("bin"), F.lit(capacity).alias("gap")), new
            opened += new
        now, loose, gaps, rest, open_rows, fits = _round(loose, gaps, max(cores, -(-(left + open_rows) // range_rows)))
        found += now
        fits, left = fits and rest < left, rest
    met = [t.select("uid", F.col("bin").alias("sequence_id"), (capacity - F.col("gap")).cast("long").alias("offset")) for t in found]
    if inside is not None and met:
        all_met = met[0]
        for t in met[1:]:
            all_met = all_met.unionAll(t)
        alone = inside.select("uid", F.coalesce("bundle", "uid").alias("_name"), "inner")
        met = [alone.join(all_met.withColumnRenamed("uid", "_name"), "_name").select("uid", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset"))]
    out = placed[0]
    for t in met:
        out = out.unionAll(t)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of docs (doc_id, text)."""
    held = pieces(docs, tokenizer_path, end_id, capacity, with_ids)
    where = best_fit(held.select(F.col("_uid").alias("uid"), F.col("length").alias("size")), capacity)
    return held.join(where.withColumnRenamed("uid", "_uid"), "_uid").drop("_uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids, doc_ids, ids: a row a sequence, from ``pack`` with ids; a group is one sequence's pieces."""
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("_rows")
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), row)
    return held.select("sequence_id", "n_ids", F.col("_rows.doc_id").alias("doc_ids"), F.flatten("_rows.ids").alias("ids"))


def sizes_after(packed: DataFrame) -> Counter:
    """Sequences by how many ids they hold (at most capacity different numbers)."""
    return Counter({r.n_ids: r["count"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids")).groupBy("n_ids").count().collect()})
