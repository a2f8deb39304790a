"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints. Per document in a Python worker: XXH64 of every shingle, then a majority per bit.

Links. Two different fingerprints within RADIUS 3 of 64 bits agree on at least two of five bit groups, so every pair meets
under one of ten masks. Distinct fingerprints are dealt by (mask, fingerprint & mask) and sorted; a task then stores the
sorted run as 64 vertical bit planes, compares it with itself shifted by 1, 2, 3 ... places (64 pairs per machine word),
adds the differing bits with carry-save counters, and abandons words in which every pair has passed the radius. A task
emits a spanning forest of each bucket's links, never all pairs.

Large buckets. A bucket of over BUCKET fingerprints is not compared: its members are dealt again under longer masks. Within
a bucket the free bits are cut in four, of which one must agree. Free bits shrink from 38 or more to at most 13 in five
rounds, so a bucket of different fingerprints is then at most 2^13 = BUCKET rows: there is always an exact way.

Groups. Connected components by alternating star contraction on the forest, in tables; copies are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, salted_left_join, written

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 8192
#: A run of whole buckets is compared at once up to so many rows.
RUN = 65_536

_ALL = (1 << 64) - 1


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority fingerprint of the word shingles of text, A-Z in lower case; 0 for a text without words."""
    # bytes.split() separates at exactly the six ASCII white-space characters
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """Add fp (64 bits as a signed long) to the columns of docs other than text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps, pa.int64())], names=[*rest, "fp"])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of parts nearly equal groups of the given bit numbers."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def first_masks(radius: int = RADIUS) -> list[int]:
    """Any two fingerprints within the radius agree on one of these masks."""
    return [a | b for a, b in combinations(_cut(list(range(64)), radius + 2), 2)]


def next_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that extend mask; members of a bucket that are within the radius agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _cut(free, radius + 1)]


class _Forest:
    """Union-find over positions, with whole arrays of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            up = self.parent[found]
            if (up == found).all():
                return found
            found = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each step hooks every root that still has a pair under one smaller root, so a step halves what is left."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            left = ra != rb
            a, b, ra, rb = a[left], b[left], ra[left], rb[left]
            if not len(a):
                return
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(self.parent, high, low)


def bit_sliced_forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within radius (at most 3) between rows of a same group, as a spanning forest: (row, root row) arrays.

    fps: uint64; group: equal numbers stand together.
    """
    n = len(fps)
    forest = _Forest(n)
    sizes = np.bincount(np.concatenate([[0], np.cumsum(np.diff(group) != 0)])) if n else np.zeros(1, int)
    if n < 2 or sizes.max() < 2:
        return np.zeros(0, int), np.zeros(0, int)
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((words * 64 - n, 64), np.uint8)])
    most = int(sizes.max())
    planes = np.zeros((64, words + most // 64 + 2), dtype=np.uint64)
    planes[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    # rows that have a partner d places on
    last = np.repeat(np.cumsum(sizes), sizes)
    room = last - np.arange(n) - 1
    for d in range(1, most):
        valid = np.zeros(words * 64, np.uint8)
        valid[:n] = room >= d
        mask = np.packbits(valid, bitorder="little").view("<u8")
        at = np.flatnonzero(mask)
        mask = mask[at]
        step, shift = divmod(d, 64)
        right, left = np.uint64(shift), np.uint64((64 - shift) % 64)
        ones = np.zeros(len(at), np.uint64)
        twos, over = ones.copy(), ones.copy()
        for k in range(0, 64, 2):
            pair = []
            for b in (k, k + 1):
                ahead = planes[b, at + step]
                if shift:
                    ahead = (ahead >> right) | (planes[b, at + step + 1] << left)
                pair.append(planes[b, at] ^ ahead)
            x, y = pair
            half = x ^ y
            carry = (x & y) | (half & ones)
            ones ^= half
            over |= twos & carry
            twos ^= carry
            if k % 8 == 6:
                alive = (mask & ~over) != 0
                if not alive.any():
                    at = at[:0]
                    break
                if alive.mean() < 0.7:
                    at, mask, ones, twos, over = at[alive], mask[alive], ones[alive], twos[alive], over[alive]
        if not len(at):
            continue
        near = mask & ~over
        if radius < 3:
            count_over = {0: ones | twos, 1: twos, 2: ones & twos}[radius]
            near &= ~count_over
        hit = np.flatnonzero(near)
        if len(hit):
            place = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(place)
            rows = at[hit[w]] * 64 + b
            forest.join(rows, rows + d)
    roots = forest.roots(np.arange(n))
    linked = np.flatnonzero(roots != np.arange(n))
    return linked, roots[linked]


LINK_SCHEMA = "a long, b long, mask long"


def _compare(batches: Iterator[pa.RecordBatch], bucket: int = BUCKET, radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Sorted (mask, key, fp) rows -> links (a, b, null) and members of large buckets (fp, null, longer mask)."""

    def pack(a: np.ndarray, b: np.ndarray | None, masks: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), empty if b is None else pa.array(b, pa.int64()), empty if masks is None else pa.array(masks, pa.int64())], names=["a", "b", "mask"])

    def large(mask: int, fps: np.ndarray) -> pa.RecordBatch:
        longer = [_signed(m) for m in next_masks(mask & _ALL, radius)]
        return pack(np.repeat(fps, len(longer)), None, np.tile(np.array(longer, np.int64), len(fps)))

    def whole(mask: np.ndarray, key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        group = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        size = np.bincount(group)[group]
        for g in np.unique(group[size > bucket]):
            at = np.flatnonzero(group == g)
            yield large(int(mask[at[0]]), fps[at])
        few = (size > 1) & (size <= bucket)
        a, b = bit_sliced_forest(fps[few].view(np.uint64), group[few], radius)
        if len(a):
            yield pack(fps[few][a], fps[few][b], None)

    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    spilling: tuple[int, int] | None = None  # a bucket already known to be large: its further rows pass through
    for batch in batches:
        cols = [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("mask", "key", "fp")]
        if spilling:
            same = (cols[0] == spilling[0]) & (cols[1] == spilling[1])
            if same.any():
                yield large(spilling[0], cols[2][same])
                cols = [c[~same] for c in cols]
            if not len(cols[0]):
                continue
            spilling = None
        held.append(tuple(cols))
        count += len(cols[0])
        if count < RUN:
            continue
        mask, key, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1]) + 1 if (mask[0] != mask[-1] or key[0] != key[-1]) else 0
        yield from whole(mask[:cut], key[:cut], fps[:cut])
        rest = (mask[cut:], key[cut:], fps[cut:])
        if len(rest[0]) > bucket:
            yield large(int(rest[0][0]), rest[2])
            spilling, held, count = (int(rest[0][0]), int(rest[1][0])), [], 0
        else:
            held, count = [rest], len(rest[0])
    if held:
        yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, bucket: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """distinct (fp, unique) -> links (a, b): a forest with the same components as all pairs within the radius."""
    if bucket < 16:
        raise ValueError("buckets under 16 rows need not come to an end")
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in first_masks(radius)])
    todo = distinct.select("fp", F.explode(masks).alias("mask"))
    found = None
    while True:
        keyed = todo.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
        step = written(dealt.mapInArrow(lambda it: _compare(it, bucket, radius), LINK_SCHEMA), "simhash-links")
        got = step.where(F.col("b").isNotNull()).select("a", "b")
        found = got if found is None else found.unionByName(got)
        todo = step.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "mask")
        if todo.isEmpty():
            return found


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (node, root) for every node of an edge; root is the smallest node of its component.

    Alternating large-star and small-star contraction: each step joins every node with the minimum of its neighbours and
    is written to the shared folder. Joins are between two shuffled tables, so Spark can split a hot node.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            around = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = written(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        joined = around.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        found = written(moved.where("a <> b").distinct(), name)
        discard(least, pairs)
        return found

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = mark(pairs)
    while before[0]:
        pairs = star(star(pairs, True), False)
        now = mark(pairs)
        if now == before:
            break
        before = now
    # stable: every node hangs directly under its root
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prints (doc_id, fp) -> (fp, component_id, _root) for fingerprints that several rows share or that are linked.

    _root names the class where no row of it has an id.
    """
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")), "simhash-distinct")
    linked = written(components(links(distinct.select("fp"), bucket), "simhash-components"), "simhash-members")
    known = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = written(known, "simhash-known")
    ids = known.groupBy("root").agg(F.min("_first").alias("component_id"), F.sum("_n").alias("_rows")).where("_rows > 1")
    ids = written(ids.select("root", "component_id"), "simhash-ids")
    return written(known.join(ids, "root").select("fp", "component_id", F.col("root").alias("_root")), "simhash-classes")


def hex_fp(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give a row each. Null ids are never
    the smallest; a class without any id has a null component_id. An empty table gives no rows.
    """
    prints = written(fingerprints(docs.select("doc_id", "text")), "simhash-prints")
    known = classes(prints, bucket).drop("_root")
    rows = salted_left_join(prints, known, ["fp"], F.coalesce("doc_id", F.lit(0).cast("long")))
    return rows.select("doc_id", hex_fp(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _text_key() -> Column:
    """A text's 64-bit hash. Rows of one id whose texts have one hash count as equal; it is never compared across ids."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_per_class(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs without near-duplicates: of each class exactly one row stays, with the columns of docs.

    It is the row with the smallest doc_id (null last; of rows with that id, the one whose text has the smallest hash; of
    equal rows any). Decisions are made on rows, (doc_id, hash of the text), not on ids: different texts that share an id
    are judged each, and rows without an id are deduplicated like others. Null and empty texts are one class. An empty
    table gives no rows. The texts meet only the list of rows that go, by an anti join.
    """
    prints = written(fingerprints(docs.select("doc_id", _text_key().alias("_th"), "text")), "simhash-prints")
    known = classes(prints, bucket)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    rows = prints.groupBy("doc_id", "_th", "fp").agg(F.count("*").alias("_n"))
    # classes are joined to distinct rows, with salt: copies under many ids may share one fingerprint
    rows = written(salted_left_join(rows, known.drop("component_id"), ["fp"], F.xxhash64("doc_id", "_th")).where(F.col("_root").isNotNull()), "simhash-rows")
    best = written(rows.groupBy("_root").agg(F.min(order).alias("_best")), "simhash-best")
    judged = salted_left_join(rows, best, ["_root"], F.xxhash64("doc_id", "_th")).withColumn("_stays", order == F.col("_best"))
    marked = written(judged.where("not _stays or _n > 1").select(F.col("doc_id").alias("_id"), F.col("_th").alias("_hash"), "_stays"), "simhash-marked")

    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), _text_key().alias("_th"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_hash"))
    kept = packed.join(marked, same, "left_anti")
    repeated = marked.where("_stays").select("_id", "_hash")
    if not repeated.isEmpty():
        kept = kept.unionByName(packed.join(repeated, same, "left_semi").groupBy("_own", "_th").agg(F.first("_row").alias("_row")).select("_row", "_own", "_th"))
    return kept.select("_row.*")
