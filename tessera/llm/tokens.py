"""Token ids in a binary format of shuffled byte or bit planes.

A segment holds whole documents in ascending id order. Its ids, 32-bit unsigned, are cut into fixed-size blocks; the
block is transposed into 4 byte planes or 32 bit planes, and every plane is compressed with zstandard on its own (the
planes of high bits are nearly constant and vanish). The segment starts with a header and a chunk index of plane
lengths, so one block can be read without the others.

Layout, little-endian: magic ``TPLN``, version u16, bits per plane u16 (8 or 1), ids per block u32, number of ids u64,
number of blocks u32, planes per block u32; then for each block and plane the compressed length u32; then the planes.
Segments are rows of a Parquet table (written through the commit protocol of any file system) with the ids and lengths of
their documents.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import NO_WORD_BEFORE, scratch

MAGIC = b"TPLN"
HEAD = struct.Struct("<4sHHIQII")
BLOCK_IDS = 65_536
SEGMENT_IDS = 1_000_000
LEVEL = 1
#: Input of a shuffle partition as the optimizer estimates it (compressed files), and the most partitions.
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 100_000
END_ID = 1
#: A control character that stands between words which are encoded together.
MARK = b"\x01"
#: Words whose ids a Python worker remembers, and the bytes of the longest of them.
CACHE, LONGEST = 400_000, 64


def _planes(ids: np.ndarray, bits: int) -> list[bytes]:
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(octets, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little")]


def _unplaned(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes])
    return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view("<u4").ravel()


def encode_segment(ids: np.ndarray, bits: int = 8, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """ids (up to 32-bit unsigned) -> bytes of a segment; bits 8 for byte planes, 1 for bit planes."""
    if bits not in (1, 8):
        raise ValueError("bits is 1 or 8")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    packed = [squeeze(p) for at in range(0, len(ids), block) for p in _planes(ids[at : at + block], bits)]
    blocks = -(-len(ids) // block)
    head = HEAD.pack(MAGIC, 1, bits, block, len(ids), blocks, 32 // bits)
    return b"".join([head, np.array([len(p) for p in packed], "<u4").tobytes(), *packed])


def decode_segment(data: bytes, only: int | None = None) -> np.ndarray:
    """Ids of a segment, or of its block number ``only``. Raises ValueError on damaged data."""
    magic, version, bits, block, n, blocks, planes = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    sizes = np.frombuffer(data, "<u4", blocks * planes, HEAD.size)
    starts = HEAD.size + sizes.nbytes + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    if starts[-1] != len(data):
        raise ValueError("a token segment is cut short")
    expand = zstandard.ZstdDecompressor().decompress
    found = []
    for b in range(blocks) if only is None else [only]:
        count = min(block, n - b * block)
        size = count * 4 // planes if bits == 8 else -(-count // 8)
        got = [expand(data[starts[k] : starts[k + 1]], max_output_size=size) for k in range(b * planes, (b + 1) * planes)]
        found.append(_unplaned(got, count, bits))
    return np.concatenate(found) if found else np.zeros(0, "<u4")


class WordEncoder:
    """Encodes texts with a tokenizer that never looks across ASCII blanks and line feeds, one distinct word at a time.

    Such tokenizers drop white space before they merge, so the ids of a text are those of its blank-separated words one
    after the other. They also lower-case, so A-Z is lowered first (except in texts that may spell a special token), and they
    part letters and digits from marks, so a comma or full stop that ends a word is a word of its own.
    Unknown words of a batch are encoded by the library as one text. Words are remembered in two generations of at most
    ``cache`` each, of at most LONGEST bytes a word, so memory is bounded whatever the texts: when the young one is full it
    becomes the old one, and words that come again move back.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), cache
        alone = self._library(MARK)
        self.mark = alone[0] if len(alone) == 1 else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, raw: bytes) -> list[int]:
        return self.library.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = []
        for text in texts:
            raw = text.encode().replace(b"\n", b" ")
            if b"<|" not in raw:
                raw = raw.lower()
                if not NO_WORD_BEFORE.search(raw):
                    raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
            split.append(raw.split(b" "))
        new = set(chain.from_iterable(split)).difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.old, self.young = self.young, {}
            new = set(chain.from_iterable(split))
        young, old = self.young, self.old
        missing = []
        for word in new:
            known = old.get(word)
            if known is None:
                missing.append(word)
            else:
                young[word] = known
        fresh = self._encoded(missing)
        # long words, of which few come again, serve this batch and are not remembered
        long = {w: fresh.pop(w) for w in [w for w in fresh if len(w) > LONGEST]}
        young.update(fresh)
        for words in split:
            found = map(young.__getitem__, words) if not long else [long[w] if w in long else young[w] for w in words]
            yield np.frombuffer(b"".join(found), "<u4")

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words with their ids. Many words are encoded as one text, with a mark between them that is one token."""
        odd = [w for w in words if MARK in w or self.mark is None]
        found = {word: array("I", self._library(word)).tobytes() for word in odd}
        plain = words if not odd else [w for w in words if MARK not in w and self.mark is not None]
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            ids = np.array(self._library((b" " + MARK + b" ").join(part)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep the mark between words")
            raw = ids.tobytes()
            starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)]
            found.update(zip(part, map(raw.__getitem__, map(slice, starts, ends)), strict=True))
        return found


#: Encoders of this Python worker, by path: loading one takes longer than many tasks.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


SEGMENT_SCHEMA = "part int, segment int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, data binary"


def partitions_of(docs: DataFrame) -> int:
    """Shuffle partitions of docs: one for each PARTITION_BYTES of the optimizer's size estimate, and at least the session's.

    Sizes of scans are those of files; estimates of joins may be far too high, hence the upper bound.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // PARTITION_BYTES), MOST_PARTITIONS))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, bits: int = 8) -> None:
    """Write the ids of docs (doc_id, text) as segments under path, in ascending doc_id order, end_id after each document.

    Documents are range-partitioned by id and sorted within, in as many partitions as the input's size asks for; a segment
    closes at SEGMENT_IDS ids, and a document never spans two. A null text has the end id only; null ids come first; rows
    with equal ids are in order of a hash of the text, then of the text, so one id of any number of rows is dealt over
    partitions too.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        part, segment = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], "<u4")

        def close() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            row = [[part], [segment], [sum(lengths)], [keys], [lengths], [encode_segment(np.concatenate(held), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "segment", "n_ids", "doc_ids", "lengths", "data"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for key, ids in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= SEGMENT_IDS:
                        yield close()
                        keys, held, size, segment = [], [], 0, segment + 1
        if keys:
            yield close()

    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Documents of the segments under path: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32, ids.

    Segment starts come from two running sums: over the segments of a part, and over parts.
    """
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = table.select("part", "segment", "n_ids")
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    starts = sizes.withColumn("_inner", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(before, "part")
    starts = starts.select("part", "segment", (F.col("_before") + F.col("_inner")).alias("_start"))

    names = ["part", "segment", "doc_id", "_at", "n_tokens", "ids_crc32"] + ([] if digest_only else ["ids"])
    schema = "part int, segment int, doc_id long, _at long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, segment, keys, lengths, data = (c[k].as_py() for c in batch.columns)
                ids = decode_segment(data)
                ends = np.cumsum(np.array(lengths, np.int64))
                if len(lengths) and ends[-1] != len(ids):
                    raise ValueError("a token segment does not match its documents")
                raw = memoryview(ids.astype("<u4").tobytes())
                at = ends - np.array(lengths, np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                n = len(keys)
                out = [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(at), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if not digest_only:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = table.select("part", "segment", "doc_ids", "lengths", "data").mapInArrow(run, schema)
    # one row per segment; the join is on the segment, of at most SEGMENT_IDS documents
    joined = rows.join(starts, ["part", "segment"])
    return joined.select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *([] if digest_only else ["ids"]))


def token_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs as token segments, read them back: doc_id, start, n_tokens, ids_crc32. Empty tables give no rows."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path, digest_only=True)
