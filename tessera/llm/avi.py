"""AVI motion-JPEG: RIFF containers with their index, baseline intra frames, and shots by histogram differences.

Storing bytes. A payload byte is the unit of the format, a quantized coefficient: byte b stands for the coefficient b - 255
if b < 128, else b, all of magnitude category 8, whose eight extra bits are b itself. The Huffman code of the only symbol
is eight zero bits, so a coefficient takes two bytes, the second of which is b: blocks are coded and decoded in whole
arrays, and the files compress like the text in them. With a restart interval of one block no block depends on another.
Any baseline decoder shows such frames; pixels are lossy, coefficients are not.

Reading. Frames of the first video stream are found through the OpenDML index (``indx`` and its ``ix`` chunks) where there
is one, else through ``idx1`` for the first RIFF chunk and by walking ``movi`` for the others. A frame is a baseline JPEG of
one to four components in one or more scans, with any sampling factors, restart intervals, 8- or 16-bit tables, and the
customary Huffman tables where it has none. It is entropy-decoded, dequantized and transformed. Progressive and arithmetic
frames, and two fields in one chunk, are errors.

Shots. A cut lies where the histogram difference of two frames passes the mean of the last WINDOW differences of the shot
by FACTOR standard deviations and a floor. ``clips`` gives a row per shot with its times.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

BLOCK = 64
ROW_BLOCKS, FRAME_BLOCKS = 8, 64
RATE = 25
BINS, WINDOW, FACTOR, FLOOR = 16, 12, 3.0, 0.25
#: Zigzag order of an 8 x 8 block: position k holds the coefficient of row-major place ZIGZAG[k].
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(maxsize=1)
def _transform() -> np.ndarray:
    """(64 zigzag coefficients) @ this = 64 row-major samples without the level shift."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One symbol, category 8 without a zero run, with a code of eight zero bits.
_ONE_CODE = bytes([0] * 7 + [1] + [0] * 8) + b"\x08"


def _tables() -> bytes:
    return _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE) + _segment(0xDD, b"\x00\x01")


def _jpegs(payload: bytes) -> tuple[list[bytes], int, int]:
    """Frames of a payload (a positive multiple of BLOCK), width and height."""
    blocks = len(payload) // BLOCK
    count = -(-blocks // FRAME_BLOCKS)
    per_frame = -(-blocks // (count * ROW_BLOCKS)) * ROW_BLOCKS
    height = per_frame // ROW_BLOCKS * 8
    tables = _tables()
    sof = _segment(0xC0, struct.pack(">BHHBBBB", 8, height, ROW_BLOCKS * 8, 1, 1, 0x11, 0))
    sos = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    frames = []
    for at in range(0, blocks, per_frame):
        part = np.frombuffer(payload, np.uint8, min(per_frame, blocks - at) * BLOCK, at * BLOCK)
        valid = len(part) // BLOCK
        full = np.zeros(per_frame * BLOCK, np.uint8)
        full[: len(part)] = part
        coded = np.zeros((per_frame, 130), np.uint8)
        coded[:, 1:128:2] = full.reshape(per_frame, BLOCK)
        coded[:, 128] = 0xFF
        coded[:, 129] = 0xD0 + np.arange(per_frame) % 8
        if (full == 0xFF).any():  # stuffed bytes; text never has them
            data = b"".join(row[:128].tobytes().replace(b"\xff", b"\xff\x00") + row[128:].tobytes() for row in coded)[:-2]
        else:
            data = coded.tobytes()[:-2]
        frames.append(b"".join([b"\xff\xd8", _segment(0xFE, b"blocks=%d" % valid), tables, sof, sos, data, b"\xff\xd9"]))
    return frames, ROW_BLOCKS * 8, height


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode_avi(payload: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that holds payload (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    frames, width, height = _jpegs(payload)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        movi.append(chunk)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk ends early")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def _frames_by_index(data: bytes, index: tuple[int, int], movi: int) -> Iterator[bytes]:
    for at in range(index[0], index[0] + index[1] // 16 * 16, 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, at)
        if name[2:] not in (b"dc", b"db"):
            continue
        # offsets count from the list's name; those of some writers from the start of the file
        found = next((x for x in (movi + offset, offset) if data[x : x + 4] == name), None)
        if found is None:
            raise ValueError("the index does not point at a frame")
        yield data[found + 8 : found + 8 + size]


def _frames_by_walk(data: bytes, at: int, end: int) -> Iterator[bytes]:
    for name, a, size in _walk(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _frames_by_walk(data, a + 4, a + size)
        elif name[2:] in (b"dc", b"db"):
            yield data[a : a + size]


def _frames_by_super_index(data: bytes, at: int) -> Iterator[bytes]:
    """Frames named by an OpenDML index at a chunk's content: an index of indexes, or an index of chunks."""
    longs, _, kind, count = struct.unpack_from("<HBBI", data, at)
    if kind == 0:
        for k in range(count):
            yield from _frames_by_super_index(data, struct.unpack_from("<Q", data, at + 24 + 16 * k)[0] + 8)
    elif kind == 1:
        base = struct.unpack_from("<Q", data, at + 12)[0]
        for k in range(count):
            offset, size = struct.unpack_from("<II", data, at + 24 + 4 * longs * k)
            start, size = base + offset, size & 0x7FFFFFFF
            if start + size > len(data):
                raise ValueError("the index does not point at a frame")
            yield data[start : start + size]
    else:
        raise ValueError("no such kind of index")


def read_riff(data: bytes) -> tuple[dict[str, int], list[bytes]]:
    """Header fields and the frames of the first video stream, in index order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    head: dict[str, int] = {"rate": RATE}
    movis: list[tuple[int, int]] = []
    index, opened = None, None
    for riff, start, whole in _walk(data, 0, len(data)):
        if riff != b"RIFF" or data[start : start + 4] not in (b"AVI ", b"AVIX"):
            continue
        for name, at, size in _walk(data, start + 4, start + whole):
            kind = data[at : at + 4] if name == b"LIST" else name
            if kind == b"hdrl":
                for sub, a, n in _walk(data, at + 4, at + size):
                    if sub == b"avih":
                        usec, frames, width, height = struct.unpack_from("<I12xI12xII", data, a)
                        head |= {"rate": round(1_000_000 / usec) if usec else RATE, "frames": frames, "width": width, "height": height}
                    elif sub == b"LIST" and data[a : a + 4] == b"strl":
                        parts = {part: x for part, x, _ in _walk(data, a + 4, a + n)}
                        if b"indx" in parts and opened is None and data[parts[b"strh"] : parts[b"strh"] + 4] == b"vids":
                            opened = parts[b"indx"]
            elif kind == b"movi":
                movis.append((at, size))
            elif kind == b"idx1" and index is None:
                index = (at, size)
    if not movis:
        raise ValueError("an AVI file without movi")
    if opened is not None:
        return head, list(_frames_by_super_index(data, opened))
    frames = []
    for k, (at, size) in enumerate(movis):
        frames += _frames_by_index(data, index, at) if k == 0 and index else _frames_by_walk(data, at + 4, at + size)
    return head, frames


# ---- fixed values: the customary Huffman tables, as counts by code length and symbols (ITU-T T.81, annex K.3) ----
_USUAL = {
    0x00: "00010501010101010100000000000000 000102030405060708090a0b",
    0x01: "00030101010101010101010000000000 000102030405060708090a0b",
    0x10: "0002010303020403050504040000017d "
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
    "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    0x11: "00020102040403040705040400010277 "
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6"
    "c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}
# -------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _huffman(body: bytes) -> tuple[list[int], list[int]]:
    """For every 16 bits that come next, the length of the code at their start (0: none) and its symbol."""
    lengths, symbols = [0] * 65536, [0] * 65536
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            low, span = code << (16 - length), 1 << (16 - length)
            lengths[low : low + span], symbols[low : low + span] = [length] * span, [body[at]] * span
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


@dataclass
class Part:
    """A component of a frame: sampling factors, quantization table, and coefficients (rows, columns, 64) in zigzag order."""

    h: int
    v: int
    table: int
    blocks: np.ndarray
    quant: np.ndarray | None = None


@dataclass
class Frame:
    width: int
    height: int
    parts: list[Part]
    #: Blocks in use, where the writer noted it.
    valid: int | None = None


class _Bits:
    """Reads an entropy-coded interval."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.raw, self.at, self.size = raw + b"\xff" * 4, 0, 8 * len(raw)

    def _next16(self) -> int:
        k, shift = divmod(self.at, 8)
        return int.from_bytes(self.raw[k : k + 3], "big") >> (8 - shift) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        ahead = self._next16()
        length = table[0][ahead]
        if not length or self.at + length > self.size:
            raise ValueError("no such Huffman code")
        self.at += length
        return table[1][ahead]

    def extra(self, size: int) -> int:
        if not size:
            return 0
        value = self._next16() >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1

    def block(self, out: np.ndarray, dc: tuple, ac: tuple, last: int) -> int:
        out[0] = last = last + self.extra(self.symbol(dc))
        k = 1
        while k < 64:
            run = self.symbol(ac)
            if run == 0:
                break
            k += run >> 4
            if run & 15:
                if k > 63:
                    raise ValueError("a block has over 64 coefficients")
                out[k] = self.extra(run & 15)
            k += 1
        return last


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


def _scan(data: bytes, frame: Frame, chosen: list[tuple[Part, tuple, tuple]], interval: int) -> None:
    """Decode the entropy-coded data of a scan into the blocks of its components."""
    most_h, most_v = max(p.h for p in frame.parts), max(p.v for p in frame.parts)
    alone = len(chosen) == 1
    if alone:  # blocks of the component, row by row
        part = chosen[0][0]
        across, down = -(-(-(-frame.width * part.h // most_h)) // 8), -(-(-(-frame.height * part.v // most_v)) // 8)
    else:
        across, down = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
    step = interval or across * down
    pieces = _RESTART.split(data) if interval else [data]
    for k, piece in enumerate(pieces):
        bits, last = _Bits(piece), [0] * len(chosen)
        for unit in range(k * step, min((k + 1) * step, across * down)):
            y, x = divmod(unit, across)
            for c, (part, dc, ac) in enumerate(chosen):
                h, v = (1, 1) if alone else (part.h, part.v)
                for j in range(v):
                    for i in range(h):
                        last[c] = bits.block(part.blocks[y * v + j, x * h + i], dc, ac, last[c])


def decode_frame(jpeg: bytes) -> Frame:
    """A baseline frame with its quantized coefficients."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, interval, frame, valid = 2, 0, None, None
    quants: dict[int, np.ndarray] = {}
    raw = {k: bytes.fromhex(v) for k, v in _USUAL.items()}
    named: dict[int, Part] = {}
    while True:
        while jpeg[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if at + 2 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a JPEG frame ends early")
        marker = jpeg[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and body.startswith(b"blocks="):
            valid = int(body[7:])
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                raw[body[0]], body = body[1:n], body[n:]
        elif marker in (0xC0, 0xC1):
            height, width, count = struct.unpack_from(">HHB", body, 1)
            specs = [struct.unpack_from("BBB", body, 6 + 3 * k) for k in range(count)]
            most_h, most_v = max(s[1] >> 4 for s in specs), max(s[1] & 15 for s in specs)
            if count == 1:
                specs, most_h, most_v = [(specs[0][0], 0x11, specs[0][2])], 1, 1
            rows, cols = -(-height // (8 * most_v)), -(-width // (8 * most_h))
            parts = [Part(s >> 4, s & 15, q, np.zeros((rows * (s & 15), cols * (s >> 4), 64), np.int32)) for _, s, q in specs]
            named = {name: part for (name, _, _), part in zip(specs, parts, strict=True)}
            frame = Frame(width, height, parts, valid)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan without a frame")
            end = _MARKER.search(jpeg, at)
            if end is None:
                raise ValueError("a JPEG frame ends early")
            data = jpeg[at : end.start()]
            picks = [struct.unpack_from("BB", body, 1 + 2 * k) for k in range(body[0])]
            at = end.start()
            if len(frame.parts) == 1 and interval == 1 and raw[0x00] == _ONE_CODE and raw[0x10] == _ONE_CODE:
                frame.parts[0].blocks[:] = _plain_blocks(data, frame.parts[0].blocks.shape)
            else:
                _scan(data, frame, [(named[n], _huffman(raw[t >> 4]), _huffman(raw[0x10 | t & 15])) for n, t in picks], interval)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
    if frame is None:
        raise ValueError("a JPEG file without a frame")
    for part in frame.parts:
        part.quant = quants[part.table]
    return frame


def _plain_blocks(data: bytes, shape: tuple[int, int, int]) -> np.ndarray:
    """Coefficients of blocks that encode_avi wrote."""
    count = shape[0] * shape[1]
    if len(data) == 130 * count - 2:
        body = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(count, 130)[:, :128]
    else:
        body = np.frombuffer(b"".join(x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data)), np.uint8).reshape(count, 128)
    if body[:, 0::2].any():
        raise ValueError("no such Huffman code")
    octets = body[:, 1::2].astype(np.int32)
    return np.where(octets < 128, octets - 255, octets).reshape(shape)


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (..., 64) of quantized coefficients, row-major in a block."""
    values = (coefficients * quant).astype(np.float32) @ _transform()
    return np.clip(np.rint(values + 128), 0, 255).astype(np.uint8)


def plane(frame: Frame, k: int) -> np.ndarray:
    """Component k at the size of the frame (samples are repeated where it is subsampled)."""
    part = frame.parts[k]
    rows, cols, _ = part.blocks.shape
    small = samples(part.blocks, part.quant).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)
    up, right = max(p.v for p in frame.parts) // part.v, max(p.h for p in frame.parts) // part.h
    return small.repeat(up, axis=0).repeat(right, axis=1)[: frame.height, : frame.width]


def rgb(frame: Frame) -> np.ndarray:
    """(height, width, 3) samples; a frame of one component is grey."""
    if len(frame.parts) < 3:
        return np.repeat(plane(frame, 0)[:, :, None], 3, axis=2)
    y, cb, cr = (plane(frame, k).astype(np.float32) for k in range(3))
    both = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[int]:
    """First frames of the shots of (frames, BINS) histograms that each add up to 1."""
    starts, recent = [0], []
    for k in range(1, len(histograms)):
        diff = float(np.abs(histograms[k] - histograms[k - 1]).sum()) / 2
        limit = FLOOR
        if recent:
            limit = max(FLOOR, float(np.mean(recent)) + FACTOR * float(np.std(recent)))
        if diff > limit:
            starts.append(k)
            recent = []
        else:
            recent = [*recent[-WINDOW + 1 :], diff]
    return starts


def histogram(frame: Frame) -> np.ndarray:
    """Shares of the BINS ranges of the first component's samples; of blocks in use, where the writer noted them."""
    if frame.valid is not None and len(frame.parts) == 1:
        part = frame.parts[0]
        pixels = samples(part.blocks.reshape(-1, 64)[: frame.valid], part.quant)
    else:
        pixels = plane(frame, 0)
    return np.bincount(pixels.ravel() >> 4, minlength=BINS) / max(1, pixels.size)


def decode_video(media: bytes) -> tuple[np.ndarray, int]:
    """Histograms (frames, BINS) of any motion-JPEG AVI file, and its rate."""
    head, frames = read_riff(media)
    return np.array([histogram(decode_frame(f)) for f in frames]).reshape(-1, BINS), head["rate"]


def decode_avi(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """Payload of a file that encode_avi wrote, histograms of its frames, and the rate."""
    head, frames = read_riff(media)
    parts, rows = [], []
    for data in frames:
        frame = decode_frame(data)
        kept = frame.parts[0].blocks.reshape(-1, 64)[: frame.valid]
        parts.append(np.where(kept < 0, kept + 255, kept).astype(np.uint8).tobytes())
        rows.append(histogram(frame))
    return b"".join(parts), np.array(rows).reshape(-1, BINS), head["rate"]


def clip_rows(histograms: np.ndarray, rate: int) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, last frame, start, end in seconds) of every shot; no frames, no clips."""
    if not len(histograms):
        return []
    starts = shots(histograms)
    return [(k, a, z - 1, a / rate, z / rate) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(histograms)], strict=True))]


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\x00" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def write_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (an AVI file) for every row of docs (doc_id, text); null texts are empty."""
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                got = [padded(t) for t in batch.column(1).to_pylist()]
                media = [encode_avi(p) for p, _ in got]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_avi(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) -> payload sizes, digests and a feature string per row, from the media bytes."""
    schema = stored.select("doc_id", "n_bytes").schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(2):
                media = item.as_py()
                payload, histograms, rate = decode_avi(media)
                found = clip_rows(histograms, rate)
                luma = float((histograms.mean(axis=0) * (np.arange(BINS) * 16 + 7.5)).sum())
                feature = f"frames={len(histograms)};seconds={found[-1][4]:.2f};shots={len(found)};last_cut={found[-1][1]};luma={luma:.2f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clips(stored: DataFrame) -> DataFrame:
    """One row per shot of every media row: doc_id, clip, first_frame, last_frame, start_s, end_s.

    stored (doc_id, media, any others). Media may be any motion-JPEG AVI file. Null media and files without frames give no
    row; damaged ones are an error. Repeated rows give their clips each; an empty table gives no rows.
    """
    schema = stored.select("doc_id").schema
    for name, kind in (("clip", "integer"), ("first_frame", "integer"), ("last_frame", "integer"), ("start_s", "double"), ("end_s", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *clip) for key, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for clip in clip_rows(*decode_video(media.as_py()))]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=schema.names)

    return stored.where(F.col("media").isNotNull()).select("doc_id", "media").mapInArrow(run, schema)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as an AVI file in a table of the shared folder, and read that back: see read_avi. Empty texts are one
    block of zeros; rows that repeat a text have equal values; an empty table gives no rows."""
    return read_avi(written(write_avi(docs), "avi", compression="zstd"))
