"""Media columns: bytes kept losslessly as images or sound, found again by their signatures.

An Aho-Corasick automaton locates magic bytes anywhere in a cell; a validator for each format walks
its structure and confirms it with its length. What is confirmed at the cell's start corrects the
declared type; what is confirmed further in is embedded media and is carved out.

A null cell or text is an empty one: an empty cell holds no media; an empty text is stored as one
block of zero bytes. Equal cells give equal results. Each row stands alone, so ties, repeated rows
and very long texts need nothing special; other columns are not read."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_arrow, text_array, text_batches

BLOCK = 64
#: Fixed by the formats: the bytes by which a file of each kind begins.
MAGIC = {"png": [b"\x89PNG\r\n\x1a\n"], "gif": [b"GIF87a", b"GIF89a"], "jpeg": [b"\xff\xd8\xff"], "bmp": [b"BM"], "wav": [b"RIFF"]}
STORED = ("png", "wav", "bmp")


class Found(NamedTuple):
    kind: str
    start: int
    length: int


def _png(b: bytes, at: int) -> int:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return 0


def _wav(b: bytes, at: int) -> int:
    if b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    i, seen = at + 12, set()
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, i)
        seen.add(kind)
        i += 8 + size + size % 2
    return end - at if {b"fmt ", b"data"} <= seen and i <= end + 1 else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, offset, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    row = (width * depth + 31) // 32 * 4
    ok = zero == 0 and header >= 40 and planes == 1 and depth in (1, 4, 8, 24, 32) and packed == 0 and width > 0 and offset + row * abs(height) == size
    return size if ok and at + size <= len(b) else 0


def _gif(b: bytes, at: int) -> int:
    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    if at + 13 > len(b):
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:  # fill bytes, and markers that stand alone
            i += 1 if kind == 0xFF else 2
            continue
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
        if kind < 0xC0:
            return 0
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
    return 0


VALIDATORS = {"png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "wav": _wav}

_automaton = None


def sniff(cell: bytes) -> list[Found]:
    """Confirmed media in a cell, by place; media within other media is left to that."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for kind, marks in MAGIC.items():
            for mark in marks:
                _automaton.add_word(mark.decode("latin-1"), (kind, len(mark)))
        _automaton.make_automaton()
    found: list[Found] = []
    done = 0
    for end, (kind, size) in _automaton.iter(cell.decode("latin-1")):
        start = end + 1 - size
        if start >= done and (length := VALIDATORS[kind](cell, start)):
            found.append(Found(kind, start, length))
            done = start + length
    return found


def store(payload: bytes, kind: str) -> bytes:
    """The payload, a multiple of BLOCK bytes, as 8-bit samples."""
    rows = len(payload) // BLOCK
    if kind == "png":
        pixels = np.zeros((rows, BLOCK + 1), np.uint8)
        pixels[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, BLOCK)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return MAGIC["png"][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels.tobytes(), 1)) + chunk(b"IEND", b"")
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, BLOCK, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + payload


def unfiltered(lines: np.ndarray) -> bytes:
    """Grey 8-bit samples of PNG lines, each with its filter's number before it."""
    above, out = np.zeros(lines.shape[1] - 1, np.uint8), []
    for kind, line in zip(lines[:, 0].tolist(), lines[:, 1:]):
        if kind == 1:
            line = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            now, left, corner = [], 0, 0
            for x, up in zip(line.tolist(), above.tolist()):
                guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                left, corner = (x + guess) & 255, up
                now.append(left)
            line = np.array(now, np.uint8)
        elif kind:
            raise ValueError(f"no filter {kind}")
        above = line
        out.append(line.tobytes())
    return b"".join(out)


def load(cell: bytes, found: Found) -> bytes:
    """The samples of what store() made and sniff() found."""
    media = cell[found.start : found.start + found.length]
    if found.kind == "wav":
        i = 12
        while media[i : i + 4] != b"data":
            i += 8 + (n := struct.unpack_from("<I", media, i + 4)[0]) + n % 2
        return media[i + 8 : i + 8 + struct.unpack_from("<I", media, i + 4)[0]]
    if found.kind == "bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if found.kind == "png":
        i, width, data = 8, 0, []
        while i < len(media):
            size, kind = struct.unpack_from(">I4s", media, i)
            if kind == b"IHDR":
                width = struct.unpack_from(">I", media, i + 8)[0]
            elif kind == b"IDAT":
                data.append(media[i + 8 : i + 8 + size])
            i += 12 + size
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
        return lines[:, 1:].tobytes() if not lines[:, 0].any() else unfiltered(lines)
    raise ValueError(f"samples of {found.kind} are not read")


def identify(df: DataFrame, cell_col: str, id_col: str, declared_col: str | None = None) -> DataFrame:
    """id_col, declared and confirmed type of each cell, and its media: kind, start, length, bytes."""
    bounded_arrow(df.sparkSession)
    media = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [x or b"" for x in batch.column("cell").to_pylist()]
            found = [sniff(x) for x in cells]
            kinds = [f[0].kind if f and f[0].start == 0 else None for f in found]
            carved = [[{"kind": m.kind, "start": m.start, "length": m.length, "content": c[m.start : m.start + m.length]} for m in f] for c, f in zip(cells, found)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), pa.array(kinds, pa.string()), pa.array(carved, media)], names=[id_col, "declared", "confirmed", "media"])

    from pyspark.sql import functions as F

    declared = df[declared_col].cast("string") if declared_col else F.lit(None).cast("string")
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), declared.alias("declared"), df[cell_col].cast("binary").alias("cell")).mapInArrow(run, f"`{id_col}` {kind}, declared string, confirmed string, media array<struct<kind:string,start:long,length:long,content:binary>>")


def pad(text: bytes) -> bytes:
    return text + bytes(BLOCK * max(1, -(-len(text) // BLOCK)) - len(text))


#: Declared types, and bytes around the media of a container: false beginnings that no validator confirms.
DECLARED = (*STORED, "gif", "octet-stream")
BEFORE, AFTER = b"part\r\n\r\nBM RIFF\x89PNG GIF8 \xff\xd8\xff\x00", b"\r\n--end BM"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as media, finds it by sniffing, carves it, reads it back; what was stored and read, as digests.

    The format follows from the payload's checksum, and so does the declared type, which is wrong for most cells. Half of the cells are
    containers: the media stands between other bytes, some of which look like the beginning of media, and is carved out."""
    bounded_arrow(df.sparkSession)

    def one(text: str) -> tuple:
        raw = text.encode()
        payload = pad(raw)
        check = zlib.crc32(payload)
        media, declared = store(payload, STORED[check % len(STORED)]), DECLARED[check // 8 % len(DECLARED)]
        cell = BEFORE[: check // 64 % (len(BEFORE) + 1)] + media + AFTER if check // 4 % 2 else media
        found = max(sniff(cell), key=lambda f: f.length)
        if found.length != len(media):
            raise ValueError("the media that was stored is not found")
        back = load(cell, found)
        samples = np.frombuffer(back, np.uint8).astype(np.int64)
        kind = found.kind if found.start == 0 else "container"
        feature = f"declared={declared};confirmed={kind};corrected={int(kind != declared)};carved={found.kind}@{found.start};rows={len(back) // BLOCK};sum={samples.sum()};squares={(samples * samples).sum()};levels={len(np.unique(samples))}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), found.length, hashlib.sha256(cell[found.start : found.start + found.length]).hexdigest(), feature, found.kind

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            made = list(zip(*map(one, text_array(batch.column("text")).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(v), k) for v, k in zip(made, kinds))], names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")
