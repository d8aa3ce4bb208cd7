"""Media columns: ISO base media files, read by their boxes.

Boxes are walked without touching payloads.  A track's sample tables (sizes, chunks, offsets, durations, sync samples) are
decoded with numpy into the byte range of every sample, and a row gets codec, duration, sample and keyframe counts and, for each
keyframe, the byte range from it up to the next.  ``write_track`` stores bytes losslessly as samples of 64 bytes.

Defined cases: null is an empty payload; bytes that are no such file, are cut off, or whose tables contradict each other or the file give a
status other than "ok" and nulls, and never more memory than a few times their own size; the first track with samples is described; 32- and
64-bit offsets, fixed and given sample sizes, and missing sync tables (all samples are keyframes) are understood; equal bytes, in repeated rows
too, give equal values; an empty table gives an empty table; where a table has columns of the names that are added, those get a number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from nichefold.llm.common import free_names, ship

SAMPLE, KEY_EVERY, PER_CHUNK, TIMESCALE = 64, 16, 256, 8000
CODEC = b"raw "
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
FIELDS = "status string, codec string, handler string, duration double, n_samples long, n_keyframes long, keyframes array<struct<start: long, end: long>>"


class Broken(ValueError):
    """The bytes aren't a whole ISO media file."""


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    length: int = 0  # bytes of the file
    tables: dict[bytes, memoryview] = field(default_factory=dict)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def pad(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of the sample size."""
    return payload + bytes(-len(payload) % SAMPLE if payload else SAMPLE)


def write_track(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples: the payload's bytes as they are, in units of 64."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError("the payload must be a positive multiple of the sample size")
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    matrix = u(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    units = n * SAMPLE
    ftyp = box(b"ftyp", b"isom", u(512), b"isomiso2mp41")
    large = units + (1 << 16) > 0xFFFFFFFF
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if chunks > 1 else []
    if n - (chunks - 1) * PER_CHUNK != PER_CHUNK or chunks == 1:
        runs.append((chunks, n - (chunks - 1) * PER_CHUNK))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * SAMPLE
        stco = full(b"co64", u(chunks), offsets.astype(">u8").tobytes()) if large else full(b"stco", u(chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", u(1), entry),
            full(b"stts", u(1, n, SAMPLE)),
            full(b"stss", u(len(keys)), keys.tobytes()),
            full(b"stsc", u(len(runs)), *(u(c, k, 1) for c, k in runs)),
            full(b"stsz", u(SAMPLE, n)),
            stco,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", u(1), struct.pack(">I4sI", 12, b"url ", 1))), stbl)
        length = min(units, 0xFFFFFFFF)
        mdia = box(b"mdia", full(b"mdhd", u(0, 0, TIMESCALE, length), struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", u(0), b"soun", bytes(12), b"\0"), minf)
        tkhd = box(b"tkhd", u(7), u(0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, u(0, 0))
        mvhd = full(b"mvhd", u(0, 0, TIMESCALE, length, 0x10000), struct.pack(">H", 256), bytes(10), matrix, bytes(24), u(2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = len(ftyp) + len(moov(0)) + (16 if large else 8)
    return ftyp + moov(start) + box(b"mdat", payload)


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of body, end) of the boxes in a range; sizes 0 (to the end) and 1 (64 bits) are resolved."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Broken("cut off in a box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Broken("cut off in a box header")
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise Broken(f"box {kind!r} reaches beyond its parent")
        yield kind, body, start + size
        start += size


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes in nested order, with the kinds they are in (at most eight, the outermost and the nearest) and their own."""
    open_: list[tuple[tuple[bytes, ...], Iterator]] = [((), boxes(data))]
    while open_:
        path, inner = open_[-1]
        found = next(inner, None)
        if found is None:
            open_.pop()
            continue
        kind, a, b = found
        own = (*path[:1], *path[1:][-6:], kind)
        yield own, a, b
        if kind in PARENTS:
            open_.append((own, boxes(data, a, b)))


def tracks(data: memoryview) -> list[Track]:
    found: list[Track] = []
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(Track(length=len(data)))
        elif b"trak" not in path:
            continue
        elif kind == b"hdlr":
            found[-1].handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"mdhd":
            wide = data[a] == 1
            found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"stsd":
            if struct.unpack_from(">I", data, a + 4)[0]:
                found[-1].codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif path[-2] == b"stbl":
            found[-1].tables[kind] = data[a:b]
    return found


def _numbers(part: memoryview, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    need = at + count * np.dtype(kind).itemsize
    if len(part) < need:
        raise Broken("a table is shorter than it says")
    return np.frombuffer(part[at:need], dtype=kind).astype(np.int64)


def sample_ranges(t: Track) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every sample, from sizes, chunk runs and chunk offsets."""
    try:
        stsz, stsc = t.tables[b"stsz"], t.tables[b"stsc"]
        wide = b"co64" in t.tables
        stco = t.tables[b"co64" if wide else b"stco"]
    except KeyError as e:
        raise Broken(f"no table {e}") from None
    fixed, n = map(int, _numbers(stsz, 4, 2))
    if fixed * n > t.length:
        raise Broken("samples are more than the file holds")
    sizes = np.full(n, fixed) if fixed else _numbers(stsz, 12, n)
    chunks = int(_numbers(stco, 4, 1)[0])
    offsets = _numbers(stco, 8, chunks, ">u8" if wide else ">u4")
    runs = _numbers(stsc, 8, int(_numbers(stsc, 4, 1)[0]) * 3).reshape(-1, 3)
    if not n:
        return sizes, sizes
    if not chunks or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > chunks:
        raise Broken("samples without chunks, or chunk runs out of order")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1)))
    upto = np.cumsum(np.minimum(per, n))
    if upto[-1] < n:
        raise Broken("chunks hold fewer samples than there are")
    chunk = np.searchsorted(upto, np.arange(n), side="right")
    before = np.cumsum(sizes) - sizes
    first = np.minimum(upto - np.minimum(per, n), n - 1)
    start = offsets[chunk] + before - before[first][chunk]
    return start, start + sizes


def keyframes(t: Track, n: int) -> np.ndarray:
    """Numbers from 0 of the sync samples."""
    if b"stss" not in t.tables:
        return np.arange(n)
    part = t.tables[b"stss"]
    keys = _numbers(part, 8, int(_numbers(part, 4, 1)[0])) - 1
    if len(keys) and (keys[0] < 0 or keys[-1] >= n or (np.diff(keys) <= 0).any()):
        raise Broken("sync samples that aren't there, or out of order")
    return keys


def described_track(found: list[Track]) -> Track | None:
    """The first track with samples, else the first with a table of them."""
    tables = [t for t in found if b"stsz" in t.tables]
    return next((t for t in tables if _numbers(t.tables[b"stsz"], 8, 1)[0]), tables[0] if tables else None)


def probe(data: bytes | None) -> dict:
    """What FIELDS lists of a file."""
    empty = dict.fromkeys(("codec", "handler", "duration", "n_samples", "n_keyframes", "keyframes"))
    if not data:
        return {"status": "empty"} | empty
    try:
        t = described_track(tracks(memoryview(data)))
        if t is None:
            return {"status": "no track"} | empty
        start, end = sample_ranges(t)
        if len(end) and (end.max() > len(data) or start.min() < 0):
            raise Broken("samples lie beyond the file")
        keys = keyframes(t, len(start))
        # All bytes from a keyframe's up to the next one's samples, wherever their chunks lie.
        first, last = (np.minimum.reduceat(start, keys), np.maximum.reduceat(end, keys)) if len(keys) else (start[:0], end[:0])
        return {
            "status": "ok",
            "codec": t.codec,
            "handler": t.handler,
            "duration": t.duration / t.timescale if t.timescale else None,
            "n_samples": len(start),
            "n_keyframes": len(keys),
            "keyframes": [{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)],
        }
    except (struct.error, IndexError, ValueError, MemoryError, OverflowError) as e:  # Broken is a ValueError
        return {"status": f"broken: {e}"} | empty


def read_track(data: bytes) -> bytes:
    """The bytes of the first track's samples, in order."""
    view = memoryview(data)
    t = described_track(tracks(view))
    if t is None:
        raise Broken("no track")
    start, end = sample_ranges(t)
    if not len(start):
        return b""
    cut = np.flatnonzero(start[1:] != end[:-1]) + 1  # samples that don't follow the one before
    first, last = np.append(0, cut), np.append(cut, len(start)) - 1
    return b"".join(view[a:b] for a, b in zip(start[first], end[last], strict=True))


def feature(info: dict) -> str:
    """A digest of a description that is the same for equal files: codec, handler, seconds, samples, keyframes and their ranges."""
    import hashlib

    ranges = np.array([(k["start"], k["end"]) for k in info["keyframes"] or []], dtype="<i8").tobytes()
    return f"{info['codec']}|{info['handler']}|{info['duration']:.6f}|{info['n_samples']}|{info['n_keyframes']}|{hashlib.sha256(ranges).hexdigest()[:16]}"


def map_rows(docs: DataFrame, carry: list[str], content, make, schema: str) -> DataFrame:
    """Runs make(bytes or None) on a binary column; its dicts' fields follow the columns carry, numbered where those have the name."""
    ship(docs.sparkSession)
    added = StructType.fromDDL(schema)
    names = free_names(carry, added.names)
    whole = StructType([*docs.select(*carry).schema.fields, *(StructField(x, f.dataType) for x, f in zip(names, added, strict=True))])
    n = len(carry)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(added)
        for b in batches:
            rows = [make(x.as_py()) for x in b.column(n)]
            yield pa.record_batch([*b.columns[:n], *(pa.array([r[f.name] for r in rows], f.type) for f in want)], names=whole.names)

    return docs.select(*carry, content).mapInArrow(run, whole)


def describe(docs: DataFrame, content_col: str) -> DataFrame:
    """docs with FIELDS of the file in content_col beside all its columns."""
    return map_rows(docs, docs.columns, F.col(content_col), probe, FIELDS)
