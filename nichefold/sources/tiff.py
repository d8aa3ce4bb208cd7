"""Tiled TIFF images, pyramids included, as tables of levels and of pixel tiles.

Only directories are parsed to plan: a row a level says its size and where its tiles lie, and each tile is decoded in a row of its own.  Understood are little
and big endian, 32- and 64-bit offsets, tiles or strips, sub-directories as further levels, 8-bit samples side by side, and no compression, deflate or
PackBits, with or without horizontal differences.  Anything else gives a status instead of tiles.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.functions.workers import ship
from nichefold.sources.cells import pixel_size

# Tags of the format, and sizes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS_A_STRIP, LENGTHS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_LENGTHS, SUB = (
    256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 330,
)
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
COMPRESSIONS = {1: "none", 8: "deflate", 32946: "deflate", 32773: "packbits"}
#: Directories of one file; more means that they point at each other.
MOST_LEVELS = 64
LEVEL = "level int, h int, w int, tile_h int, tile_w int, samples int, compression string, predictor int, description string, status string, offsets array<long>, lengths array<long>"
TILE = "level int, tx int, ty int, h int, w int, px binary"


class Unreadable(ValueError):
    """Not a TIFF image that is understood."""


def directories(data: memoryview) -> Iterator[dict[int, tuple]]:
    """The fields of each directory, sub-directories after the one that names them."""
    if len(data) < 16 or bytes(data[:2]) not in (b"II", b"MM"):
        raise Unreadable("no TIFF header")
    order = "<" if bytes(data[:2]) == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    todo, seen = [struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        if len(seen) > MOST_LEVELS:
            raise Unreadable("too many directories")
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        entry, place = (20, at + 8) if big else (12, at + 2)
        fields: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, place + i * entry)
            value = place + i * entry + (12 if big else 8)
            code = TYPES.get(kind)
            if code is None:
                continue
            size = count * struct.calcsize(order + code)
            if size > (8 if big else 4):
                value = struct.unpack_from(order + ("Q" if big else "I"), data, value)[0]
            if value + size > len(data):
                raise Unreadable("a field reaches beyond the file")
            fields[tag] = (bytes(data[value : value + size]),) if code == "s" else struct.unpack_from(f"{order}{count}{code}" if len(code) == 1 else f"{order}{2 * count}I", data, value)
        yield fields
        more = struct.unpack_from(order + ("Q" if big else "I"), data, place + n * entry)[0]
        todo = [*fields.get(SUB, ()), *todo, more]


def levels(data: bytes) -> list[dict]:
    """A row of LEVEL for each directory, the largest image first."""
    rows = []
    for f in directories(memoryview(data)):
        one = lambda tag, other=None, f=f: f.get(tag, (other,))[0]
        h, w = one(HEIGHT), one(WIDTH)
        if not h or not w:
            raise Unreadable("a directory without an image")
        tiled = TILE_OFFSETS in f
        kind = COMPRESSIONS.get(one(COMPRESSION, 1))
        status = "ok" if kind and set(f.get(BITS, (1,))) == {8} and one(PLANAR, 1) == 1 and one(PREDICTOR, 1) in (1, 2) else "not understood"
        rows.append(
            {
                "h": h, "w": w, "tile_h": one(TILE_H) if tiled else min(h, one(ROWS_A_STRIP, h)), "tile_w": one(TILE_W) if tiled else w, "samples": one(SAMPLES, 1), "compression": kind or str(one(COMPRESSION)),
                "predictor": one(PREDICTOR, 1), "description": (one(DESCRIPTION) or b"").rstrip(b"\0").decode("utf-8", "replace"), "status": status,
                "offsets": list(f.get(TILE_OFFSETS if tiled else OFFSETS, ())), "lengths": list(f.get(TILE_LENGTHS if tiled else LENGTHS, ())),
            }
        )
    rows.sort(key=lambda r: -r["h"] * r["w"])
    return [{"level": i} | r for i, r in enumerate(rows)]


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def decode_tile(raw: bytes, level: dict, h: int) -> np.ndarray:
    """Pixels (h, tile_w, samples) of a tile's bytes."""
    kind = level["compression"]
    data = zlib.decompress(raw) if kind == "deflate" else unpack_bits(raw) if kind == "packbits" else raw
    need = h * level["tile_w"] * level["samples"]
    if len(data) < need:
        raise Unreadable("a tile is shorter than its pixels")
    px = np.frombuffer(data, np.uint8, need).reshape(h, level["tile_w"], level["samples"])
    return np.cumsum(px, axis=1, dtype=np.uint8) if level["predictor"] == 2 else px


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(path, LEVEL..., um): the levels of each image; um is the pixel size that the first level's description states, or the default."""
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = levels(content.as_buffer())
                except (Unreadable, struct.error) as e:
                    found = [dict.fromkeys(("h", "w", "tile_h", "tile_w", "samples", "compression", "predictor", "description", "offsets", "lengths")) | {"level": 0, "status": f"unreadable: {e}"}]
                yield pa.RecordBatch.from_pylist([{"path": where} | r for r in found], schema=schema)

    import pyarrow as pa

    integer, text, longs = pa.int32(), pa.string(), pa.list_(pa.int64())
    kinds = {"int": integer, "string": text, "array<long>": longs}
    schema = pa.schema([("path", text), *((n, kinds[k]) for n, k in (c.split(" ") for c in LEVEL.split(", ")))])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, f"path string, {LEVEL}")
    first = F.max(F.when(F.col("level") == 0, F.col("description"))).over(_by_path())
    return rows.withColumn("um", pixel_size(F.coalesce(first, F.lit(""))))


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path")


def read_tiles(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """(path, TILE...): the pixel tiles of one level, clamped to the smallest there is; tiles at the edge are cut to the image.  Grey images become RGB."""
    ship(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                try:
                    found = levels(data)
                except (Unreadable, struct.error):
                    continue
                lv = found[min(level, len(found) - 1)]
                if lv["status"] != "ok":
                    continue
                across = -(-lv["w"] // lv["tile_w"])
                for i, (at, n) in enumerate(zip(lv["offsets"], lv["lengths"], strict=True)):
                    ty, tx = divmod(i, across)
                    inside = min(lv["tile_h"], lv["h"] - ty * lv["tile_h"])
                    stored = lv["tile_h"] if lv["tile_w"] != lv["w"] or n > inside * lv["w"] * lv["samples"] and lv["compression"] == "none" else inside
                    px = decode_tile(bytes(data[at : at + n]), lv, stored)[:inside, : min(lv["tile_w"], lv["w"] - tx * lv["tile_w"])]
                    px = np.repeat(px[:, :, :1], 3, axis=2) if px.shape[2] < 3 else px[:, :, :3]
                    yield pa.record_batch([pa.array([where]), *(pa.array([v], pa.int32()) for v in (lv["level"], tx, ty, px.shape[0], px.shape[1])), pa.array([px.tobytes()])], names=["path", "level", "tx", "ty", "h", "w", "px"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {TILE}")


def write_tiff(images: list[np.ndarray], tile: int, description: str = "", compression: int = 8, predictor: int = 1, big: bool = False) -> bytes:
    """A tiled RGB pyramid: the first image, with the others as its sub-directories."""
    q = "Q" if big else "I"
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))

    def store(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def directory(img: np.ndarray, subs: list[int], text: str) -> int:
        h, w = img.shape[:2]
        offsets, lengths = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                px = np.zeros((tile, tile, 3), np.uint8)
                part = img[y : y + tile, x : x + tile]
                px[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    px[:, 1:] -= px[:, :-1].copy()
                raw = zlib.compress(px.tobytes()) if compression == 8 else px.tobytes()
                offsets.append(store(raw))
                lengths.append(len(raw))
        kind = 16 if big else 4
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [compression]), (SAMPLES, 3, [3]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_W, 4, [tile]), (TILE_H, 4, [tile]), (TILE_OFFSETS, kind, offsets), (TILE_LENGTHS, kind, lengths)]
        packed = [(tag, k, len(v), struct.pack(f"<{len(v)}{TYPES[k]}", *v)) for tag, k, v in fields]
        if text:
            packed.append((DESCRIPTION, 2, len(text) + 1, text.encode() + b"\0"))
        if subs:
            packed.append((SUB, kind, len(subs), struct.pack(f"<{len(subs)}{q}", *subs)))
        room = 8 if big else 4
        entries = b"".join(struct.pack(f"<HH{q}", tag, k, n) + (v.ljust(room, b"\0") if len(v) <= room else struct.pack(f"<{q}", store(v))) for tag, k, n, v in sorted(packed))
        return store(struct.pack("<Q" if big else "<H", len(packed)) + entries + struct.pack(f"<{q}", 0))

    subs = [directory(img, [], "") for img in images[1:]]
    at = directory(images[0], subs, description)
    struct.pack_into(f"<{q}", out, 8 if big else 4, at)
    return bytes(out)
