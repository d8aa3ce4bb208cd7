"""TIFF pyramids: layouts that are understood, and files that aren't."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from nichefold.sources import tiff


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def assembled(data, level=0):
    lv = tiff.levels(data)[level]
    across = -(-lv["w"] // lv["tile_w"])
    out = np.zeros((lv["h"] + lv["tile_h"], across * lv["tile_w"], lv["samples"]), np.uint8)
    for i, (at, n) in enumerate(zip(lv["offsets"], lv["lengths"], strict=True)):
        y, x = i // across * lv["tile_h"], i % across * lv["tile_w"]
        out[y : y + lv["tile_h"], x : x + lv["tile_w"]] = tiff.decode_tile(data[at : at + n], lv, lv["tile_h"])
    return out[: lv["h"], : lv["w"]]


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [1, 8])
def test_round_trip(big, predictor, compression):
    images = [picture(70, 50), picture(35, 25, 1), picture(17, 12, 2)]
    data = tiff.write_tiff(images, 16, "text", compression, predictor, big)
    found = tiff.levels(data)
    assert [(r["h"], r["w"]) for r in found] == [(70, 50), (35, 25), (17, 12)]
    assert found[0]["description"] == "text"
    for i, img in enumerate(images):
        assert np.array_equal(assembled(data, i), img)


def strips(order: str, img: np.ndarray, rows: int, pack) -> bytes:
    """A grey image in strips, big or little endian, with its directory first."""
    h, w = img.shape
    parts = [pack(img[y : y + rows].tobytes()) for y in range(0, h, rows)]
    n = 9
    tail = 8 + 2 + 12 * n + 4
    at = tail + 8 * len(parts)
    offsets, lengths = [], [len(p) for p in parts]
    for p in parts:
        offsets.append(at)
        at += len(p)
    kind = 32773 if pack is not bytes else 1
    rest = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, kind), (273, 4, len(parts), tail), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, len(parts), tail + 4 * len(parts)), (284, 3, 1, 1)]
    out = struct.pack(order + "2sHI", b"MM" if order == ">" else b"II", 42, 8) + struct.pack(order + "H", n)
    for tag, t, count, v in rest:
        out += struct.pack(order + "HHI", tag, t, count) + (struct.pack(order + "HH", v, 0) if t == 3 else struct.pack(order + "I", v))
    return out + struct.pack(order + "I", 0) + struct.pack(f"{order}{2 * len(parts)}I", *offsets, *lengths) + b"".join(parts)


def packed(data: bytes) -> bytes:
    """Runs and literals, with an empty code between."""
    out = bytearray()
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
        out += b"\x80"
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("pack", [bytes, packed])
def test_strips_of_grey(spark, tmp_path, order, pack):
    img = np.repeat(np.arange(50, dtype=np.uint8)[:, None], 40, axis=1)
    img[3:9] = picture(6, 40)[:, :, 0]
    (tmp_path / "a.tif").write_bytes(strips(order, img, 16, pack))
    tiles = {r.ty: r for r in tiff.read_tiles(spark, str(tmp_path)).collect()}
    assert [(tiles[i].h, tiles[i].w) for i in range(4)] == [(16, 40), (16, 40), (16, 40), (2, 40)]
    whole = np.concatenate([np.frombuffer(tiles[i].px, np.uint8).reshape(-1, 40, 3) for i in range(4)])
    assert np.array_equal(whole, np.repeat(img[:, :, None], 3, axis=2))


@pytest.mark.parametrize("data", [b"II*\0", b"II*\0\xff\xff\xff\xff" + bytes(20), b"GIF89a" + bytes(30), tiff.write_tiff([picture(20, 20)], 16)[:200]])
def test_files_that_are_none(spark, tmp_path, data):
    (tmp_path / "a.tif").write_bytes(data)
    rows = tiff.read_levels(spark, str(tmp_path)).collect()
    assert [r.status.split(":")[0] for r in rows] == ["unreadable"]
    assert tiff.read_tiles(spark, str(tmp_path)).count() == 0


def test_directories_in_a_ring():
    data = bytearray(tiff.write_tiff([picture(20, 20)], 16))
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, at)[0]
    struct.pack_into("<I", data, at + 2 + 12 * n, at)
    assert len(tiff.levels(bytes(data))) == 1
