"""HDF5 files: what they may be made of, byte by byte, and files that are none."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from nichefold.sources import hdf5

DATA = {
    "matrix/data": np.arange(5000, dtype=np.int32) * 7 - 3,
    "matrix/features/name": np.array([b"one", b"three", b""]),
    "matrix/features/x": np.linspace(0, 1, 333),
    "top": np.array([1, 2, 1 << 40], dtype=np.uint64),
    "empty": np.zeros(0, dtype=np.int64),
}


@pytest.mark.parametrize(("chunk", "shuffle"), [(None, False), (7, False), (64, True), (10_000, True)])
def test_round_trip(chunk, shuffle):
    f = hdf5.File(hdf5.write_file(DATA, chunk, shuffle))
    assert set(f.members(f.root)) == {"matrix", "top", "empty"}
    for path, v in DATA.items():
        got = f.read(path)
        want = [x.decode() for x in v.tolist()] if v.dtype.kind == "S" else v.tolist()
        assert got.tolist() == want
    with pytest.raises(hdf5.Unreadable, match="no matrix/nothing"):
        f.read("matrix/nothing")


def newer_file() -> bytes:
    """By hand: a super block of version 2, object headers of version 2, compact links, a compact dataset and strings in a heap."""
    out = bytearray(48)

    def put(b):
        out.extend(bytes(-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return put(b"OHDR" + struct.pack("<BBH", 2, 1, len(body)) + body + bytes(4))

    def space(n):
        return hdf5.SPACE, struct.pack("<BBBBQ", 2, 1, 0, 1, n)

    numbers = header([space(3), (hdf5.TYPE, struct.pack("<BBBBIHH", 0x10, 8 | 1, 0, 0, 2, 0, 16)), (hdf5.LAYOUT, struct.pack("<BBH", 3, 0, 6) + struct.pack(">3h", -1, 2, 300))])
    items = b"".join(struct.pack("<HH4xQ", i, 1, len(t)) + t + bytes(-len(t) % 8) for i, t in ((1, b"alpha"), (2, "β".encode())))
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(items) + 16) + items + bytes(16))
    refs = put(struct.pack("<IQI", 5, heap, 1) + struct.pack("<IQI", 2, heap, 2) + struct.pack("<IQI", 0, 0, 0))
    string = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
    texts = header([space(3), (hdf5.TYPE, string), (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, refs, 48))])
    link = lambda name, at: (hdf5.LINK, struct.pack("<BBB", 1, 0, len(name)) + name + struct.pack("<Q", at))
    inner = header([link(b"numbers", numbers)])
    root = header([link(b"g", inner), link(b"texts", texts)])
    out[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(out), root, 0)
    return bytes(out)


def test_newer_format():
    f = hdf5.File(newer_file())
    assert f.read("g/numbers").tolist() == [-1, 2, 300]
    assert f.read("texts").tolist() == ["alpha", "β", ""]


@pytest.mark.parametrize("data", [b"", b"\x89HDF\r\n\x1a\n" + bytes(100), b"x" * 200])
def test_files_that_are_none(data):
    with pytest.raises(hdf5.Unreadable):
        hdf5.File(data)


def test_pointers_that_do_not_agree(spark, tmp_path):
    parts = {"barcodes": np.array([b"a", b"b"]), "indptr": np.array([0, 1]), "indices": np.array([0]), "data": np.array([1]), "features/name": np.array([b"g"]), "features/feature_type": np.array([b"Gene Expression"])}
    (tmp_path / "m.h5").write_bytes(hdf5.write_file({f"matrix/{k}": v for k, v in parts.items()}))
    with pytest.raises(Exception, match="agree"):
        hdf5.read_matrix(spark, str(tmp_path / "m.h5"))[0].collect()


def test_matrices_are_packed_by_tasks_some_cells_a_file(spark, tmp_path, monkeypatch):
    """No file holds all, none of it comes to the driver, and files that are written out read the same."""
    monkeypatch.setattr(hdf5, "PACKED", 10)
    want = sorted((f"c{i}", g, float(i + g)) for i in range(200) for g in range(i % 5))
    counts = spark.createDataFrame([(c, g, v) for c, g, v in want], "cell_id string, gene int, cnt double").repartition(7)
    features = [(g, f"g{g}", "Gene Expression") for g in range(5)]
    files = hdf5.pack(counts, features, 200)
    held = files.collect()
    assert len(held) >= 15
    assert len({f.file for f in held}) == len(held)
    assert max(len(hdf5.File(f.content).read("matrix/barcodes")) for f in held) < 40
    for f in held:
        (tmp_path / f"{f.file}.h5").write_bytes(f.content)
    for cells, names in (hdf5.matrices(files.select("content")), hdf5.read_matrix(spark, str(tmp_path))):
        got = sorted((r.cell_id, i, v) for r in cells.collect() for i, v in zip(r.indices, r.data, strict=True))
        assert got == want
        assert sorted(map(tuple, names.collect())) == features
    none = hdf5.pack(counts.limit(0), features, 0)
    assert none.collect() == []
