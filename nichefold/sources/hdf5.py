"""Count matrices kept in HDF5 files, read without a library.

Understood is what such files are made of: super blocks of versions 0 to 3, object headers of versions 1 and 2, groups by symbol tables or compact links, and
compact, contiguous or chunked datasets (chunk B-trees of version 1) of whole numbers, floats and strings, with shuffle, deflate and checksum filters.
Anything else raises ``Unreadable``.  A matrix becomes a row a cell (cell_id, indices, data), which ``csc_to_counts`` takes on.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichefold.functions.workers import ship

# Signature, message kinds and filters of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, TYPE, LINK, LAYOUT, FILTERS, CONTINUED, TABLE = 1, 3, 6, 8, 11, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF
#: Cells that go into one row batch, and into one file that is packed here.
TOGETHER, PACKED = 5000, 5000


class Unreadable(ValueError):
    """Not an HDF5 file, or one with parts that aren't understood."""


class File:
    """Groups and datasets of a file by path; nothing is read but what is asked for."""

    def __init__(self, data):
        self.data = memoryview(data)
        if len(self.data) < 48 or bytes(self.data[:8]) != SIGNATURE:
            raise Unreadable("no HDF5 signature")
        version = self.data[8]
        if version in (0, 1):
            sizes, at = self.data[13:15], 24 if version == 0 else 28
            root = self._u8(at + 32 + 8)
        elif version in (2, 3):
            sizes = self.data[9:11]
            root = self._u8(36)
        else:
            raise Unreadable(f"super block of version {version}")
        if bytes(sizes) != b"\x08\x08":
            raise Unreadable("offsets that aren't 64-bit")
        self.root = root

    def _u8(self, at: int) -> int:
        return struct.unpack_from("<Q", self.data, at)[0]

    def _messages(self, at: int):
        """(kind, start, end) of an object's header messages."""
        d = self.data
        if bytes(d[at : at + 4]) == b"OHDR":
            flags = d[at + 5]
            start = at + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(d[start : start + width], "little")
            blocks, head = [(start + width, start + width + size)], 6 if flags & 4 else 4
        elif d[at] == 1:
            blocks, head = [(at + 16, at + 16 + struct.unpack_from("<I", d, at + 8)[0])], 8
        else:
            raise Unreadable("an object header that isn't understood")
        seen = 0
        while blocks:
            place, end = blocks.pop(0)
            while place + head <= end:
                kind, size = struct.unpack_from("<HH" if head == 8 else "<BH", d, place)
                start = place + head
                place = start + size
                seen += 1
                if seen > 10_000:
                    raise Unreadable("headers that point at each other")
                if kind == CONTINUED:
                    where, length = struct.unpack_from("<QQ", d, start)
                    blocks.append((where, where + length) if head == 8 else (where + 4, where + length - 4))
                else:
                    yield kind, start, place

    def members(self, at: int) -> dict[str, int]:
        """Header places by name of a group's members."""
        found: dict[str, int] = {}
        for kind, a, _ in self._messages(at):
            if kind == TABLE:
                tree, heap = struct.unpack_from("<QQ", self.data, a)
                names = self._u8(heap + 24)
                for node in self._leaves(tree, 0, 8):
                    for i in range(struct.unpack_from("<H", self.data, node + 6)[0]):
                        name, where = struct.unpack_from("<QQ", self.data, node + 8 + 40 * i)
                        found[self._text(names + name)] = where
            elif kind == LINK:
                flags = self.data[a + 1]
                place = a + 2 + (1 if flags & 8 else 0)
                if flags & 8 and self.data[a + 2] != 0:
                    continue  # not a hard link
                place += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = int.from_bytes(self.data[place : place + width], "little")
                name = bytes(self.data[place + width : place + width + n]).decode()
                found[name] = self._u8(place + width + n)
        return found

    def _text(self, at: int) -> str:
        end = at
        while self.data[end]:
            end += 1
        return bytes(self.data[at:end]).decode()

    def _leaves(self, at: int, kind: int, key: int):
        """What the leaves of a B-tree point at; for chunks, with their keys."""
        if at == NOWHERE:
            return
        d = self.data
        if bytes(d[at : at + 4]) != b"TREE" or d[at + 4] != kind:
            raise Unreadable("a B-tree that isn't understood")
        level, used = d[at + 5], struct.unpack_from("<H", d, at + 6)[0]
        for i in range(used):
            place = at + 24 + i * (key + 8)
            child = self._u8(place + key)
            if level:
                yield from self._leaves(child, kind, key)
            else:
                yield child if kind == 0 else (place, child)

    def find(self, path: str) -> int:
        at = self.root
        for part in path.strip("/").split("/"):
            inside = self.members(at)
            if part not in inside:
                raise Unreadable(f"no {path}")
            at = inside[part]
        return at

    def read(self, path: str) -> np.ndarray:
        """A dataset as an array; strings as an array of objects."""
        shape: tuple[int, ...] | None = None
        kind, filters, layout = None, [], None
        for k, a, b in self._messages(self.find(path)):
            if k == SPACE:
                version, rank = self.data[a], self.data[a + 1]
                shape = struct.unpack_from(f"<{rank}Q", self.data, a + (8 if version == 1 else 4))
            elif k == TYPE:
                kind = self._type(a)
            elif k == FILTERS:
                filters = self._filters(a)
            elif k == LAYOUT:
                layout = a, b
        if shape is None or kind is None or layout is None:
            raise Unreadable(f"{path} is no dataset")
        dtype, strings = kind
        flat = self._stored(layout[0], shape, dtype, filters)
        if strings == "vlen":
            return np.array([self._heap_text(r) for r in flat.reshape(-1)], dtype=object).reshape(shape)
        if strings == "fixed":
            return np.array([x.rstrip(b"\0").decode() for x in flat.reshape(-1).tolist()], dtype=object).reshape(shape)
        return flat

    def _type(self, at: int) -> tuple[np.dtype, str]:
        cls, bits = self.data[at] & 15, self.data[at + 1]
        size = struct.unpack_from("<I", self.data, at + 4)[0]
        order = ">" if bits & 1 else "<"
        if cls == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"), ""
        if cls == 1 and size in (2, 4, 8):
            return np.dtype(f"{order}f{size}"), ""
        if cls == 3:
            return np.dtype(f"S{size}"), "fixed"
        if cls == 9 and bits & 15 == 1:
            return np.dtype([("n", "<u4"), ("heap", "<u8"), ("i", "<u4")]), "vlen"
        raise Unreadable(f"numbers of class {cls} and {size} bytes")

    def _heap_text(self, ref) -> str:
        heap, want, n = int(ref["heap"]), int(ref["i"]), int(ref["n"])
        if not n:
            return ""
        at, end = heap + 16, heap + self._u8(heap + 8)
        while at + 16 <= end:
            index, size = struct.unpack_from("<H", self.data, at)[0], self._u8(at + 8)
            if index == want:
                return bytes(self.data[at + 16 : at + 16 + n]).decode()
            at += 16 + -(-size // 8) * 8
        raise Unreadable("a string that isn't in its heap")

    def _filters(self, at: int) -> list[tuple[int, tuple[int, ...]]]:
        version, n = self.data[at], self.data[at + 1]
        place, out = at + (8 if version == 1 else 2), []
        for _ in range(n):
            kind = struct.unpack_from("<H", self.data, place)[0]
            named = version == 1 or kind >= 256
            name = struct.unpack_from("<H", self.data, place + 2)[0] if named else 0
            place += 4 if named else 2
            count = struct.unpack_from("<HH", self.data, place)[1]
            place += 4 + (-(-name // 8) * 8 if version == 1 else name)
            out.append((kind, struct.unpack_from(f"<{count}I", self.data, place)))
            place += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def _stored(self, at: int, shape: tuple[int, ...], dtype: np.dtype, filters: list) -> np.ndarray:
        d = self.data
        if d[at] != 3:
            raise Unreadable(f"a layout of version {d[at]}")
        n = int(np.prod(shape, dtype=np.int64))
        if n * dtype.itemsize > 1000 * len(d) + 1024:
            raise Unreadable("a dataset larger than its file can hold")
        if d[at + 1] == 0:
            return np.frombuffer(d, dtype, n, at + 4).reshape(shape)
        if d[at + 1] == 1:
            where = self._u8(at + 2)
            return np.zeros(shape, dtype) if where == NOWHERE else np.frombuffer(d, dtype, n, where).reshape(shape)
        rank = d[at + 2] - 1
        chunk = struct.unpack_from(f"<{rank}I", d, at + 11)
        out = np.zeros(shape, dtype)
        for key, where in self._leaves(self._u8(at + 3), 1, 8 + 8 * (rank + 1)):
            size, mask = struct.unpack_from("<II", d, key)
            origin = struct.unpack_from(f"<{rank}Q", d, key + 8)
            raw = bytes(d[where : where + size])
            for i in range(len(filters) - 1, -1, -1):
                if not mask >> i & 1:
                    raw = _undo(*filters[i], raw, dtype.itemsize)
            part = np.frombuffer(raw, dtype, int(np.prod(chunk, dtype=np.int64))).reshape(chunk)
            inside = tuple(slice(o, min(o + c, s)) for o, c, s in zip(origin, chunk, shape, strict=True))
            out[inside] = part[tuple(slice(0, s.stop - s.start) for s in inside)]
        return out


def _undo(kind: int, values: tuple[int, ...], raw: bytes, width: int) -> bytes:
    if kind == DEFLATE:
        return zlib.decompress(raw)
    if kind == SHUFFLE:
        n = len(raw) // width
        return np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes() + raw[n * width :]
    if kind == CHECKSUM:
        return raw[:-4]
    raise Unreadable(f"filter {kind}")


def _texts(values: np.ndarray) -> list[str]:
    return [v if isinstance(v, str) else str(v) for v in values.tolist()]


def read_matrix(spark: SparkSession, path: str, group: str = "matrix") -> tuple[DataFrame, DataFrame]:
    """The rows (cell_id, indices, data) of matrices, a row a cell, and their features (idx, name, feature_type), which must agree between files.

    A matrix is kept by columns, one a cell: barcodes, data, indices, indptr, shape, features/name and features/feature_type in a group.
    """
    return matrices(spark.read.format("binaryFile").load(path).select("content"), group)


def matrices(files: DataFrame, group: str = "matrix") -> tuple[DataFrame, DataFrame]:
    """``read_matrix`` of files that are at hand as rows (content)."""
    ship(files.sparkSession)

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0):
                f = File(content.as_buffer())
                names = _texts(f.read(f"{group}/barcodes"))
                starts, indices, data = (f.read(f"{group}/{x}") for x in ("indptr", "indices", "data"))
                if len(starts) != len(names) + 1 or len(indices) != len(data) or starts[-1] != len(data):
                    raise Unreadable("pointers and cells that don't agree")
                for at in range(0, len(names), TOGETHER):
                    cut = starts[at : at + TOGETHER + 1].astype(np.int64)
                    part = slice(int(cut[0]), int(cut[-1]))
                    lists = lambda v, t, cut=cut, part=part: pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(v[part].astype(t)))
                    yield pa.record_batch([pa.array(names[at : at + TOGETHER]), lists(indices, np.int32), lists(data, np.float64)], names=["cell_id", "indices", "data"])

    def features(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0):
                f = File(content.as_buffer())
                names, kinds = (_texts(f.read(f"{group}/features/{x}")) for x in ("name", "feature_type"))
                yield pa.record_batch([pa.array(range(len(names)), pa.int32()), pa.array(names), pa.array(kinds)], names=["idx", "name", "feature_type"])

    return files.mapInArrow(cells, "cell_id string, indices array<int>, data array<double>"), files.mapInArrow(features, "idx int, name string, feature_type string").distinct()


# ---- writing ----


def pack(counts: DataFrame, features: list[tuple[int, str, str]], cells: int, group: str = "matrix", chunk: int = 1000) -> DataFrame:
    """(file, content): counts (cell_id string, gene int, cnt) as files of matrices by columns, PACKED cells or so in each, packed by tasks that hold one at a time.

    features: index from 0, name and kind, in order; cells: how many there are, about.  A cell's genes lie in one file, in order.
    """
    ship(counts.sparkSession)
    n = max(1, -(-cells // PACKED))
    rows = counts.select(F.pmod(F.xxhash64("cell_id"), F.lit(n)).cast("int").alias("file"), "cell_id", F.col("gene").cast("int").alias("gene"), F.col("cnt").cast("int").alias("cnt"))
    shared = {"features/name": np.array([name.encode() for _, name, _ in features]), "features/feature_type": np.array([kind.encode() for _, _, kind in features])}

    def emit(file: int, parts: list):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, genes, values = (pa.concat_arrays([p.column(i) for p in parts]) for i in (1, 2, 3))
        runs = pc.run_end_encode(names)
        barcodes = [v.encode() for v in runs.values.to_pylist()]
        parts = {
            "barcodes": np.array(barcodes),
            "indptr": np.concatenate([[0], runs.run_ends.to_numpy()]).astype(np.int64),
            "indices": genes.to_numpy(),
            "data": values.to_numpy(),
            "shape": np.array([len(features), len(barcodes)], np.int32),
            **shared,
        }
        content = write_file({f"{group}/{k}": v for k, v in parts.items()}, chunk, shuffle=True)
        return pa.record_batch([pa.array([file], pa.int32()), pa.array([content], pa.binary())], names=["file", "content"])

    def run(batches):
        now, held = None, []
        for b in batches:
            of = b.column(0).to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1) if len(of) else []:
                file = int(of[part[0]])
                if file != now and held:
                    yield emit(now, held)
                    held = []
                now = file
                held.append(b.slice(part[0], len(part)))
        if held:
            yield emit(now, held)

    return rows.repartition("file").sortWithinPartitions("file", "cell_id", "gene").mapInArrow(run, "file int, content binary")


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def write_file(datasets: dict[str, np.ndarray], chunk: int | None = None, shuffle: bool = False) -> bytes:
    """A file of one-dimensional datasets by path, contiguous, or in deflated chunks of so many values, by symbol tables."""
    out = bytearray(96)

    def put(data: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        out.extend(data)
        return len(out) - len(data)

    def header(messages: list[bytes]) -> int:
        body = b"".join(messages)
        return put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def dataset(v: np.ndarray) -> int:
        if v.dtype.kind == "S":
            kind = struct.pack("<BBBBI", 0x13, 0, 0, 0, v.dtype.itemsize)
        elif v.dtype.kind == "f":
            kind = struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, v.dtype.itemsize * 8 - 1, 0, v.dtype.itemsize, 0, v.dtype.itemsize * 8, 52, 11, 0, 52, 1023)
        else:
            kind = struct.pack("<BBBBIHH", 0x10, 8 if v.dtype.kind == "i" else 0, 0, 0, v.dtype.itemsize, 0, v.dtype.itemsize * 8)
        messages = [_message(SPACE, struct.pack("<BBB5xQ", 1, 1, 0, len(v))), _message(TYPE, kind)]
        if chunk is None:
            messages.append(_message(LAYOUT, struct.pack("<BBQQ", 3, 1, put(v.tobytes()) if len(v) else NOWHERE, v.nbytes)))
            return header(messages)
        keys = []
        for at in range(0, len(v), chunk):
            part = np.zeros(chunk, v.dtype)
            part[: len(v[at : at + chunk])] = v[at : at + chunk]
            raw = part.tobytes()
            if shuffle:
                raw = np.frombuffer(raw, np.uint8).reshape(chunk, -1).T.tobytes()
            raw = zlib.compress(raw)
            keys.append((len(raw), at, put(raw)))
        nodes = []
        for i in range(0, len(keys), 64):
            some = keys[i : i + 64]
            body = b"".join(struct.pack("<IIQQQ", n, 0, at, 0, where) for n, at, where in some) + struct.pack("<IIQQ", 0, 0, some[-1][1] + chunk, 0)
            nodes.append((some[0][1], put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(some), NOWHERE, NOWHERE) + body)))
        tree = nodes[0][1] if nodes else NOWHERE
        if len(nodes) > 1:
            body = b"".join(struct.pack("<IIQQQ", 0, 0, at, 0, where) for at, where in nodes) + struct.pack("<IIQQ", 0, 0, len(v), 0)
            tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(nodes), NOWHERE, NOWHERE) + body)
        messages.append(_message(LAYOUT, struct.pack("<BBBQII", 3, 2, 2, tree, chunk, v.dtype.itemsize)))
        filters = [*([struct.pack("<HHHHI4x", SHUFFLE, 0, 1, 1, v.dtype.itemsize)] if shuffle else []), struct.pack("<HHHHI4x", DEFLATE, 0, 1, 1, 6)]
        messages.append(_message(FILTERS, struct.pack("<BB6x", 1, len(filters)) + b"".join(filters)))
        return header(messages)

    def group(tree: dict) -> int:
        places = {n: group(x) if isinstance(x, dict) else dataset(x) for n, x in tree.items()}
        names, offsets = bytearray(8), {}
        for n in sorted(places):
            offsets[n] = len(names)
            names += n.encode() + b"\0" + bytes(-(len(n) + 1) % 8)
        heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, put(bytes(names))))
        symbols = b"".join(struct.pack("<QQII16x", offsets[n], places[n], 0, 0) for n in sorted(places))
        node = put(b"SNOD" + struct.pack("<BBH", 1, 0, len(places)) + symbols)
        last = offsets[max(places)] if places else 0
        root = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, last))
        return header([_message(TABLE, struct.pack("<QQ", root, heap))])

    nested: dict = {}
    for path, v in datasets.items():
        *folders, name = path.split("/")
        at = nested
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = v
    root = group(nested)
    out[:96] = SIGNATURE + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 64, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(out), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
    return bytes(out)
