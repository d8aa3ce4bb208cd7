"""WARC archives as a PySpark Python data source, ``spark.read.format("warc")``.

Planning makes a partition of each archive file.  Reading parses a record's headers first and decides
on them: predicates on record type and other header columns are pushed down, and what they refuse is skipped without
decoding its payload.  Compressed archives hold one gzip member a record; members written here carry their length
in the "sl" extra field, so skipping one is a seek.  Archives without it are read as a stream.  A
payload is decoded only if the schema asks for ``payload``, ``payload_sha256`` or ``payload_length``.

Writing (``df.write.format("warc").save(folder)``) makes archives of at most about 64 MB.  Each task
attempt writes under names of its own that readers ignore, and the driver's commit gives them their final names, so
repeated or lost tasks leave no records behind.

Defined cases: null headers aren't written; control characters in a header's value, and blanks at its ends, are written and read as percent-encoded; a null payload is empty; a record without WARC-Type is of type "";
files whose name starts with "." or "_" aren't archives; an archive cut off in a record, or with a record without a whole number as
Content-Length, ends there; a member that tells its length but whose bytes don't match its checksum is left out where its payload is wanted, and those
after it are read; members with and without a length may follow each other; repeated rows are written as often as they come; an empty table is an
archive without records; columns that aren't of this format aren't written.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Columns that are header fields.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload_length long, payload_sha256 string, payload binary"
DECODED = {"payload", "payload_sha256", "payload_length"}
FILE_BYTES, BATCH_BYTES, PEEK = 64 << 20, 8 << 20, 4096
HTTP = "application/http"


#: Names that Spark's file systems go by here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def open_fs(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import ArrowInvalid, fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    scheme, sep, rest = path.partition("://")
    if not sep:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except ArrowInvalid as e:
        raise ValueError(f"archives can't be read or written at {path}: {e}") from e


def list_archives(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, at = open_fs(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member of a record, with its own and the record's length in an "sl" field."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 24 + len(body) + 8
    if max(total, len(record)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(record)) + body + tail


#: What would end a header's value or be lost at its ends: control characters anywhere, blanks first and last.
UNSAFE = re.compile(r"[\x00-\x1f\x7f]|^ +| +$")


def header_value(v: str) -> str:
    """A value that stays within its line: what is unsafe is percent-encoded."""
    return UNSAFE.sub(lambda m: "".join(f"%{ord(c):02X}" for c in m.group()), v)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {header_value(v)}\r\n" for k, v in fields)
    return b"WARC/1.0\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def http_block(payload: bytes, length: int | None = None) -> bytes:
    """An HTTP response; with a length but no payload, what a revisit keeps of one."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length) + payload


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip(" \t")
        elif ":" in line:
            k, _, v = line.partition(":")
            out[last := k.strip().lower()] = v.strip(" \t")
    return out


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """A block's payload, and the payload's length even where a revisit leaves it out."""
    if not fields.get("content-type", "").startswith(HTTP):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    if fields.get("warc-type") == "revisit":
        n = parse_fields(head).get("content-length", "")
        return body, int(n) if n.isdigit() else len(body)
    return body, len(body)


def length_of(fields: dict[str, str]) -> int | None:
    """Content-Length, or None if it is missing or no whole number."""
    n = fields.get("content-length", "")
    return int(n) if n.isascii() and n.isdigit() else None


def _tells_length(start: bytes) -> bool:
    return len(start) >= 24 and start[:4] == b"\x1f\x8b\x08\x04" and start[12:16] == b"sl\x08\x00"


def _member(f, at: int, wanted) -> tuple[int, tuple[dict[str, str], bytes | None] | None] | None:
    """Length and record of the member at a place; None for its record if that is damaged, None at all where the archive ends."""
    f.seek(at)
    piece = f.read(PEEK)
    total, size = struct.unpack_from("<II", piece, 16)
    if total < 32:
        return None
    inflate = zlib.decompressobj(-15)
    try:
        data, tail, read = inflate.decompress(piece[24:total]), piece[:total][-8:], len(piece)
        while b"\r\n\r\n" not in data and read < total:
            more = f.read(min(PEEK, total - read))
            if not more:
                return None
            data, tail, read = data + inflate.decompress(more), (tail + more)[-8:], read + len(more)
        fields = parse_fields(data.partition(b"\r\n\r\n")[0])
        n = length_of(fields)
        if n is None:
            return None
        if not wanted(fields):
            return total, (fields, None)
        if read < total:
            rest = f.read(total - read)
            if len(rest) < total - read:
                return None
            data, tail = data + inflate.decompress(rest), (tail + rest)[-8:]
    except zlib.error:
        return total, None
    start = data.find(b"\r\n\r\n") + 4
    whole = len(data) == size and struct.pack("<II", zlib.crc32(data), size) == tail and start + n <= size
    return total, (fields, data[start : start + n]) if whole else None


def _members(f, length: int, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a compressed archive; None instead of a block that isn't wanted.  Members that tell their length are skipped by it."""
    at = 0
    while at < length:
        f.seek(at)
        if not _tells_length(f.read(24)):
            f.seek(at)
            yield from _stream(gzip.GzipFile(fileobj=f), wanted)
            return
        found = _member(f, at, wanted)
        if found is None or at + found[0] > length:
            return
        if found[1] is not None:
            yield found[1]
        at += found[0]


def _stream(f, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an archive read from front to back, up to where it is cut off or damaged."""
    try:
        while True:
            line = f.readline()
            while line in (b"\r\n", b"\n"):
                line = f.readline()
            if not line.startswith(b"WARC/"):
                return
            head = [line]
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            fields = parse_fields(b"".join(head).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
            n = length_of(fields)
            if n is None or not line:
                return
            if wanted(fields):
                block = f.read(n)
                if len(block) < n:
                    return
                yield fields, block
                continue
            if n and f.seekable() and not isinstance(f, gzip.GzipFile):
                f.seek(n - 1, io.SEEK_CUR)
                n = 1 - len(f.read(1))
            else:
                while n > 0 and (skipped := f.read(min(n, 1 << 20))):
                    n -= len(skipped)
            if n:
                return
            yield fields, None
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def read_archive(path: str, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields, block or None) of each record; wanted(fields) says whether its block is needed."""
    system, at = open_fs(path)
    with system.open_input_file(at) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        if f.peek(2)[:2] == b"\x1f\x8b":
            yield from _members(f, raw.size(), wanted)
        else:
            yield from _stream(f, wanted)


def _test(filters: list[tuple[str, str, tuple]]):
    def passes(fields: dict[str, str]) -> bool:
        for column, kind, values in filters:
            v = fields.get(HEADERS[column].lower(), "" if column == "warc_type" else None)
            if v is None or kind == "in" and v not in values or kind == "starts" and not v.startswith(values):
                return False
        return True

    return passes


class WarcPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.filters: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self.filters.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.filters.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.filters.append((column, "starts", (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.filters.append((column, "present", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [WarcPartition(p) for p, size in list_archives(self.path) if size] or [WarcPartition("")]

    def read(self, partition: InputPartition):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        names = self.schema.names
        decode, passes = bool(DECODED & set(names)), _test(self.filters)
        want = to_arrow_schema(self.schema)
        rows: list[tuple] = []
        held = 0
        for fields, block in read_archive(partition.path, lambda x: decode and passes(x)):
            if not passes(fields):
                continue
            out = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            out["warc_type"] = out["warc_type"] or ""
            out["content_length"] = length_of(fields)
            if block is not None:
                body, out["payload_length"] = payload_of(fields, block)
                out["payload"] = body
                out["payload_sha256"] = hashlib.sha256(body).hexdigest() if "payload_sha256" in names else None
            rows.append(tuple(out.get(c) for c in names))
            held += len(block or b"") * ("payload" in names) + 500
            if held > BATCH_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), want.types, strict=True)], schema=want)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), want.types, strict=True)], schema=want)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with header columns, payload_length and payload."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _finish(self, system, names: list[str]) -> None:
        for n in names:
            folder, _, name = n.rpartition("/")
            system.move(n, f"{folder}/{name.removeprefix('.').removesuffix('.open')}")

    def write(self, iterator) -> Written:
        system, folder = open_fs(self.path)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(columns, row, strict=True))
                if out is None:
                    names.append(f"{folder}/.{uuid.uuid4().hex}.warc.gz.open")
                    out, size = system.open_output_stream(names[-1], compression=None), 0
                body = r.get("payload") or b""
                length = r.get("payload_length")
                revisit = r.get("warc_type") == "revisit"
                fields = [(h, r[c]) for c, h in HEADERS.items() if c != "content_type" and r.get(c) is not None]
                data = member(record([*fields, ("Content-Type", f"{HTTP}; msgtype=response")], http_block(b"" if revisit else body, length if revisit else None)))
                out.write(data)
                size += len(data)
                if size > FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        system, folder = open_fs(self.path)
        from pyarrow import fs

        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for old, _ in list_archives(self.path):
                system.delete_file(open_fs(old)[1])
        for m in messages:
            if m is not None:
                self._finish(system, m.names)

    def abort(self, messages) -> None:
        system, _ = open_fs(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            system.delete_file(n)


class WarcDataSource(DataSource):
    """Options: path, a file or folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark) -> None:
    """Makes format("warc") known to the session and lets filters reach it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
