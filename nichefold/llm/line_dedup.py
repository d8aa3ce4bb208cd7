"""Line dedup over all documents, without moving texts through the dedup.

Every line's 128-bit key hash travels with its document and position only.  The rows are range-partitioned
and sorted by (hash, document, position), so one stream over a partition sees the occurrences of
a line in order and needs to remember no more than the first document of the present line.  As ranges are cut on
all sort columns, a line that a third of all documents hold is spread over many partitions; what a
partition can't settle alone, its first line, is settled from the first documents that all partitions report for
their outermost lines: two rows a partition.  The result is a compressed keep bitmap for each
document that loses lines; texts meet the bitmaps in one join.

Defined cases: null text is one empty line, as is empty text; ids are of any type: whole numbers rank as such, others by their text's bytes; a null
id ranks after all others and is one document; rows that share id and text are one document each to its own output row, with the same bitmap; rows that
share an id but not the text count as one document when lines are compared; lines whose key is short are never dropped; texts of any length are read
whole; an empty table gives an empty table; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import free_name, give_back, materialise, ship

#: ASCII white space that keys lose at both ends, and the code points that a key needs.
SPACES, LEAST = b" \t\n\x0b\x0c\r", 10
LAST_ID = (1 << 63) - 1
ROWS = "h1 long, h2 long, d {0}, t long, pos int"
WHOLE = ("tinyint", "smallint", "int", "bigint")


def rank_of(docs: DataFrame, id_col: str) -> Column:
    """A document's rank, null ids last: the id as a long, or its text behind "0", which sorts before the "1" of null."""
    if dict(docs.dtypes)[id_col] in WHOLE:
        return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    return F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1"))


def key(line: bytes) -> bytes:
    """A line's key: stripped of ASCII white space, A-Z in lower case."""
    return line.strip(SPACES).lower()


def long_enough(k: bytes) -> bool:
    return len(k) >= LEAST and (len(k) >= 4 * LEAST or len(k.decode("utf-8", "replace")) >= LEAST)


def pack(dropped: list[int]) -> bytes:
    """A compressed keep bitmap: bit i is 1 if line i stays; lines after the last bit stay."""
    import numpy as np

    keep = np.ones((max(dropped) // 8 + 1) * 8, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keeps(bitmap: bytes, n: int) -> list[bool]:
    """Of n lines, which the bitmap keeps."""
    import numpy as np

    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[:n].astype(bool).tolist()
    return bits + [True] * (n - len(bits))


def _hash_lines(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_128_digest
    for b in batches:
        hashes, docs, texts, places = [], [], [], []
        for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            body = text.as_py()
            if not body:
                continue
            n = len(hashes)
            for i, line in enumerate(body.split(b"\n")):
                k = line.strip(SPACES).lower()
                if len(k) >= LEAST and long_enough(k):
                    hashes.append(digest(k))
                    places.append(i)
            docs += [d] * (len(hashes) - n)
            texts += [t] * (len(hashes) - n)
        if hashes:
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, b.schema.field(0).type), pa.array(texts, pa.int64()), pa.array(places, pa.int32())],
                names=["h1", "h2", "d", "t", "pos"],
            )
        give_back()


def _first_occurrences(batches):
    """kind 0: a line to drop; 1: a line of the partition's first key, left open; 2: an outermost key and its first document here."""
    import numpy as np
    import pyarrow as pa

    names = ["kind", "h1", "h2", "d", "t", "pos"]
    head = last = kind_of_id = None
    in_head = True

    def rows(kind: int, h1, h2, d, t, pos):
        return pa.record_batch([pa.array(np.full(len(h1), kind, dtype=np.int32)), pa.array(h1), pa.array(h2), pa.array(d, kind_of_id), pa.array(t), pa.array(pos, pa.int32())], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kind_of_id = b.schema.field(2).type
        h1, h2, d, t, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.empty(n, dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last is None or (h1[0], h2[0]) != last[:2]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(start >= 0, d[np.maximum(start, 0)], last[2] if last else 0)
        if head is None:
            head = (h1[0], h2[0], d[0])
        edge = 0
        if in_head:
            others = np.flatnonzero(new[1:] if last is None else new)
            edge = n if not len(others) else int(others[0]) + (1 if last is None else 0)
            in_head = edge == n
            if edge:
                yield rows(1, *(x[:edge] for x in (h1, h2, d, t, pos)))
        drop = np.flatnonzero(d[edge:] != first[edge:]) + edge
        if len(drop):
            yield rows(0, *(x[drop] for x in (h1, h2, d, t, pos)))
        last = (h1[-1], h2[-1], first[-1])
    give_back()
    if head is not None:
        ends = {head[:2]: head[2], last[:2]: last[2]} if head[:2] != last[:2] else {head[:2]: head[2]}
        a = np.array(list(ends), dtype=np.int64)
        zero = np.zeros(len(a), dtype=np.int64)
        yield rows(2, a[:, 0].copy(), a[:, 1].copy(), list(ends.values()), zero, zero.astype(np.int32))


def _pack_rows(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([pack(p) for p in b.column(2).to_pylist()], pa.binary())], names=["d", "t", "bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (d, t, bitmap) for each document that loses lines: its rank, the hash of its text, its keep bitmap."""
    ship(docs.sparkSession)
    kind = "long" if dict(docs.dtypes)[id_col] in WHOLE else "string"
    body = docs.select(rank_of(docs, id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    order = ["h1", "h2", "d", "t", "pos"]
    lines = body.mapInArrow(_hash_lines, ROWS.format(kind)).repartitionByRange(*order).sortWithinPartitions(*order)
    marks = materialise(lines.mapInArrow(_first_occurrences, f"kind int, {ROWS.format(kind)}"), "line-marks")
    # At most two rows a partition, so this side is small whatever the corpus.
    heads = marks.filter("kind = 2").groupBy("h1", "h2").agg(F.min("d").alias("first"))
    open_ends = marks.filter("kind = 1").join(F.broadcast(heads), ["h1", "h2"]).filter("d <> first")
    drops = marks.filter("kind = 0").select("d", "t", "pos").unionByName(open_ends.select("d", "t", "pos"))
    return drops.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("ps")).mapInArrow(_pack_rows, f"d {kind}, t long, bitmap binary")


def with_bitmaps(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and the keep bitmap of each row as column ``name``, null where all lines stay."""
    d, t = free_name(docs, "d_"), free_name(docs, "t_")
    maps = keep_bitmaps(docs, id_col, text_col).toDF(d, t, name)
    keyed = docs.withColumn(d, rank_of(docs, id_col)).withColumn(t, F.xxhash64(text_col))
    return keyed.join(maps, [d, t], "left").drop(d, t)


def kept_text(text: bytes | None, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, its number of lines, and how many are dropped."""
    text = text or b""
    n = text.count(b"\n") + 1
    if bitmap is None:
        return text, n, 0
    stay = keeps(bitmap, n)
    return b"\n".join(line for line, k in zip(text.split(b"\n"), stay, strict=True) if k), n, n - sum(stay)


def _apply_to(batches, text_at: int, map_at: int):
    import pyarrow as pa

    for b in batches:
        out = [kept_text(x.as_py(), m.as_py())[0] for x, m in zip(b.column(text_at), b.column(map_at), strict=True)]
        columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == text_at else b.column(i) for i in range(b.num_columns) if i != map_at]
        yield pa.record_batch(columns, names=[x for i, x in enumerate(b.schema.names) if i != map_at])
        give_back()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text cut to the lines that stay; other columns as they are, null texts become empty."""
    m = free_name(docs, "bitmap")
    rows = with_bitmaps(docs, m, id_col, text_col).select(*docs.columns, m)
    at = docs.columns.index(text_col)
    schema = docs.schema
    return rows.withColumn(text_col, F.col(text_col).cast("binary")).mapInArrow(lambda x: _apply_to(x, at, len(schema.fields)), schema)
