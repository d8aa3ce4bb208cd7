"""Packing documents into sequences of several lengths without padding.

The tiers are windows of powers of two up to the longest.  A document gives whole longest windows first; what is left of it is routed to the smallest tier that holds
it.  Each tier's pieces, the longest first, open windows of that tier, and a window's gap, always under half of it, is filled from shorter tiers: by the
longest whole piece that fits, again and again, and at last by cutting the head off the shortest piece that is longer.  So every window is
full.  A task does this as its documents stream through, CHUNK pieces at a time; what doesn't fill a window of the smallest tier at its end is packed
again with that of POOLED other tasks.  Windows are then dealt to step groups tier by tier, so that all groups have the same tokens, to a window a tier.

The longest path is one scan of the documents, which are tokenised once; only pieces (numbers, no tokens) are written, and only what is left of a task, fewer than
256 tokens, is shuffled with its tokens.

Defined cases: null text is empty and has the end token alone; texts of any length are read whole and cut where a window ends; equal texts have equal tokens; rows
that share an id are packed each, with starts of their own; a null id is carried; an empty table gives no pieces.  Only the id and text columns are
read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nichefold.llm.common import give_back, materialise, ship

#: Windows: powers of two from the shortest to the longest.
SHORTEST, LONGEST = 256, 2048
#: Pieces that a task packs together; tasks whose rests are packed together.
CHUNK, POOLED = 4096, 64
#: Sequences of the longest tier, or as many tokens in shorter ones, that a step group has.
STEP_WINDOWS = 64
#: Sequence ids: a task's or pool's number above this many bits, of which the first tells pools and the rest count.
OWN_BITS = 34
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, own long, nth long, `offset` long, window int, rest binary"


class Ids:
    """Token ids of texts under a byte-level vocabulary of ranks, as the vocabulary's JSON form has them, with its special tokens."""

    def __init__(self, ranks: bytes, pattern: str, special: dict[str, int], end: int):
        import tiktoken

        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        self.end = np.array([end], dtype=np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.concatenate([self.encoding.encode_to_numpy(text, allowed_special="all"), self.end]).astype("<u4") if text else self.end.astype("<u4")


def tiers(shortest: int, longest: int) -> list[int]:
    """The windows, shortest first."""
    if shortest < 1 or shortest & (shortest - 1) or longest & (longest - 1) or longest < shortest:
        raise ValueError(f"windows are powers of two: not {shortest} to {longest}")
    out = [shortest]
    while out[-1] < longest:
        out.append(out[-1] * 2)
    return out


class Pool:
    """Pieces (document, start, length) by length."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by: dict[int, deque] = {}
        self.tokens = 0

    def put(self, doc, start: int, length: int) -> None:
        if length not in self.by:
            self.by[length] = deque()
            insort(self.lengths, length)
        self.by[length].append((doc, start))
        self.tokens += length

    def take(self, at: int) -> tuple:
        """A piece of the length at that place of the list of lengths."""
        length = self.lengths[at]
        doc, start = self.by[length].popleft()
        if not self.by[length]:
            del self.by[length], self.lengths[at]
        self.tokens -= length
        return doc, start, length

    def fill(self, gap: int) -> Iterator[tuple]:
        """Pieces of gap tokens together: the longest that fit, then the head of the shortest that doesn't."""
        while gap:
            at = bisect_left(self.lengths, gap + 1)
            if at:
                doc, start, length = self.take(at - 1)
                yield doc, start, length
                gap -= length
            else:
                doc, start, length = self.take(0)
                self.put(doc, start + gap, length - gap)
                yield doc, start, gap
                gap = 0


def full_windows(pool: Pool, windows: list[int], last: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(window, pieces) of windows that are full, until the pool holds less than the longest one, or, at last, than the shortest.

    The longest piece opens a window of its tier; where the pool holds fewer tokens than that, it gives its head to a shorter window.
    """
    while pool.tokens >= windows[0 if last else -1]:
        size = windows[min(bisect_left(windows, pool.lengths[-1]), len(windows) - 1)]
        size = min(size, 1 << (pool.tokens.bit_length() - 1))
        doc, start, length = pool.take(len(pool.lengths) - 1)
        if length > size:
            pool.put(doc, start + size, length - size)
            length = size
        yield size, [(doc, start, length), *pool.fill(size - length)]


class Task:
    """Rows of PIECES of one task; ids of documents are taken from held ones."""

    def __init__(self, number: int, windows: list[int]):
        self.number, self.windows, self.own = number, windows, 0
        self.nth: dict[int, int] = {}
        self.pool, self.pieces = Pool(), 0
        self.rows: list[tuple] = []

    def emit(self, size: int, pieces: list[tuple]) -> None:
        offset, nth = 0, self.nth.get(size, 0)
        for doc, start, length in pieces:
            cut = doc.ids[start - doc.first : start - doc.first + length]
            self.rows.append((doc.key, start, length, zlib.crc32(cut), doc.tokens, self.number, self.own, nth, offset, size, None))
            offset += length
        self.own += 1
        self.nth[size] = nth + 1

    def add(self, doc: Held) -> None:
        """A document's tokens from doc.first on: whole longest windows, the rest to the pool."""
        at, end, longest = doc.first, doc.first + len(doc.ids), self.windows[-1]
        while end - at >= longest:
            self.emit(longest, [(doc, at, longest)])
            at += longest
        if at < end:
            doc.ids, doc.first = doc.ids[at - doc.first :].copy(), at
            self.pool.put(doc, at, end - at)
            self.pieces += 1
        if self.pieces >= CHUNK:
            self.pack(False)

    def pack(self, last: bool) -> None:
        for size, pieces in full_windows(self.pool, self.windows, last):
            self.emit(size, pieces)
        self.pieces = sum(map(len, self.pool.by.values()))

    def close(self, to_pool: bool) -> None:
        """What is left: kept with its tokens to meet other tasks' rests, or packed into ever shorter windows."""
        self.pack(True)
        if to_pool:
            rest = [self.pool.take(len(self.pool.lengths) - 1) for _ in range(self.pieces)]
            self.rows += [(d.key, s, n, None, d.tokens, self.number, None, None, None, None, d.ids[s - d.first : s - d.first + n].tobytes()) for d, s, n in rest]
        else:
            self.windows = tiers(1, self.windows[-1])
            self.pack(True)


class Held:
    """A document and those of its ids that are still needed, from place first on."""

    __slots__ = ("first", "ids", "key", "tokens")

    def __init__(self, key, ids: np.ndarray, first: int, tokens: int):
        self.key, self.ids, self.first, self.tokens = key, ids, first, tokens


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_made: dict[str, Ids] = {}


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end: int, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window and step.

    A piece is so many tokens of a document from start on and lies at offset in its sequence; window is the sequence's tier and step its group.
    ranks_path is read on the driver and broadcast: about a megabyte, whatever the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = tiers(shortest, longest)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    schema = StructType.fromDDL(PIECES.format(id=kind))

    def tokenise(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        if ranks_path not in _made:
            _made[ranks_path] = Ids(ranks.value, pattern, special, end)
        ids = _made[ranks_path]
        want = to_arrow_schema(schema)
        task = Task(TaskContext.get().partitionId(), windows)
        for b in batches:
            keys = b.column(0).to_pylist()
            for key, text in zip(keys, b.column(1), strict=True):
                own = ids(text.as_py())
                task.add(Held(key, own, 0, len(own)))
                if len(task.rows) >= 5000:
                    yield _batch(task.rows, want)
                    task.rows = []
            del b
            give_back()
        task.close(True)
        for at in range(0, len(task.rows), 5000):
            yield _batch(task.rows[at : at + 5000], want)
        pa.default_memory_pool().release_unused()

    first = materialise(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tokenise, schema), "pieces")

    def together(key, rests):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        task = Task(-1 - key[0].as_py(), windows)
        for r in zip(*[rests.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "rest")], strict=True):
            task.add(Held(r[0], np.frombuffer(r[3], dtype="<u4"), r[1], r[2]))
        task.close(False)
        return pa.Table.from_batches([_batch(task.rows, want)] if task.rows else [], want)

    rests = first.filter("rest IS NOT NULL").groupBy(F.floor(F.col("part") / POOLED).cast("int").alias("pool")).applyInArrow(together, schema)
    return _with_steps(materialise(first.filter("rest IS NULL").unionByName(rests).drop("rest"), "packed"), longest)


def _with_steps(pieces: DataFrame, longest: int) -> DataFrame:
    """pieces with sequence ids and step groups: each tier's sequences are numbered across tasks and dealt in turn."""
    own = materialise(pieces.groupBy("part", "window").agg((F.max("nth") + 1).alias("n"), F.sum("length").alias("tokens")), "windows")  # a row a task and tier
    groups = max(1, -(-(own.agg(F.sum("tokens")).first()[0] or 0) // (longest * STEP_WINDOWS)))
    run = Window.partitionBy("window").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(own.select("part", "window", F.coalesce(F.sum("n").over(run), F.lit(0).cast("long")).alias("before")), "windows-before")  # joined as its size tells
    number = F.when(F.col("part") >= 0, F.shiftleft(F.col("part").cast("long"), OWN_BITS)).otherwise(F.shiftleft(-1 - F.col("part").cast("long"), OWN_BITS) + (1 << (OWN_BITS - 1)))
    step = F.pmod(F.col("before") + F.col("nth"), F.lit(groups).cast("long"))
    return pieces.join(before, ["part", "window"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (number + F.col("own")).alias("sequence_id"), "offset", "window", step.alias("step"))
