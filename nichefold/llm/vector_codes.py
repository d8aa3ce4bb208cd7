"""Vectors as short codes: product quantisation by Lloyd's iterations that are kept up by differences.

A vector becomes whole numbers floor(scale * x) and is cut into equal parts; each part position has a codebook.  All rounds work on whole numbers, so
sums don't depend on order or partitioning.  A round reads the table of vectors with their previous assignment, writes it with the new one, and shuffles
only what changed: each part that moved takes its numbers from the entry that it left and gives them to the one that it joined, added up where the rows lie
before they are dealt by (part, entry).  The running sums and counts, parts x entries x (width + 1) numbers whatever the rows, are held on the driver.

Defined cases: a null or empty vector, one that holds a null, NaN or infinite component, one whose width isn't a multiple of the parts, and one of another width
than the usable vector of the smallest id is dropped.  Components of more than LIMIT / scale in size count as that, so that distances fit 64 bits.
A null id ranks after all others; rows that share an id are coded each, and start codebooks in the order of their numbers.  Fewer rows than entries
make codebooks of as many entries; an empty table gives an empty table and no entries.  Columns that are kept may have any name: the new ones
get a number added where the table has one of that name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from nichefold.llm.common import free_names, give_back, materialise, scratch, ship
from nichefold.sources.stage import remove

#: Largest size of a number: squared distances of 8,192 of them fit 64 bits.
LIMIT = (1 << 24) - 1
#: Rows whose distances to all entries are held at a time.
ROWS_AT_ONCE = 2048


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))


def usable(vec: Column, parts: int) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & (F.size(vec) % parts == 0) & fine, F.lit(False))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each row, ties to the lower index, and its squared distance; exact."""
    most = (np.abs(x).max(initial=0) + np.abs(entries).max(initial=0)) ** 2 * x.shape[1]
    kind = np.float64 if most < 1 << 52 else np.int64
    a, c = x.astype(kind), entries.astype(kind)
    d = (c * c).sum(axis=1) - 2 * (a @ c.T)
    best = d.argmin(axis=1)
    return best, (d[np.arange(len(a)), best] + (a * a).sum(axis=1)).astype(np.int64)


@dataclass
class Codebooks:
    """entries: parts x entries x width whole numbers.  sums, counts: what the entries are made of."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def start(cls, vectors: list[list[int]], parts: int) -> Codebooks:
        x = np.array(vectors, dtype=np.int64).reshape(len(vectors), parts, -1) if vectors else np.zeros((0, parts, 0), dtype=np.int64)
        e = x.transpose(1, 0, 2).copy()
        return cls(e, np.zeros_like(e), np.zeros(e.shape[:2], dtype=np.int64))

    def add(self, changes) -> None:
        """Changes (part, entry, n, sums) to the running sums; then the entries that have parts become their means."""
        for c in changes:
            self.counts[c[0], c[1]] += c[2]
            self.sums[c[0], c[1]] += np.array(c[3:], dtype=np.int64)
        n = self.counts[:, :, None]
        self.entries = np.where(n > 0, self.sums // np.maximum(n, 1), self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(rows: DataFrame, q: str, code: str, was: str | None, error: str | None, entries: np.ndarray) -> DataFrame:
    """rows with the code of each vector; the code that they had goes to ``was``, the squared distance, summed over parts, to ``error``."""
    spark = rows.sparkSession
    ship(spark)
    books = spark.sparkContext.broadcast(entries)
    codes = ArrayType(IntegerType())
    held = [c for c in rows.columns if c != code and (error is None or c != q)]
    new = [StructField(code, codes)] + ([StructField(was, codes)] if was else []) + ([StructField(error, LongType())] if error else [])
    made = StructType([*(rows.schema[c] for c in held), *new])
    columns = [*held, *([] if error is None else [q]), *([code] if code in rows.columns and was else [])]
    at_q, at_code = columns.index(q), columns.index(code) if code in columns else None
    # Names are the table's; on the way through Python columns go by place.
    places = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(made.fields)])

    def run(batches):
        import pyarrow as pa

        e = books.value
        parts, _, width = e.shape
        for big in batches:
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                b = big.slice(at, ROWS_AT_ONCE)
                n = b.num_rows
                x = b.column(at_q).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width).astype(np.int64)
                found = [nearest(x[:, p], e[p]) for p in range(parts)]
                flat = np.stack([f[0] for f in found], axis=1).astype(np.int32).ravel()
                out = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(flat))]
                if was:
                    out.append(pa.nulls(n, pa.list_(pa.int32())) if at_code is None else b.column(at_code))
                if error:
                    out.append(pa.array(sum(f[1] for f in found)))
                yield pa.record_batch([*b.columns[: len(held)], *out], names=places.names)
            give_back()

    return rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, places).toDF(*made.names)


def changes(rows: DataFrame, q: str, code: str, was: str, parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what the parts whose assignment changed add to and take from entries."""
    at = lambda c, p: F.get(F.col(f"`{c}`"), p)
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("part"), at(code, p).alias("now"), at(was, p).alias("old"), F.slice(F.col(f"`{q}`"), p * width + 1, width).alias("v")))
    moved = rows.select(F.explode(F.filter(each, lambda m: ~m["now"].eqNullSafe(m["old"]))).alias("m")).select("m.*")
    one = F.lit(1).cast("long")
    signed = moved.select("part", "v", F.explode(F.filter(F.array(F.struct(F.col("now").alias("entry"), one.alias("n")), F.struct(F.col("old").alias("entry"), (-one).alias("n"))), lambda s: s["entry"].isNotNull())).alias("s")).select("part", "v", "s.entry", "s.n")
    sums = [F.sum(F.col("n") * F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    return signed.groupBy("part", "entry").agg(F.sum("n").alias("n_"), *sums).withColumnRenamed("n_", "n")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """The kept columns of the usable vectors with ``code`` (array of entries' indexes) and ``error``, and the codebooks.

    Codebooks start as the parts of the first vectors by id and are improved for so many rounds; then all vectors are coded.
    """
    spark = vectors.sparkSession
    keep = [id_col] if keep is None else list(keep)
    q, code, was, error, key = free_names(keep, ["q", "code", "was", "error", "key"])
    fine = vectors.filter(usable(F.col(f"`{vec_col}`"), parts))
    rows = materialise(fine.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias(key), whole_numbers(F.col(f"`{vec_col}`"), scale).alias(q)), "vectors")
    order = [F.col(key).asc_nulls_last()]
    first = rows.orderBy(*order, F.size(q), q).select(F.size(q)).first()
    width = first[0] if first else 0
    rows = rows.filter(F.size(q) == width)
    start = [r[0] for r in rows.orderBy(*order, q).select(q).limit(entries).collect()]  # as many as a codebook has entries
    books = Codebooks.start(start, parts)
    state, path = rows.drop(key), None
    for _ in range(rounds if start else 0):
        new = scratch(spark, "codes")
        made = assign(state, q, code, was, None, books.entries)
        made.write.parquet(new)
        if path:
            remove(spark, path)
        path, state = new, spark.read.schema(made.schema).parquet(new)
        books.add(changes(state, q, code, was, parts, width // parts).collect())  # at most parts x entries rows
        state = state.drop(was)
    return materialise(assign(state, q, code, None, error, books.entries), "coded"), books
