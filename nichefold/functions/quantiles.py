"""Exact quantiles of a whole column without bringing its values to one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may be ranked in one place, and pieces that a range is cut into a round.
FEW, PIECES = 10_000, 512


def _ranked(values: DataFrame, rank: int, lo: float, hi: float, n: int, few: int) -> list[float]:
    """The values from that rank on, from 0, that lie about it, among n values from lo to hi: the piece that holds it is found by counts, round by round."""
    while lo < hi and n > few:
        width = (hi - lo) / PIECES
        piece = F.least(F.lit(PIECES - 1), F.floor((F.col("v") - lo) / width)) if width > 0 and math.isfinite(width) else (F.col("v") >= hi).cast("long")
        rows = values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(piece.alias("p")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        for r in rows.orderBy("a").collect():
            if rank < r.c:
                lo, hi, n = r.a, r.b, r.c
                break
            rank -= r.c
    if lo == hi:
        return [lo] * min(2, n - rank)
    return [r.v for r in values.filter((F.col("v") >= lo) & (F.col("v") <= hi)).orderBy("v").collect()[rank : rank + 2]]


def exact_quantiles(df: DataFrame, column: str, qs: list[float], few: int = FEW) -> list[float | None]:
    """Quantiles with linear interpolation; nulls don't count, NaN is above all numbers; None where there are no values."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n, lo, hi = values.agg(F.count("*"), F.min("v"), F.max(F.nanvl("v", F.lit(float("inf"))))).first()
    if not n:
        return [None] * len(qs)
    values = values.select(F.nanvl("v", F.lit(float("inf"))).alias("v"))
    lo = min(lo, hi)
    found: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank not in found:
            found.update(enumerate(_ranked(values, rank, lo, hi, n, few), rank))  # mostly the next one, too
        return found[rank]

    out = []
    for q in qs:
        place = q * (n - 1)
        low = math.floor(place)
        a = at(low)
        out.append(a if place == low else a + (at(min(low + 1, n - 1)) - a) * (place - low))
    return out
