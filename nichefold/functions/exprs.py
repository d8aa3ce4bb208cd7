"""Column expressions shared by the operators; all stay on the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME, MULT, MULT2, STRIDE = 2147483647, 48271, 69621, 1000003
#: How far apart numbers of steps and units are put before they are hashed.
LEAP = 1000000007
EPS = 1e-8


def stable_hash(x: Column, seed: int = 0) -> Column:
    """A pseudo-random integer below 2^31-1 from integer arithmetic that any SQL engine repeats; x is below 2^46."""
    n = x.cast("long") + F.lit(1 + seed * STRIDE).cast("long")
    a = (n * F.lit(MULT)) % F.lit(PRIME)
    return ((a * a) % F.lit(PRIME) + n) * F.lit(MULT2) % F.lit(PRIME)


def stable_hashes(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """stable_hash of an array of numbers."""
    n = x + (1 + seed * STRIDE)
    a = n * MULT % PRIME
    return (a * a % PRIME + n) * MULT2 % PRIME


def id_number(rows: DataFrame, id_col: str) -> Column:
    """An id as a number for stable_hash: whole numbers as they are, other ids by 44 bits of the MD5 of their text."""
    if dict(rows.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(id_col).cast("long")
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 11), 16, 10).cast("long")


def stable_unit(x: Column, seed: int = 0) -> Column:
    return (stable_hash(x, seed) + F.lit(0.5)) / F.lit(float(PRIME))


def half_up(c: Column, digits: int = 6) -> Column:
    """Rounded half up on the scaled double."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def half_even(c: Column, digits: int = 4) -> Column:
    """Rounded half to even on the scaled double, as array libraries do."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v over its length, which is worked out once a vector; the zero vector stays zero."""
    over = lambda w: lambda n: F.transform(w, lambda x: x.cast("double") / n)
    scaled = lambda w: F.get(F.transform(F.array(F.greatest(norm(w), F.lit(EPS))), over(w)), F.lit(0))
    return F.get(F.transform(F.array(v), scaled), F.lit(0))


def as_score(c: Column) -> Column:
    """A score in which NaN ranks last, as null."""
    return F.when(~F.isnan(c), c)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))
