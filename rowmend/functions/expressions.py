"""Column expressions used by several operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def order_key(salt: str | Column, row_id: str | Column = "row_id") -> Column:
    """Deterministic pseudo-random sort key of a row: 32 hexadecimal digits.

    It depends only on the salt and ``row_id``, so it is the same for every
    partitioning, and any SQL engine with ``md5`` can reproduce it.
    """
    salt = F.lit(salt) if isinstance(salt, str) else salt
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws(":", salt, row_id.cast("string")).cast("binary"))


def uniform(salt: str | Column, row_id: str | Column = "row_id") -> Column:
    """Deterministic uniform number in [0, 1) of a row."""
    head = F.substring(order_key(salt, row_id), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def literal_array(values, dtype: str = "double") -> Column:
    """Constant array column (parsed at once, not one literal at a time)."""
    suffix = {"double": "D", "bigint": "L"}[dtype]
    body = ", ".join(f"{v!r}{suffix}" for v in values)
    return F.expr(f"cast(array({body}) as array<{dtype}>)")


def as_int_floor(proportion: Column, n: Column) -> Column:
    """``int(p * n)`` in double arithmetic."""
    return F.floor(proportion.cast("double") * n.cast("double"))


def binary_entropy(p1: Column) -> Column:
    """Shannon entropy in bits of a two-class probability."""
    p0 = F.lit(1.0) - p1
    return -(p0 * F.log2(p0 + F.lit(1e-9)) + p1 * F.log2(p1 + F.lit(1e-9)))


def harmonic(n: Column) -> Column:
    """H(n) = 1 + 1/2 + ... + 1/n for an integer column n >= 0: a table for
    small n, the asymptotic series (error below 1e-16) from 64 on."""
    table, total = [0.0], 0.0
    for j in range(1, 64):
        total += 1.0 / j
        table.append(total)
    m = n.cast("double")
    inv2 = F.lit(1.0) / (m * m)
    series = (
        F.log(m)
        + F.lit(EULER_GAMMA)
        + F.lit(0.5) / m
        - inv2 * (F.lit(1 / 12) - inv2 * (F.lit(1 / 120) - inv2 * F.lit(1 / 252)))
    )
    exact = F.element_at(literal_array(table), F.least(n, F.lit(63)).cast("int") + 1)
    return F.when(n < 64, exact).otherwise(series)


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """Yeo-Johnson power transform; lambda is a constant or a column."""
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    mirror = F.lit(2.0) - lam
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    down = F.when(F.abs(mirror) < 1e-12, -F.log1p(-x)).otherwise(
        -(F.pow(1.0 - x, mirror) - 1.0) / mirror
    )
    return F.when(x >= 0, up).otherwise(down)


def z_bin(x: Column, mean: float | None, sd: float | None, half: int = 4) -> Column:
    """Bin of a number: half-deviation steps around the mean, clipped to
    ``2 * half`` bins; -1 for missing."""
    if mean is None or not sd or math.isnan(sd):
        inside = F.lit(half)
    else:
        step = F.floor((x - F.lit(float(mean))) / F.lit(float(sd)) * 2.0)
        inside = F.greatest(F.lit(0), F.least(F.lit(2 * half - 1), step + half))
    return F.when(x.isNull(), F.lit(-1)).otherwise(inside).cast("int")
