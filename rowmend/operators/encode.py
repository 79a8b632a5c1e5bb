"""Labels, protected groups and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import broadcastable, in_parallel, stable
from .ranking import score_rank


def binary_label(col: str | Column, positive) -> Column:
    """1 where the value equals ``positive`` (or is in the list), else 0."""
    return member(col, positive).cast("int")


def member(col: str | Column, values) -> Column:
    """Equality or IN-list predicate; a missing value is false."""
    col = F.col(col) if isinstance(col, str) else col
    hit = col.isin(*values) if isinstance(values, (list, tuple, set)) else col == F.lit(values)
    return F.coalesce(hit, F.lit(False))


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dictionary (c, value, code) of several columns in one pass: codes
    0, 1, ... per column index ``c``, in first-appearance order."""
    pieces = F.array(
        *[F.struct(F.lit(i).alias("c"), F.col(name).cast("string").alias("value")) for i, name in enumerate(cols)]
    )
    first = (
        df.select("row_id", F.inline(pieces))
        .where(F.col("value").isNotNull())
        .groupBy("c", "value")
        .agg(F.min("row_id").alias("row_id"))
        .withColumn("_first", F.col("row_id").cast("double"))
    )
    ranked = score_rank(first, "_first", by=["c"])
    return ranked.select("c", "value", (F.col("rank") - 1).alias("code"))


def factorize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace strings by codes in first-appearance order; missing becomes -1."""
    return with_codes(df, stable(category_codes(df, cols)), {c: i for i, c in enumerate(cols)})


def with_codes(df: DataFrame, codes: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Replace strings by the codes of a dictionary; ``columns`` gives the column
    index in it.  Missing values and those not in the dictionary become -1."""
    small = broadcastable(codes, "c", "value")
    out = df
    for name, i in columns.items():
        part = codes.where(F.col("c") == i).select(F.col("value").alias(name), F.col("code").alias("_code"))
        part = F.broadcast(part) if i in small else part
        out = out.join(part, name, "left").withColumn(
            name, F.coalesce(F.col("_code"), F.lit(-1)).cast("double")
        ).drop("_code")
    return out.select(*df.columns)


def cast_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast feature columns to double."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def with_position(df: DataFrame) -> DataFrame:
    """Add ``train_position``, the 0-based position in ``row_id`` order."""
    ranked = score_rank(df.withColumn("_id", F.col("row_id").cast("double")), "_id", rank_col="_p")
    return ranked.withColumn("train_position", F.col("_p") - 1).drop("_p", "_id")


def frame_columns(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Drop label, id and free-text columns that must not become features."""
    return df.drop(*drop)


def median_of(df: DataFrame, cols: Sequence[str], collect_rows: int = 50_000) -> dict[str, float | None]:
    """Exact medians of several columns.

    A sketch brackets the middle, the rows below the bracket are counted, and
    only the few distinct values inside it are read.  A bracket that still
    holds too many rows is narrowed by another sketch.  The built-in exact
    median would hold every distinct value of a column in one task.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    sketch = "array(0.49D, 0.51D)"

    def approx(c: str, inside: Column, share: str = sketch) -> Column:
        return F.percentile_approx(F.when(inside, x[c]), F.expr(share), F.lit(10_000))

    first = df.agg(
        *[F.count(x[c]).alias(f"n_{c}") for c in cols],
        *[approx(c, x[c].isNotNull()).alias(f"q_{c}") for c in cols],
        *[F.array(F.min(x[c]), F.max(x[c])).alias(f"r_{c}") for c in cols],
    ).first()
    n = {c: first[f"n_{c}"] for c in cols}
    # one percent of a short column is less than a row
    bracket = {c: tuple(first[f"q_{c}" if n[c] >= 1000 else f"r_{c}"]) for c in cols if n[c]}
    below: dict[str, int] = {}
    open_cols = list(bracket)
    while open_cols:
        inside = {c: x[c].between(*bracket[c]) for c in open_cols}
        row = df.agg(
            *[F.count_if(x[c] < bracket[c][0]).alias(f"b_{c}") for c in open_cols],
            *[F.count_if(inside[c]).alias(f"i_{c}") for c in open_cols],
        ).first()
        wide = []
        for c in open_cols:
            below[c] = row[f"b_{c}"]
            if row[f"i_{c}"] > collect_rows and bracket[c][0] < bracket[c][1]:
                size = row[f"i_{c}"]
                slack = max(0.01, 3 / size)
                low = max(0.0, ((n[c] - 1) // 2 - below[c]) / size - slack)
                high = min(1.0, (n[c] // 2 + 1 - below[c]) / size + slack)
                wide.append((c, f"array({low!r}D, {high!r}D)"))
        if not wide:
            break
        narrower = df.agg(*[approx(c, inside[c], share).alias(c) for c, share in wide]).first()
        open_cols = [c for c, _ in wide if tuple(narrower[c]) != bracket[c]]
        for c in open_cols:
            bracket[c] = tuple(narrower[c])
    values: dict[str, list[tuple[float, int]]] = {c: [] for c in cols}
    if bracket:
        cells = F.array(
            *[F.struct(F.lit(c).alias("c"), F.when(x[c].between(*bracket[c]), x[c]).alias("x")) for c in bracket]
        )
        long = df.select(F.explode(cells).alias("e")).select("e.c", "e.x").where(F.col("x").isNotNull())
        for r in long.groupBy("c", "x").count().collect():
            values[r["c"]].append((r["x"], r["count"]))

    def at(c: str, index: int) -> float:
        index -= below[c]
        for v, count in sorted(values[c]):
            if index < count:
                return v
            index -= count
        raise ValueError(f"the rows of {c} changed between two passes")

    out = {}
    for c in cols:
        if not n[c]:
            out[c] = None
            continue
        low, high = at(c, (n[c] - 1) // 2), at(c, n[c] // 2)
        out[c] = low if low == high else (low + high) / 2
    return out


def mode_of(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column; the smallest one on a tie."""

    def one(c: str):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).count()
        top = counts.orderBy(F.desc("count"), F.asc("v")).limit(1).collect()
        return top[0]["v"] if top else None

    return dict(zip(cols, in_parallel(*[lambda c=c: one(c) for c in cols])))
