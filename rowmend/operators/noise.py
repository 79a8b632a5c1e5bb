"""Noise injection: a frame in, a corrupted frame with ``is_noisy`` out.

Clean values stay next to the corrupted ones (``y_clean``, ``<col>_clean``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import uniform
from .sampling import exact_sample


def column_stats(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    """Mean and population deviation of a column, missing values skipped."""
    row = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    return row["m"], row["s"]


def _extreme(col: str, chosen, mean, sd, k_range, seed):
    k = F.lit(k_range[0]) + uniform(f"level:{seed}") * F.lit(k_range[1] - k_range[0])
    return F.when(chosen, F.lit(mean) + k * F.lit(sd)).otherwise(F.col(col))


def inject_outlier(
    df: DataFrame,
    col: str,
    level: float,
    k_range: tuple[float, float] = (3.0, 5.0),
    seed: int = 42,
    stats_df: DataFrame | None = None,
) -> tuple[DataFrame, float]:
    """Overwrite ``col`` with mean + k * sd, k uniform per row, on exactly
    int(level * n) rows.  Statistics come from ``stats_df`` (default: ``df``).

    Returns the frame and the repair cap, mean + 2 * sd.
    """
    mean, sd = column_stats(df if stats_df is None else stats_df, col)
    chosen = exact_sample(df, level, seed)
    out = df.withColumns(
        {
            "is_noisy": chosen,
            f"{col}_clean": F.col(col),
            "y_clean": F.col("y"),
            col: _extreme(col, chosen, mean, sd, k_range, seed),
        }
    )
    return out, mean + 2 * sd


def inject_outlier_pooled(
    df: DataFrame,
    col: str,
    level: float,
    k_range: tuple[float, float] = (3.0, 5.0),
    seed: int = 42,
) -> tuple[DataFrame, float]:
    """Outliers drawn over train + val + test together; only the hits in train
    are kept, and the statistics come from train alone.

    Needs the ``split`` column; returns the train rows and the cap.
    """
    pool = df.where(F.col("split") != "unused")
    train = df.where(F.col("split") == "train")
    noisy, cap = inject_outlier(pool, col, level, k_range, seed, stats_df=train)
    return noisy.where(F.col("split") == "train"), cap


def _flip(df: DataFrame, chosen) -> DataFrame:
    return df.withColumns(
        {
            "is_noisy": chosen,
            "y_clean": F.col("y"),
            "y": F.when(chosen, 1 - F.col("y")).otherwise(F.col("y")),
        }
    )


def inject_random_label(df: DataFrame, level: float, seed: int = 42) -> DataFrame:
    """Flip the label of exactly int(level * n) rows."""
    return _flip(df, exact_sample(df, level, seed))


def inject_group_label(df: DataFrame, level: float, seed: int = 42) -> DataFrame:
    """Flip the label of exactly int(level * n_protected) protected rows."""
    return _flip(df, exact_sample(df, level, seed, F.col("protected")))


def inject_group_missing(
    df: DataFrame, cols: Sequence[str], level: float, seed: int = 42
) -> DataFrame:
    """Blank ``cols`` on exactly int(level * n_protected) protected rows."""
    chosen = exact_sample(df, level, seed, F.col("protected"))
    new = {"is_noisy": chosen, "y_clean": F.col("y")}
    for c in cols:
        new[f"{c}_clean"] = F.col(c)
        new[c] = F.when(~chosen, F.col(c))
    return df.withColumns(new)


def no_noise(df: DataFrame) -> DataFrame:
    """Control: nothing is corrupted, every row is a candidate."""
    return df.withColumns({"is_noisy": F.lit(True), "y_clean": F.col("y")})
