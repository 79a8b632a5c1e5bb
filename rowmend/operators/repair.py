"""Repair actions and ranked prefixes.

An action takes a frame and a boolean column that marks the selected rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_int_floor

Action = Callable[[DataFrame, Column], DataFrame]


def action_cap(col: str, cap: float, mode: str = "assign") -> Action:
    """Set ``col`` to the cap on selected rows; ``mode="clip"`` only lowers."""
    value = F.lit(float(cap)) if mode == "assign" else F.least(F.col(col), F.lit(float(cap)))

    def act(df: DataFrame, selected: Column) -> DataFrame:
        return df.withColumn(col, F.when(selected, value).otherwise(F.col(col)))

    return act


def action_remove() -> Action:
    """Drop selected rows."""
    return lambda df, selected: df.where(~F.coalesce(selected, F.lit(False)))


def action_flip() -> Action:
    """Set y to 1 - y on selected rows."""
    return lambda df, selected: df.withColumn(
        "y", F.when(selected, 1 - F.col("y")).otherwise(F.col("y"))
    )


def action_restore_labels() -> Action:
    """Set y back to ``y_clean`` on selected rows."""
    return lambda df, selected: df.withColumn(
        "y", F.when(selected, F.col("y_clean")).otherwise(F.col("y"))
    )


def remove_listed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the rows whose ``row_id`` is in another table."""
    return df.join(ids.select("row_id"), "row_id", "left_anti")


def restore_from(df: DataFrame, trusted: DataFrame, ids: DataFrame) -> DataFrame:
    """Take ``y`` from a trusted label table for the listed rows."""
    fix = trusted.select("row_id", F.col("y").alias("_y")).join(
        ids.select("row_id"), "row_id", "left_semi"
    )
    return df.join(fix, "row_id", "left").withColumn("y", F.coalesce("_y", "y")).drop("_y")


def proportion_grid(n_points: int = 21, step: float = 0.05) -> list[float]:
    """Cleaning proportions 0, step, 2*step, ..."""
    return [i * step for i in range(n_points)]


def in_prefix(proportion: Column | float, max_proportion: float = 1.0) -> Column:
    """Row is among the first int(min(p, max) * n_ranked) of its ranking."""
    p = F.lit(float(proportion)) if isinstance(proportion, (int, float)) else proportion
    return F.col("rank") <= as_int_floor(F.least(p, F.lit(float(max_proportion))), F.col("n_ranked"))


def first_grid_index(
    grid: list[float], max_proportion: float | Column = 1.0
) -> Column:
    """Index of the first grid point whose prefix includes the row;
    ``len(grid)`` when none does."""
    top = F.lit(float(max_proportion)) if isinstance(max_proportion, (int, float)) else max_proportion
    missed = [
        (as_int_floor(F.least(F.lit(p), top), F.col("n_ranked")) < F.col("rank")).cast("int")
        for p in grid
    ]
    total = missed[0]
    for m in missed[1:]:
        total = total + m
    return total


def apply_prefix(df: DataFrame, ranking: DataFrame, proportion: float, action: Action,
                 max_proportion: float = 1.0) -> DataFrame:
    """Repair the first int(p * n_ranked) rows of a ranking."""
    chosen = ranking.where(in_prefix(proportion, max_proportion)).select(
        "row_id", F.lit(True).alias("_sel")
    )
    joined = df.join(chosen, "row_id", "left")
    return action(joined, F.coalesce(F.col("_sel"), F.lit(False))).drop("_sel")
