"""Exact-count splits, samples and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_rows, hash_rank


def split_rows(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    val_cap: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Add ``split``: exactly ceil(test_size * n) test rows, then
    ceil(val_size / (1 - test_size) * rest) validation rows, the rest train.

    With ``val_cap``, validation rows beyond it (another random order) are ``unused``.
    Only predicates on ``row_id`` are added; no row moves.
    """
    val_frac = val_size / (1 - test_size)

    def sizes(n: int) -> list[int]:
        n_test = math.ceil(test_size * n)
        return [n_test, n_test + math.ceil(val_frac * (n - n_test))]

    salt = f"split:{seed}"
    _, (test, held) = first_rows(df, salt, sizes)
    out = df.withColumn(
        "split",
        F.when(test.holds(salt), "test").when(held.holds(salt), "val").otherwise("train"),
    )
    if val_cap is not None and held.size - test.size > val_cap:
        cap_salt = f"valcap:{seed}"
        _, (kept,) = first_rows(out.where("split = 'val'"), cap_salt, lambda n: [val_cap])
        drop = (F.col("split") == "val") & ~kept.holds(cap_salt)
        out = out.withColumn("split", F.when(drop, "unused").otherwise(F.col("split")))
    return out


def exact_sample(
    df: DataFrame, level: float, seed: int = 42, where: Column | None = None
) -> Column:
    """Predicate that holds for exactly int(level * n) rows of ``df``.

    With ``where``, n counts only the rows of that group and only they can be
    chosen.
    """
    salt = f"noise:{seed}"
    pool = df if where is None else df.where(where)
    _, (cut,) = first_rows(pool, salt, lambda n: [int(level * n)])
    chosen = cut.holds(salt)
    return chosen if where is None else F.coalesce(where, F.lit(False)) & chosen


def exact_first(df: DataFrame, n: int, salt: str) -> Column:
    """Predicate for n rows of ``df`` in a random order (all when fewer)."""
    _, (cut,) = first_rows(df, salt, lambda total: [min(n, total)])
    return cut.holds(salt)


def stratified_folds(df: DataFrame, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold``: every label is dealt round-robin over the folds, in hash
    order, so fold sizes per label differ by at most one."""
    ranked = hash_rank(df, f"fold:{seed}", by=["y"], rank_col="_r")
    return ranked.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(n_folds)).cast("int")).drop("_r")
