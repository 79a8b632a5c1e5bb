"""Monte-Carlo Shapley values of groups of rows (sources, segments)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Spec, stable
from ..models.naive_bayes import Binner, long_counts, point_counts, point_metrics

BATCH_NUMBERS = 4_000_000  # coalitions scored in one pass, permutations x (groups + 1), times feature values


def group_shapley(
    train: DataFrame, val: DataFrame, spec: Spec, group: str, n_perms: int = 50, seed: int = 0
) -> DataFrame:
    """(group, score, n_rows): mean gain in validation accuracy when a group's
    rows join the groups before it, over random orders of the groups.

    The training rows are read once, for the counts of every group; the model
    of a coalition is a sum of group counts, and the coalitions of a batch of
    permutations are scored in one pass.
    """
    binner = Binner.fit(train, spec)
    names = binner.names
    counts = stable(long_counts(train.select(F.col(group).alias("grp"), "y", *binner.columns()), names, ["grp"]))
    sizes = counts.where("f = 0").groupBy("grp").agg(
        F.sum("c0").alias("g0"), F.sum("c1").alias("g1")
    )
    n_groups = sizes.count()
    n_values = counts.select("f", "v").distinct().count()
    batch = max(1, BATCH_NUMBERS // ((n_groups + 1) * max(1, n_values)))
    gains = None
    for first in range(0, n_perms, batch):
        n = min(batch, n_perms - first)
        part = _gains(binner, val, sizes, counts, n_groups, first, n, seed)
        if n < n_perms:
            part = stable(part)
        gains = part if gains is None else gains.unionByName(part)
    return gains.groupBy(F.col("grp").alias(group)).agg(F.avg("gain").alias("score"), F.max("n_rows").alias("n_rows"))


def _gains(binner: Binner, val: DataFrame, sizes: DataFrame, counts: DataFrame, n_groups: int,
           first: int, n_perms: int, seed: int) -> DataFrame:
    """(grp, n_rows, gain) for the permutations first .. first + n_perms - 1."""
    spark = val.sparkSession
    h = F.md5(
        F.concat_ws(":", F.lit(f"perm:{seed}"), F.col("perm").cast("string"), F.col("grp").cast("string")).cast("binary")
    )
    order = Window.partitionBy("perm").orderBy(h, "grp")
    perms = stable(
        sizes.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(first + n_perms - 1))))
        .withColumn("position", F.row_number().over(order))
    )
    width = n_groups + 1
    gid = ((F.col("perm") - first) * width + F.col("position")).cast("int").alias("gid")
    # one row for each coalition of the batch; the first of a permutation is empty
    n0s, n1s = np.zeros((n_perms, width)), np.zeros((n_perms, width))
    for r in perms.select(gid, "g0", "g1").collect():
        n0s[divmod(r["gid"], width)], n1s[divmod(r["gid"], width)] = r["g0"], r["g1"]
    totals = [np.cumsum(m, axis=1).ravel() for m in (n0s, n1s)]
    # a group's counts belong to every later coalition of its permutation: a run of the models
    changes = perms.select("perm", "grp", "position").join(counts, "grp").select(
        gid, "f", "v", F.col("c0").alias("d0"), F.col("c1").alias("d1")
    )
    scored = point_counts(binner, val, *totals, stable(changes), width)
    utility = point_metrics(scored).select("gid", F.col("accuracy").alias("u"))
    by_perm = Window.partitionBy(F.floor(F.col("gid") / width)).orderBy("gid")
    gain = utility.select("gid", (F.col("u") - F.lag("u").over(by_perm)).alias("gain"))
    return perms.select("grp", gid, (F.col("g0") + F.col("g1")).alias("n_rows")).join(gain, "gid").select("grp", "n_rows", "gain")
