"""Reports over stored curves.

Input is the long curve table (dataset, noise_type, model, method, seed,
proportion, n_cleaned, accuracy, dp_gap).  Seeds of the random order are
averaged first, so every configuration has one value per method and point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["dataset", "noise_type", "model"]
# list order decides ties between methods
METHODS = ["shapley", "confident", "entropy", "random"]
ALL_METHODS = ["shapley", "fair_shapley", "fair_heuristic", "confident", "entropy", "random"]


def mean_curves(curves: DataFrame) -> DataFrame:
    """Average over seeds."""
    return curves.groupBy(*KEYS, "method", "proportion").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("dp_gap").alias("dp_gap")
    )


def finals(curves: DataFrame) -> DataFrame:
    """Per configuration and method: value before cleaning and at the end."""
    first = lambda c: F.min_by(c, "proportion")
    last = lambda c: F.max_by(c, "proportion")
    return mean_curves(curves).groupBy(*KEYS, "method").agg(
        first("accuracy").alias("baseline"),
        last("accuracy").alias("final"),
        first("dp_gap").alias("baseline_dp"),
        last("dp_gap").alias("final_dp"),
    )


def _wide(rows: DataFrame, value: str, base: str, methods: list[str]) -> DataFrame:
    pivot = rows.groupBy(*KEYS).pivot("method", methods).agg(F.first(value))
    head = rows.groupBy(*KEYS).agg(F.max(base).alias("baseline"))
    return head.join(pivot, KEYS)


def experiment_summary(curves: DataFrame) -> DataFrame:
    """Baseline and final accuracy per method, four decimals."""
    wide = _wide(finals(curves), "final", "baseline", ALL_METHODS)
    return wide.select(*KEYS, *[F.round(c, 4).alias(c) for c in ["baseline", *ALL_METHODS]])


def _order_of(method: Column) -> Column:
    out = F.lit(len(METHODS))
    for i, m in enumerate(METHODS):
        out = F.when(method == m, i).otherwise(out)
    return out


def best_method(curves: DataFrame) -> DataFrame:
    """Method with the highest final accuracy; list order breaks ties."""
    rows = finals(curves).where(F.col("method").isin(METHODS) & F.col("final").isNotNull())
    rows = rows.withColumn("final", F.round("final", 9))
    best = F.max_by(F.struct("method", "final", "baseline"), F.struct("final", -_order_of(F.col("method"))))
    return rows.groupBy(*KEYS).agg(best.alias("b")).select(
        *KEYS, F.col("b.method").alias("best"), F.round("b.final", 4).alias("best_accuracy"),
        F.round(F.col("b.final") - F.col("b.baseline"), 6).alias("gain"),
    )


def improvement_heatmap(curves: DataFrame) -> DataFrame:
    """Mean over models of final minus baseline, per dataset and noise type."""
    shown = [m for m in METHODS if m != "random"]
    rows = finals(curves).where((F.col("baseline") > 0) & F.col("final").isNotNull())
    return (
        rows.groupBy("dataset", "noise_type")
        .pivot("method", shown)
        .agg(F.round(F.avg(F.col("final") - F.col("baseline")), 6))
    )


def accuracy_table(curves: DataFrame) -> DataFrame:
    """Wide accuracy table with the best method; missing values stay NULL."""
    wide = _wide(finals(curves), "final", "baseline", METHODS)
    wide = wide.select(*KEYS, *[F.round(c, 4).alias(c) for c in ["baseline", *METHODS]])
    return wide.join(best_method(curves).select(*KEYS, "best"), KEYS, "left")


def top_gains(curves: DataFrame, min_gain: float = 0.01, limit: int = 8) -> DataFrame:
    """Configurations where the best method gains most over the baseline."""
    return (
        best_method(curves)
        .where(F.col("gain") > min_gain)
        .orderBy(F.desc("gain"), *KEYS)
        .limit(limit)
    )


def outlier_focus(curves: DataFrame) -> DataFrame:
    """Outlier runs: baseline, and the end of capping, removal and random."""
    rows = finals(curves)
    cap = rows.where("noise_type = 'outlier'")
    capped = cap.groupBy("dataset", "model").agg(
        F.max("baseline").alias("baseline"),
        F.max(F.when(F.col("method") == "shapley", F.col("final"))).alias("cap_final"),
        F.max(F.when(F.col("method") == "random", F.col("final"))).alias("random_final"),
    )
    removed = rows.where("noise_type = 'outlier_removal' and method = 'shapley'").select(
        "dataset", "model", F.col("final").alias("removal_final")
    )
    joined = capped.join(removed, ["dataset", "model"])
    return joined.select(
        "dataset", "model",
        *[F.round(c, 4).alias(c) for c in ("baseline", "cap_final", "removal_final", "random_final")],
    )


def no_noise_summary(curves: DataFrame) -> DataFrame:
    """Control runs: one row per point with every method, and the spread of
    the random order."""
    rows = curves.where("noise_type = 'no_noise'")
    per = rows.groupBy("dataset", "model", "method", "proportion").agg(
        F.avg("accuracy").alias("a"), F.stddev_pop("accuracy").alias("s")
    )

    def of(method: str, value: str) -> Column:
        return F.round(F.max(F.when(F.col("method") == method, F.col(value))), 6)

    first = Window.partitionBy("dataset", "model").orderBy("proportion")
    out = per.groupBy("dataset", "model", "proportion").agg(
        of("shapley", "a").alias("shapley"),
        of("confident", "a").alias("confident"),
        of("entropy", "a").alias("entropy"),
        of("random", "a").alias("random_mean"),
        of("random", "s").alias("random_std"),
    )
    return out.withColumn("baseline", F.first("shapley").over(first))


def dp_summary(curves: DataFrame) -> DataFrame:
    """Baseline and final demographic-parity gap per method."""
    wide = _wide(finals(curves), "final_dp", "baseline_dp", ALL_METHODS)
    return wide.select(
        *KEYS, F.round("baseline", 4).alias("baseline_dp"),
        *[F.round(c, 4).alias(c) for c in ALL_METHODS],
    )
