"""Model-free ranking by contribution to the label parity gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import score_rank


def parity_impact_scores(train: DataFrame) -> DataFrame:
    """(row_id, score): how much the gap between the groups' positive rates
    shrinks when this row alone is taken out.

    The score depends only on (protected, y), so four counts are enough.
    """
    rows = train.groupBy("protected").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    ).collect()
    n = {True: 0, False: 0}
    pos = {True: 0, False: 0}
    for r in rows:
        n[bool(r["protected"])] += r["n"]
        pos[bool(r["protected"])] += r["pos"]

    def rate(positives: int, size: int) -> float:
        return positives / size if size else 0.0

    base = abs(rate(pos[True], n[True]) - rate(pos[False], n[False]))

    def without(group: bool, label: int) -> float:
        own = rate(pos[group] - label, n[group] - 1) if n[group] else 0.0
        other = rate(pos[not group], n[not group])
        return base - abs(own - other)

    is_prot = F.coalesce(F.col("protected"), F.lit(False))
    score = (
        F.when(is_prot & (F.col("y") == 1), without(True, 1))
        .when(is_prot, without(True, 0))
        .when(F.col("y") == 1, without(False, 1))
        .otherwise(without(False, 0))
    )
    return train.select("row_id", score.cast("double").alias("score"))


def rank_by_parity_impact(train: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(row_id, score, rank, n_ranked), largest gap reduction first."""
    scores = parity_impact_scores(train).withColumn("score", F.round("score", 12))
    if candidates is not None:
        scores = scores.join(candidates.select("row_id"), "row_id", "left_semi")
    return score_rank(scores, "score", descending=True, total_col="n_ranked")
