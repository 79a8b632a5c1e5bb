"""Rankings from out-of-fold class probabilities (row_id, y, p1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import stable
from ..functions import binary_entropy
from .ranking import hash_rank, score_rank

DIGITS = 9  # probabilities are compared at nine decimals


def self_confidence(oof: DataFrame) -> DataFrame:
    """Add ``conf``, the probability of the row's own label."""
    p_own = F.when(F.col("y") == 1, F.col("p1")).otherwise(1.0 - F.col("p1"))
    return oof.withColumn("conf", F.round(p_own, DIGITS))


def class_thresholds(oof: DataFrame) -> tuple[float | None, float | None]:
    """t_j: mean probability of class j over the rows labelled j."""
    row = oof.agg(
        F.avg(F.when(F.col("y") == 0, 1.0 - F.col("p1"))).alias("t0"),
        F.avg(F.when(F.col("y") == 1, F.col("p1"))).alias("t1"),
    ).first()
    return row["t0"], row["t1"]


def suggested_label(t0: float | None, t1: float | None):
    """Most probable class among those at or above their threshold; NULL when
    there is none."""
    p1 = F.col("p1")
    p0 = 1.0 - p1
    ok0 = F.round(p0, DIGITS) >= F.round(F.lit(t0), DIGITS) if t0 is not None else F.lit(False)
    ok1 = F.round(p1, DIGITS) >= F.round(F.lit(t1), DIGITS) if t1 is not None else F.lit(False)
    return (
        F.when(ok0 & ok1, F.when(F.round(p1, DIGITS) > F.round(p0, DIGITS), 1).otherwise(0))
        .when(ok1, 1)
        .when(ok0, 0)
    )


def confident_joint(oof: DataFrame) -> DataFrame:
    """(given, suggested, n): rows per given label and confident label."""
    t0, t1 = class_thresholds(oof)
    return (
        oof.withColumn("suggested", suggested_label(t0, t1))
        .where(F.col("suggested").isNotNull())
        .groupBy(F.col("y").alias("given"), "suggested")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def issue_counts(oof: DataFrame) -> dict[int, int]:
    """Rows to flag per given label: the off-diagonal of the confident joint,
    rescaled to the label counts and rounded half up."""
    joint = {(r["given"], r["suggested"]): r["n"] for r in confident_joint(oof).collect()}
    sizes = {r["y"]: r["count"] for r in oof.groupBy("y").count().collect()}
    out = {}
    for label in (0, 1):
        same, other = joint.get((label, label), 0), joint.get((label, 1 - label), 0)
        seen = same + other
        out[label] = int(other * sizes.get(label, 0) / seen + 0.5) if seen else 0
    return out


def find_label_issues(oof: DataFrame, all_rows: bool = False) -> DataFrame:
    """(row_id, score, rank, n_ranked), lowest self-confidence first.

    Flags, per given label, the counted number of least confident rows whose
    own label is not already the more probable one.  ``all_rows`` ranks every
    row instead.
    """
    frame = stable(self_confidence(oof).select("row_id", "y", "p1", "conf"))
    if not all_rows:
        quota = issue_counts(frame)
        ranked = score_rank(frame, "conf", by=["y"], rank_col="_r")
        limit = F.when(F.col("y") == 1, quota[1]).otherwise(quota[0])
        frame = ranked.where((F.col("_r") <= limit) & (F.col("conf") < 0.5))
    return score_rank(
        frame.select("row_id", F.col("conf").alias("score")), "score", total_col="n_ranked"
    )


def rank_by_entropy(oof: DataFrame) -> DataFrame:
    """(row_id, score, rank, n_ranked), most uncertain first, all rows."""
    scores = oof.select("row_id", F.round(binary_entropy(F.col("p1")), DIGITS).alias("score"))
    return score_rank(scores, "score", descending=True, total_col="n_ranked")


def rank_random(candidates: DataFrame, seeds: Sequence[int] = (100, 101, 102)) -> DataFrame:
    """(seed, row_id, rank, n_ranked): one random order per seed."""
    n = candidates.count()
    rows = candidates.select(
        "row_id", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed")
    )
    salt = F.concat_ws(":", F.lit("shuffle"), F.col("seed").cast("string"))
    return hash_rank(rows, salt, by=["seed"]).withColumn("n_ranked", F.lit(n).cast("long"))
