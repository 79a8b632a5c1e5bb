"""Accuracy and demographic-parity gap as aggregate expressions."""

from __future__ import annotations

import warnings

from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(pred: str = "pred", y: str = "y", weight: Column | None = None) -> Column:
    """Share of rows with pred = y."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return F.sum(F.when(F.col(pred) == F.col(y), w).otherwise(0.0)) / F.sum(w)


def demographic_parity_gap(
    pred: str = "pred", protected: str = "protected", weight: Column | None = None
) -> Column:
    """|P(pred = 1 | protected) - P(pred = 1 | not protected)|, 0 when a group
    is empty."""
    w = F.lit(1.0) if weight is None else weight.cast("double")

    def rate(group: Column) -> Column:
        hits = F.sum(F.when(group & (F.col(pred) == 1), w).otherwise(0.0))
        rows = F.sum(F.when(group, w).otherwise(0.0))
        return F.when(rows > 0, hits / rows)

    return F.coalesce(F.abs(rate(F.col(protected)) - rate(~F.col(protected))), F.lit(0.0))


def evaluate(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both metrics in one pass, per group of ``by``."""
    grouped = predictions.groupBy(*(by or []))
    return grouped.agg(accuracy().alias("accuracy"), demographic_parity_gap().alias("dp_gap"))


def trainable(train: DataFrame) -> bool:
    """A model can be fitted: rows exist and both labels occur."""
    return train.agg(F.count_distinct("y")).first()[0] >= 2


def evaluate_guarded(model, train: DataFrame, test: DataFrame) -> dict[str, float | None]:
    """Both metrics of ``model`` fitted on ``train``; None where there is nothing
    to fit (no rows, one label) or the fit is refused as invalid."""
    nothing = {"accuracy": None, "dp_gap": None}
    if not trainable(train):
        return nothing
    try:
        return evaluate(model.predict(train, test)).first().asDict()
    except (ArithmeticException, IllegalArgumentException, ValueError) as e:
        warnings.warn(f"no fit: {e}", stacklevel=2)
        return nothing


def random_mean_std(curve: DataFrame) -> DataFrame:
    """Mean and population deviation over the seeds, per method and point."""
    return curve.groupBy("method", "proportion").agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("dp_gap").alias("dp_gap_mean"),
        F.stddev_pop("dp_gap").alias("dp_gap_std"),
    )
