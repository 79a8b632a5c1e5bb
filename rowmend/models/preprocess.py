"""Preprocessing fitted by aggregates, usable alone or in an ``ml.Pipeline``.

MLlib's own stages differ from what is needed here: its median is approximate
and takes the lower middle value, its scaler divides by the sample deviation,
and it has no power transform.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import yeo_johnson
from ..operators.encode import median_of, mode_of

# the task functions below travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Projection(Model):
    """Fitted stage that rewrites columns with expressions."""

    def __init__(self, build):
        super().__init__()
        self._build = build

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(self._build())


class MedianImputer(Estimator):
    """Fill missing numbers with the exact median of the fitted rows."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame) -> Model:
        med = median_of(dataset, self.cols)
        return _Projection(
            lambda: {
                c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0)))
                for c in self.cols
            }
        )


class ModeImputer(Estimator):
    """Fill missing values with the most frequent one, smallest on a tie."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame) -> Model:
        mode = mode_of(dataset, self.cols)
        return _Projection(lambda: {c: F.coalesce(F.col(c), F.lit(mode[c])) for c in self.cols})


class Standardizer(Estimator):
    """Subtract the mean, divide by the population deviation (1 if zero)."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame) -> Model:
        row = dataset.agg(
            *[F.avg(c).alias(f"m_{c}") for c in self.cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in self.cols],
        ).first()
        return _Projection(
            lambda: {
                c: (F.col(c) - F.lit(row[f"m_{c}"] or 0.0)) / F.lit(row[f"s_{c}"] or 1.0)
                for c in self.cols
            }
        )


POINTS = 9  # lambdas tried in a pass
WIDEST = 1e4  # beyond it a column has no best lambda to speak of


def _power(x: np.ndarray, lam: float) -> np.ndarray:
    size = np.log1p(np.abs(x))
    up = size if abs(lam) < 1e-12 else np.expm1(lam * size) / lam
    down = -size if abs(2 - lam) < 1e-12 else -np.expm1((2 - lam) * size) / (2 - lam)
    return np.where(x >= 0, up, down)


def _power_sums(df: DataFrame, cols: Sequence[str], points: dict[str, list[float]], middle: dict[str, float]) -> DataFrame:
    """(c, i, n, l, s1, s2, s3): per column and lambda the pieces of the log-likelihood.

    A task adds up each batch's count, mean and squared deviations; n, sum of n * mean, of the deviations and of
    n * mean^2 give the variance of all.  Means are those of the distance to the transformed ``middle``, as powers
    may be much larger than their variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cols), POINTS, 5))
        for batch in batches:
            for k, c in enumerate(cols):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                total[k, :, 0] += len(x)
                total[k, :, 1] += (np.sign(x) * np.log1p(np.abs(x))).sum()
                with np.errstate(all="ignore"):
                    for i, lam in enumerate(points[c]):
                        z = _power(x, lam) - _power(np.array([middle[c]]), lam)
                        mean = z.mean()
                        total[k, i, 2:] += (len(z) * mean, ((z - mean) ** 2).sum(), len(z) * mean * mean)
        for k, c in enumerate(cols):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * POINTS), pa.array(range(POINTS), pa.int32()), *(pa.array(total[k, :, j]) for j in range(5))],
                ["c", "i", "n", "l", "s1", "s2", "s3"],
            )

    parts = df.select(*cols).mapInArrow(run, "c string, i int, n double, l double, s1 double, s2 double, s3 double")
    return parts.groupBy("c", "i").agg(*[F.sum(x).alias(x) for x in ("n", "l", "s1", "s2", "s3")])


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], low: float = -5.0, high: float = 5.0) -> dict[str, float]:
    """Maximum-likelihood lambda per column; 1 for a column without two different values.

    Each pass tries nine lambdas of every column in one go.  If the best is the first or the last, the bracket moves
    there and doubles, as often as needed; else it closes in on the best.  The last one is refined by a parabola
    through it and its neighbours.  A column whose likelihood still grows at ``WIDEST`` is an error."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first() if cols else {}
    middle = {c: float(means[c] or 0.0) for c in cols}
    grid, best, open_ = {c: (low, high) for c in cols}, dict.fromkeys(cols, 1.0), set(cols)
    while open_:
        now = [c for c in cols if c in open_]
        points = {c: np.linspace(*grid[c], POINTS).tolist() for c in now}
        found = {c: np.full(POINTS, -np.inf) for c in now}
        for r in _power_sums(df, now, points, middle).collect():  # nine rows per column
            if r["n"]:
                v = (r["s2"] + r["s3"] - r["s1"] ** 2 / r["n"]) / r["n"]
                if v > 0 and math.isfinite(v):
                    found[r["c"]][r["i"]] = -r["n"] / 2 * math.log(v) + (points[r["c"]][r["i"]] - 1) * r["l"]
        for c in now:
            like, at = found[c], points[c]
            i, (a, b) = int(np.argmax(like)), grid[c]
            if not np.isfinite(like[i]):
                open_.discard(c)
                continue
            best[c] = at[i]
            if i in (0, POINTS - 1):
                if abs(at[i]) > WIDEST:
                    raise ValueError(f"the power of column {c} has no best value within {WIDEST:g}")
                grid[c] = (at[i] - (b - a), at[i] + (b - a))
                continue
            step = at[1] - at[0]
            if step < 1e-3:
                left, mid, right = like[i - 1 : i + 2]
                bend = left - 2 * mid + right
                if np.isfinite(bend) and bend < 0:
                    best[c] = float(at[i] + step * (left - right) / (2 * bend))
                open_.discard(c)
            else:
                grid[c] = (at[i - 1], at[i + 1])
    return best


class YeoJohnson(Estimator):
    """Power transform with maximum-likelihood lambda, then standardised."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, dataset: DataFrame) -> Model:
        lam = fit_yeo_johnson(dataset, self.cols)
        power = _Projection(
            lambda: {c: yeo_johnson(F.col(c).cast("double"), lam[c]) for c in self.cols}
        )
        scale = Standardizer(self.cols).fit(power.transform(dataset))
        return _Chain([power, scale])


class _Chain(Model):
    def __init__(self, stages):
        super().__init__()
        self._stages = stages

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for stage in self._stages:
            dataset = stage.transform(dataset)
        return dataset


def anova_f(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, f): one-way ANOVA F of each column against ``y``, one pass."""
    pieces = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    )
    per = (
        df.select("y", pieces.alias("e"))
        .select("y", "e.feature", "e.x")
        .where(F.col("x").isNotNull())
        .groupBy("feature", "y")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    )
    grand = per.groupBy("feature").agg(
        F.sum("n").alias("nn"),
        F.count(F.lit(1)).alias("g"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"),
    )
    between = (F.col("smm") - F.col("nn") * F.col("mm") * F.col("mm")) / (F.col("g") - 1)
    within = F.col("ssw") / (F.col("nn") - F.col("g"))
    return grand.select("feature", F.when(F.col("g") > 1, between / within).alias("f"))
