"""Logistic regression of many label columns over one table of features.

The loss of each model is the sum of its log losses plus half the squared norm of
its weights (not of the intercept), which is strictly convex: its optimum is unique,
so fits can be compared with any other solver's.  Newton steps for all models take
one pass over the rows together: a task multiplies its feature products with the
matrix of all models' curvatures, and hands on one sum per model.  A step that
makes a model's loss larger is halved.  Passes end when no gradient is larger than
``tol`` times the number of rows.

The sums of a model are (d + 1)(d + 4) / 2 numbers for d features.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the task functions below travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 4_000_000  # numbers of the matrix (rows x models) that a task holds


def own_label(batch: pa.RecordBatch) -> np.ndarray:
    """The labels of a single model: column y."""
    return batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)[:, None]


def sums(rows: DataFrame, beta: np.ndarray, labels: Callable[[pa.RecordBatch], np.ndarray] = own_label) -> DataFrame:
    """(model, i, s): loss, gradient and curvature of every model at its coefficients, without the penalty.

    ``rows``: vec (array of features) and what ``labels`` makes the (rows x models) labels from.  ``beta``:
    (models x features + 1), the intercept first."""
    d = beta.shape[1]
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((beta.shape[0], 1 + d + len(upper[0])))
        step = max(1, BATCH // max(1, beta.shape[0]))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                x = np.ones((batch.num_rows, d))
                x[:, 1:] = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, d - 1)
                y = labels(batch)
                eta = x @ beta.T
                p = 1 / (1 + np.exp(-np.abs(eta)))
                total[:, 0] += (np.logaddexp(0, eta) - y * eta).sum(axis=0)
                total[:, 1 : 1 + d] += (np.where(eta >= 0, p, 1 - p) - y).T @ x
                total[:, 1 + d :] += (p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
        models, width = total.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(models, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), models)), pa.array(total.ravel())],
            ["model", "i", "s"],
        )

    return rows.mapInArrow(run, "model int, i int, s double").groupBy("model", "i").agg(F.sum("s").alias("s"))


def fit(rows: DataFrame, d: int, models: int = 1, labels: Callable[[pa.RecordBatch], np.ndarray] = own_label,
        tol: float = 1e-10, max_iter: int = 100) -> np.ndarray:
    """Coefficients (models x d + 1), the intercept first."""
    d += 1
    beta, step = np.zeros((models, d)), np.zeros((models, d))
    loss = np.full(models, np.inf)
    upper = np.triu_indices(d)
    n = max(1, rows.count())
    penalty = np.ones(d)
    penalty[0] = 0.0
    for _ in range(max_iter):
        total = np.zeros((models, 1 + d + len(upper[0])))
        got = sums(rows, beta, labels).toArrow()  # as many numbers as the models' sums
        total[got["model"].to_numpy(), got["i"].to_numpy()] = got["s"].to_numpy()
        new = total[:, 0] + 0.5 * (beta**2 @ penalty)
        gradient = total[:, 1 : 1 + d] + beta * penalty
        worse = new > loss * (1 + 1e-12) + 1e-12
        open_ = (np.abs(gradient).max(axis=1) > tol * n) & (np.abs(step).max(axis=1, initial=0.0) > 1e-14 * (1 + np.abs(beta).max(axis=1)) if np.isfinite(loss).all() else True)
        if not (worse | open_).any():
            break
        curve = np.zeros((models, d, d))
        curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = total[:, 1 + d :]
        curve += np.diag(penalty)
        # one label only: the intercept has no optimum; a little curvature keeps the step finite
        curve[:, 0, 0] += 1e-12 * n
        newton = -np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        back = worse[:, None]
        beta_now = np.where(back, beta - step / 2, beta + newton)
        step = np.where(back, step / 2, newton)
        loss = np.where(worse, loss, new)
        beta = beta_now
    return beta


def gradient(rows: DataFrame, beta: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(name, slope): derivative of the penalised loss by each coefficient; all are zero at the optimum."""
    d = beta.shape[1]
    spark = rows.sparkSession
    own = spark.createDataFrame(
        [(j + 1, n, float(beta[0, j]) if j else 0.0) for j, n in enumerate(["(intercept)", *names])], "i int, name string, b double"
    )
    assert len(names) == d - 1
    return sums(rows, beta).join(F.broadcast(own), "i").select("name", (F.col("s") + F.col("b")).alias("slope"))


def probability(beta: np.ndarray, vec: str = "vec") -> Column:
    """Of label 1, by one model's coefficients."""
    weights = F.array(*[F.lit(float(b)) for b in beta[1:]])
    eta = F.aggregate(F.zip_with(F.col(vec), weights, lambda x, b: x * b), F.lit(float(beta[0])), lambda a, x: a + x)
    return 1.0 / (1.0 + F.exp(-eta))
