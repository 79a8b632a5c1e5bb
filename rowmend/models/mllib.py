"""Logistic regression on transformed columns, and MLlib's random forest on
selected principal components.

Same interface as the Naive Bayes scorer, without the one-pass sweep: every
point of a cleaning curve refits everything, preprocessing included.  Where a
repair changes labels only, the logistic models of all points share their
preprocessing and are fitted together (``relabel_sweep``).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Spec, in_parallel, stable
from ..operators.sampling import stratified_folds
from . import logistic
from .naive_bayes import point_metrics
from .preprocess import MedianImputer, ModeImputer, Standardizer, YeoJohnson

# the task functions below travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MLModel:
    """A list of stages whose last one is the classifier.

    Category columns must hold codes (see ``factorize``).
    """

    def __init__(self, name: str, spec: Spec, stages: Callable[[DataFrame], list], n_folds: int = 5):
        self.name = name
        self.spec = spec
        self._stages = stages
        self.n_folds = n_folds

    def _fit(self, train: DataFrame, classifier: bool = True):
        stages = self._stages(train)
        return Pipeline(stages=stages if classifier else stages[:-1]).fit(train)

    def space(self, train: DataFrame):
        """Function that maps a frame to one array column ``vec``, the input
        of the classifier."""
        model = self._fit(train, classifier=False)

        def apply(df: DataFrame) -> DataFrame:
            return model.transform(df).withColumn("vec", vector_to_array("features"))

        return apply, ["vec"]

    def predict(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        out = self._fit(train).transform(rows)
        p1 = vector_to_array("probability")[1]
        return out.withColumns({"p1": p1, "pred": F.col("prediction").cast("int")})

    def oof(self, train: DataFrame, seed: int = 0) -> DataFrame:
        folded = stable(stratified_folds(train, self.n_folds, seed))

        def one(fold: int) -> DataFrame:
            fit_on = folded.where(F.col("fold") != fold)
            scored = self.predict(fit_on, folded.where(F.col("fold") == fold))
            return scored.select("row_id", "y", "fold", "p1")

        parts = in_parallel(*[lambda fold=fold: one(fold) for fold in range(self.n_folds)])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return stable(out)


class LogisticModel(MLModel):
    """Stages, and ``logistic.fit`` in place of the last one."""

    def __init__(self, spec: Spec, stages: Callable[[DataFrame], list], n_folds: int = 5, max_iter: int = 1000):
        super().__init__("logistic", spec, stages, n_folds)
        self.max_iter = max_iter

    def coefficients(self, train: DataFrame):
        """The preprocessing, and the coefficients over its output."""
        apply, _ = self.space(train)
        rows = stable(apply(train).select("vec", F.col("y").cast("int").alias("y")))
        return apply, logistic.fit(rows, len(self.spec.features), max_iter=self.max_iter)[0]

    def predict(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        apply, beta = self.coefficients(train)
        out = apply(rows).withColumn("p1", logistic.probability(beta))
        return out.withColumn("pred", (F.col("p1") > 0.5).cast("int")).drop("features", "vec")

    def certificate(self, train: DataFrame) -> DataFrame:
        """(name, slope) of the fitted model."""
        apply, beta = self.coefficients(train)
        return logistic.gradient(apply(train).select("vec", "y"), beta[None, :], self.spec.features)

    def relabel_sweep(self, train: DataFrame, moves: DataFrame, test: DataFrame, grid: list[float], series: list[tuple[str, int]]) -> DataFrame:
        """(method, seed, g, accuracy, dp_gap) of the model at every grid point of every ranking, if repairs change
        labels only.  ``moves``: method, seed, row_id, _point (first grid index that repairs the row) and y_after."""
        spark = train.sparkSession
        points = len(grid)
        apply, _ = self.space(train)
        first = {s: f"_b{i}" for i, s in enumerate(series)}
        when = moves.groupBy("row_id").agg(
            F.max("y_after").cast("int").alias("_after"),
            *[F.max(F.when((F.col("method") == m) & (F.col("seed") == s), F.col("_point"))).cast("int").alias(c) for (m, s), c in first.items()],
        )
        bs = list(first.values())
        never = [F.coalesce(c, F.lit(points)).alias(c) for c in bs]
        y = F.col("y").cast("int")
        rows = stable(apply(train).join(when, "row_id", "left").select("vec", y.alias("y"), F.coalesce("_after", y).alias("_after"), *never))

        def labels(batch: pa.RecordBatch) -> np.ndarray:
            now, after = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)[:, None] for c in ("y", "_after"))
            repaired = [batch.column(c).to_numpy(zero_copy_only=False)[:, None] <= np.arange(points) for c in bs]
            return np.concatenate([np.where(r, after, now) for r in repaired], axis=1)

        kinds = rows.select(*[
            F.sum(F.when(F.col(c) <= g, F.col("_after")).otherwise(F.col("y"))).alias(f"{c}_{g}") for c in bs for g in range(points)
        ], F.count(F.lit(1)).alias("n")).first()
        ok = np.array([0 < (kinds[f"{c}_{g}"] or 0) < kinds["n"] for c in bs for g in range(points)])
        beta = logistic.fit(rows, len(self.spec.features), len(ok), labels, max_iter=self.max_iter)

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
                called = (x @ beta[:, 1:].T + beta[:, 0]) > 0
                y, p = batch.column("y").to_pylist(), batch.column("protected").to_pylist()
                kinds = list(zip(y, p))
                for k in set(kinds):
                    mine = np.array([q == k for q in kinds])
                    n = called.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(n, dtype=np.int32)), pa.array([k[0]] * n, pa.int32()), pa.array([k[1]] * n, pa.bool_()),
                         pa.array(np.full(n, float(mine.sum()))), pa.array(called[mine].sum(axis=0).astype(np.float64))],
                        ["gid", "y", "protected", "n", "hits"],
                    )

        counts = apply(test).select("vec", y.alias("y"), "protected").mapInArrow(hits, "gid int, y int, protected boolean, n double, hits double")
        table = spark.createDataFrame(
            [(i * points + g, m, s, g, bool(ok[i * points + g])) for i, (m, s) in enumerate(series) for g in range(points)],
            "gid int, method string, seed int, g int, ok boolean",
        )
        return F.broadcast(table).join(point_metrics(counts), "gid").select(
            "method", "seed", "g", F.when(F.col("ok"), F.col("accuracy")).alias("accuracy"), F.when(F.col("ok"), F.col("dp_gap")).alias("dp_gap")
        )


def logistic_model(spec: Spec, classifier=None, max_iter: int = 1000) -> MLModel:
    """Numbers: median, power transform, standardise.  Categories: mode.
    Then logistic regression with an L2 penalty of 1/n, or the MLlib stage ``classifier``."""

    def stages(train: DataFrame) -> list:
        num, cat = list(spec.num), list(spec.cat)
        out = [MedianImputer(num), YeoJohnson(num), Standardizer(num)]
        if cat:
            out.append(ModeImputer(cat))
        out.append(VectorAssembler(inputCols=num + cat, outputCol="features", handleInvalid="keep"))
        return [*out, classifier]

    return MLModel("logistic", spec, stages) if classifier is not None else LogisticModel(spec, stages, max_iter=max_iter)


def forest_model(spec: Spec, n_components: int = 8, k_best: int = 5, n_trees: int = 100,
                 max_depth: int = 30) -> MLModel:
    """Median, standardise, principal components, best by ANOVA F, forest.

    ``max_depth``: 30 is the most that Spark's trees take."""

    def stages(train: DataFrame) -> list:
        cols = list(spec.features)
        k = min(n_components, len(cols))
        selector = UnivariateFeatureSelector(
            featuresCol="components", outputCol="features", labelCol="y", selectionMode="numTopFeatures"
        )
        selector.setFeatureType("continuous").setLabelType("categorical")
        selector.setSelectionThreshold(min(k_best, k))
        return [
            MedianImputer(cols),
            Standardizer(cols),
            VectorAssembler(inputCols=cols, outputCol="scaled"),
            PCA(k=k, inputCol="scaled", outputCol="components"),
            selector,
            RandomForestClassifier(
                featuresCol="features", labelCol="y", numTrees=n_trees, maxDepth=max_depth,
                featureSubsetStrategy="sqrt", seed=42,
                # each row's node is kept, so no pass sends it down all trees again; the trees are the same
                cacheNodeIds=True,
            ),
        ]

    return MLModel("forest", spec, stages)
