"""Categorical Naive Bayes by counts.

The model is a table of counts, so it can be fitted, cross-fitted and updated
with aggregates alone: an out-of-fold model is the total minus one fold, and
the model after a repair is the total plus the repaired rows minus the
originals.  One pass therefore gives all folds, or all points of a cleaning
curve.

Numbers are binned in half-deviation steps around the mean; bin edges come
from the uncleaned training rows and stay fixed while rows are repaired.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Spec, broadcastable, stable
from ..functions import z_bin
from ..operators.encode import category_codes, with_codes
from ..operators.sampling import stratified_folds
from .preprocess import MedianImputer, Standardizer

MISSING = "?"  # category of a missing value

# the task functions below travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Binner:
    """Maps the features of a frame to small strings."""

    spec: Spec
    mean: dict[str, float | None]
    sd: dict[str, float | None]

    @staticmethod
    def fit(train: DataFrame, spec: Spec) -> "Binner":
        aggs = [F.avg(c).alias(f"m_{c}") for c in spec.num]
        aggs += [F.stddev_pop(c).alias(f"s_{c}") for c in spec.num]
        row = train.agg(*aggs).first() if aggs else {}
        return Binner(
            spec,
            {c: row[f"m_{c}"] for c in spec.num},
            {c: row[f"s_{c}"] for c in spec.num},
        )

    def value(self, col: str, x: Column | None = None) -> Column:
        x = F.col(col) if x is None else x
        if col in self.spec.num:
            return z_bin(x, self.mean[col], self.sd[col]).cast("string")
        return F.coalesce(x.cast("string"), F.lit(MISSING))

    def columns(self) -> list[Column]:
        return [self.value(c).alias(f"b{i}") for i, c in enumerate(self.spec.features)]

    @property
    def names(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.spec.features))]


def long_counts(binned: DataFrame, names: list[str], by: list[str], y: str = "y",
                weight: str | None = None) -> DataFrame:
    """(by..., f, v, c0, c1): rows per feature value and label."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("v")) for i, n in enumerate(names)])
    )
    w = F.lit(1) if weight is None else F.col(weight)
    return (
        binned.select(*by, F.col(y).alias("_y"), w.alias("_w"), pairs.alias("e"))
        .groupBy(*by, "e.f", "e.v")
        .agg(
            F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0)).alias("c0"),
            F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)).alias("c1"),
        )
    )


def log_odds(c0, c1, n0, n1, n_values) -> Column:
    """Evidence for label 1 of one feature value, add-one smoothed."""
    return F.log((c1 + 1.0) / (n1 + n_values)) - F.log((c0 + 1.0) / (n0 + n_values))


def prior_log_odds(n0, n1) -> Column:
    return F.log((n1 + 1.0) / (n0 + 1.0))


def _domain_sizes(counts: DataFrame) -> dict[int, int]:
    rows = counts.groupBy("f").agg(F.count_distinct("v").alias("n")).collect()
    return {r["f"]: r["n"] for r in rows}


def _by_feature(sizes: dict[int, int]) -> Column:
    out = F.lit(1.0)
    for f, n in sizes.items():
        out = F.when(F.col("f") == f, float(n)).otherwise(out)
    return out


def _look_up(rows: DataFrame, table: DataFrame, i: int, name: str, keys: list[str],
             values: list[str], small: set) -> DataFrame:
    """Left join the entries of feature ``i``; map-side while they are few."""
    part = table.where(F.col("f") == i).select(
        *keys, F.col("v").alias(name), *[F.col(x).alias(f"_{x}{i}") for x in values]
    )
    return rows.join(F.broadcast(part) if i in small else part, [*keys, name], "left")


def _score(rows: DataFrame, model: DataFrame, names: list[str], keys: list[str],
           defaults: dict[int, Column]) -> DataFrame:
    """Add ``lo``: sum of the log-odds of a row's feature values."""
    small = broadcastable(model, "f", "v")
    total = F.lit(0.0)
    for i, n in enumerate(names):
        rows = _look_up(rows, model, i, n, keys, ["lo"], small)
        total = total + F.coalesce(F.col(f"_lo{i}"), defaults[i])
    return rows.withColumn("lo", total).drop(*[f"_lo{i}" for i in range(len(names))])


class NaiveBayes:
    """Scorer with the interface of every model here: ``predict``, ``oof``,
    ``space`` and, as an extra, a one-pass ``sweep``."""

    name = "nb"

    def __init__(self, spec: Spec, n_folds: int = 5):
        self.spec = spec
        self.n_folds = n_folds

    # -- feature space of the Shapley distances
    def space(self, train: DataFrame):
        """Function that maps a frame to imputed, standardised numbers and to the
        codes of its categories: first appearance in ``train``, -1 if missing or
        not in there."""
        num, cat = list(self.spec.num), list(self.spec.cat)
        stages = []
        if num:
            stages.append(MedianImputer(num).fit(train))
            stages.append(Standardizer(num).fit(stages[0].transform(train)))
        codes = stable(category_codes(train, cat)) if cat else None

        def apply(df: DataFrame) -> DataFrame:
            for stage in stages:
                df = stage.transform(df)
            return with_codes(df, codes, {c: i for i, c in enumerate(cat)}) if cat else df

        return apply, num + cat

    def predict(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p1`` and ``pred`` of a model fitted on ``train``."""
        binner = Binner.fit(train, self.spec)
        return self._predict(binner, train, rows)

    def _predict(self, binner: Binner, train: DataFrame, rows: DataFrame) -> DataFrame:
        names = binner.names
        counts = stable(long_counts(train.select("y", *binner.columns()), names, []))
        sizes = _domain_sizes(counts)
        n = train.agg(
            F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")
        ).first()
        n0, n1 = F.lit(float(n["n0"] or 0)), F.lit(float(n["n1"] or 0))
        model = counts.withColumn(
            "lo", log_odds(F.col("c0"), F.col("c1"), n0, n1, _by_feature(sizes))
        )
        defaults = {
            i: log_odds(F.lit(0.0), F.lit(0.0), n0, n1, F.lit(float(sizes.get(i, 1))))
            for i in range(len(names))
        }
        scored = _score(rows.select("*", *binner.columns()), model, names, [], defaults)
        return _with_prediction(scored, prior_log_odds(n0, n1)).drop(*names)

    def oof(self, train: DataFrame, seed: int = 0) -> DataFrame:
        """(row_id, y, p1): out-of-fold probability of label 1."""
        binner = Binner.fit(train, self.spec)
        names = binner.names
        folded = stratified_folds(train.select("row_id", "y", *binner.columns()), self.n_folds, seed)
        folded = stable(folded)
        own = stable(long_counts(folded, names, ["fold"]))
        total = own.groupBy("f", "v").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
        sizes = _domain_sizes(own)
        per_fold = {
            r["fold"]: (r["n0"], r["n1"])
            for r in folded.groupBy("fold")
            .agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))
            .collect()
        }
        all0 = sum(v[0] for v in per_fold.values())
        all1 = sum(v[1] for v in per_fold.values())

        def outside(which: int) -> Column:
            out = F.lit(0.0)
            for fold, n in per_fold.items():
                rest = (all0, all1)[which] - n[which]
                out = F.when(F.col("fold") == fold, float(rest)).otherwise(out)
            return out

        model = (
            total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(self.n_folds - 1))))
            .join(own, ["fold", "f", "v"], "left")
            .select(
                "fold", "f", "v",
                log_odds(
                    F.col("t0") - F.coalesce("c0", F.lit(0)),
                    F.col("t1") - F.coalesce("c1", F.lit(0)),
                    outside(0), outside(1), _by_feature(sizes),
                ).alias("lo"),
            )
        )
        model = stable(model)
        defaults = {i: F.lit(0.0) for i in range(len(names))}
        scored = _score(folded, model, names, ["fold"], defaults)
        out = _with_prediction(scored, prior_log_odds(outside(0), outside(1)))
        return out.select("row_id", "y", "fold", "p1")

    def sweep(
        self, train: DataFrame, moves: DataFrame, test: DataFrame, grid: list[float],
        series: list[tuple[str, int]],
    ) -> DataFrame:
        """Metrics of the model at every grid point of every ranking.

        ``moves`` has one row per ranked training row: ``method``, ``seed``,
        ``_point`` (first grid index that includes the row), the row's features and
        label, the same suffixed ``_after`` behind the repair, and
        ``keep_after``.  ``series`` lists the (method, seed) pairs.  Returns
        (method, seed, g, accuracy, dp_gap); the metrics are NULL where the
        repaired rows are empty or of one label.
        """
        spark = train.sparkSession
        keys = ["method", "seed"]
        binner = Binner.fit(train, self.spec)
        names = binner.names
        points = len(grid)
        base = stable(long_counts(train.select("y", *binner.columns()), names, []))
        first = base.where("f = 0").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")).first()

        # every move takes the row out as it was and puts it back repaired
        after = [
            binner.value(c, F.col(f"{c}_after")).alias(n) for c, n in zip(self.spec.features, names)
        ]
        both = F.array(
            F.struct(F.lit(-1).alias("w"), F.col("y").cast("int").alias("y"), *binner.columns()),
            F.struct(
                F.col("keep_after").cast("int").alias("w"), F.col("y_after").cast("int").alias("y"), *after
            ),
        )
        # net change per grid point and distinct row content
        delta = (
            moves.where(F.col("_point") < points)
            .select(*keys, F.col("_point").alias("b"), F.inline(both))
            .groupBy(*keys, "b", "y", *names)
            .agg(F.sum("w").alias("w"))
        )
        delta = stable(delta.where("w <> 0"))

        # label totals at every grid point: |series| x |grid| numbers
        change = {(m, s, i): (0, 0) for m, s in series for i in range(points)}
        for r in (
            delta.groupBy(*keys, "b")
            .agg(
                F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("d0"),
                F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("d1"),
            )
            .collect()
        ):
            change[(r["method"], r["seed"], r["b"])] = (r["d0"], r["d1"])
        n0s, n1s = np.zeros(len(series) * points), np.zeros(len(series) * points)
        for i, (method, seed) in enumerate(series):
            steps = np.array([change[(method, seed, g)] for g in range(points)], np.int64).reshape(-1, 2)
            sums = np.cumsum(steps, axis=0) + [first["n0"] or 0, first["n1"] or 0]
            n0s[i * points : (i + 1) * points], n1s[i * points : (i + 1) * points] = sums[:, 0], sums[:, 1]

        moved = long_counts(delta, names, [*keys, "b"], weight="w").withColumnsRenamed({"c0": "d0", "c1": "d1"})
        place = spark.createDataFrame([(m, s, i) for i, (m, s) in enumerate(series)], "method string, seed int, i int")
        changes = moved.join(F.broadcast(place), keys).select((F.col("i") * points + F.col("b")).alias("gid"), "f", "v", "d0", "d1")
        scored = point_counts(binner, test, n0s, n1s, changes, points, base)
        table = spark.createDataFrame(
            [(i * points + g, m, s, g, bool(n0s[i * points + g] > 0 and n1s[i * points + g] > 0))
             for i, (m, s) in enumerate(series) for g in range(points)],
            "gid int, method string, seed int, g int, ok boolean",
        )
        return F.broadcast(table).join(point_metrics(scored), "gid").select(
            *keys, "g", F.when(F.col("ok"), F.col("accuracy")).alias("accuracy"), F.when(F.col("ok"), F.col("dp_gap")).alias("dp_gap")
        )


def _point_models(changes: DataFrame, base: DataFrame | None, n0: np.ndarray, n1: np.ndarray, run: int, domain: dict[int, int]) -> DataFrame:
    """(f, v, lo): the evidence of each feature value in all models, one array."""
    entries = changes.groupBy("f", "v").agg(F.collect_list(F.struct("gid", "d0", "d1")).alias("e"))
    if base is None:
        rows = entries.select("f", "v", F.lit(0).cast("long").alias("c0"), F.lit(0).cast("long").alias("c1"), "e")
    else:
        whole = base.select(F.col("f"), F.col("v"), F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        rows = whole.join(entries, ["f", "v"], "full").select("f", "v", zero("c0"), zero("c1"), "e")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = batch.column("f")[i].as_py()
                counts = np.zeros((2, len(n0)))
                e = batch.column("e")[i].values
                if e is not None and len(e):
                    gid = e.field("gid").to_numpy(zero_copy_only=False)
                    for k, d in enumerate(("d0", "d1")):
                        np.add.at(counts[k], gid, e.field(d).to_numpy(zero_copy_only=False))
                    counts = np.cumsum(counts.reshape(2, -1, run), axis=2).reshape(2, -1)
                c0, c1 = (counts[k] + batch.column(f"c{k}")[i].as_py() for k in (0, 1))
                lo = np.log((c1 + 1.0) / (n1 + domain[f])) - np.log((c0 + 1.0) / (n0 + domain[f]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("f").slice(i, 1), batch.column("v").slice(i, 1), pa.array([lo], pa.list_(pa.float64()))], ["f", "v", "lo"]
                )

    return rows.mapInArrow(make, "f int, v string, lo array<double>")


def point_counts(binner: Binner, rows: DataFrame, n0: np.ndarray, n1: np.ndarray, changes: DataFrame, run: int,
                 base: DataFrame | None = None) -> DataFrame:
    """(gid, y, protected, n, hits): rows of each kind, and how many of them model ``gid`` calls 1.

    ``n0`` and ``n1`` are the label totals of the models; ``changes`` (gid, f, v, d0, d1) are feature
    counts that hold for a model and those after it in its run of ``run`` models, on top of the
    counts ``base`` (f, v, c0, c1) that all share.  Rows with equal bins are scored once, for all
    models together: a feature value brings one array, and arrays are added."""
    names = binner.names
    known = changes.select("f", "v") if base is None else base.select("f", "v").unionByName(changes.select("f", "v"))
    domain = _domain_sizes(known)
    models = stable(_point_models(changes, base, n0, n1, run, domain))
    small = broadcastable(models, "f", "v", 8 * len(n0))
    cells = rows.select("y", "protected", *binner.columns()).groupBy("y", "protected", *names).agg(F.count(F.lit(1)).alias("w"))
    for i, n in enumerate(names):
        cells = _look_up(cells, models, i, n, [], ["lo"], small)
    missing = [np.log(1.0 / (n1 + d)) - np.log(1.0 / (n0 + d)) for d in (float(domain.get(i, 1)) for i in range(len(names)))]
    prior = np.log((n1 + 1.0) / (n0 + 1.0))
    kinds = [(y, p) for y in (0, 1) for p in (False, True, None)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hits = np.zeros(len(kinds)), np.zeros((len(kinds), len(n0)))
        for batch in batches:
            lo = np.zeros((batch.num_rows, len(n0)))
            for i in range(len(names)):
                arrays = batch.column(f"_lo{i}")
                found = arrays.is_valid().to_numpy(zero_copy_only=False)
                lo[found] += arrays.flatten().to_numpy().reshape(-1, len(n0))
                lo[~found] += missing[i]
            # evidence is compared at nine decimals
            called = lo + prior >= 5e-10
            y, p, w = (batch.column(c) for c in ("y", "protected", "w"))
            w = w.to_numpy().astype(np.float64)
            of = np.array([kinds.index(k) for k in zip(y.to_pylist(), p.to_pylist())], np.int64)
            for k in np.unique(of):
                total[k] += w[of == k].sum()
                hits[k] += w[of == k] @ called[of == k]
        for k in np.flatnonzero(total):
            columns = [np.arange(len(n0), dtype=np.int32), np.full(len(n0), kinds[k][0], np.int32)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array([kinds[k][1]] * len(n0), pa.bool_()), pa.array(np.full(len(n0), total[k])), pa.array(hits[k])],
                ["gid", "y", "protected", "n", "hits"],
            )

    packed = cells.select(F.col("y").cast("int").alias("y"), "protected", "w", *[f"_lo{i}" for i in range(len(names))])
    return packed.mapInArrow(score, "gid int, y int, protected boolean, n double, hits double")


def point_metrics(counts: DataFrame) -> DataFrame:
    """(gid, accuracy, dp_gap) from ``point_counts``."""
    right = F.sum(F.when(F.col("y") == 1, F.col("hits")).otherwise(F.col("n") - F.col("hits")))

    def rate(group: Column) -> Column:
        rows = F.sum(F.when(group, F.col("n")).otherwise(0.0))
        return F.when(rows > 0, F.sum(F.when(group, F.col("hits")).otherwise(0.0)) / rows)

    gap = F.coalesce(F.abs(rate(F.col("protected")) - rate(~F.col("protected"))), F.lit(0.0))
    return counts.groupBy("gid").agg((right / F.sum("n")).alias("accuracy"), gap.alias("dp_gap"))


def _with_prediction(scored: DataFrame, prior: Column) -> DataFrame:
    """p1 and the hard label; evidence is compared at nine decimals."""
    total = F.col("lo") + prior
    return scored.withColumn("p1", 1.0 / (1.0 + F.exp(-total))).withColumn(
        "pred", (F.round(total, 9) > 0).cast("int")
    )
