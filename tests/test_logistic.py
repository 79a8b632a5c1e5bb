"""Logistic fits of many labels together, and the power transform's search."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowmend.core import Spec
from rowmend.models import logistic
from rowmend.models.mllib import logistic_model
from rowmend.models.preprocess import fit_yeo_johnson
from rowmend.operators.metrics import evaluate_guarded
from rowmend.plans.experiments import NOISE_TYPES, cleaning_curve, rank_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(400, 3) * [1, 5, 0.2] + [0, 3, -1]
    y = (x @ [1, -0.3, 4] + rng.randn(400) * 2 > -4).astype(int)
    return x, y, spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(400)], "row_id long, vec array<double>, y int").repartition(3)


def loss(beta, x, y):
    eta = beta[0] + x @ beta[1:]
    return (np.logaddexp(0, eta) - y * eta).sum() + 0.5 * (beta[1:] ** 2).sum()


def test_single_fit(rows):
    x, y, df = rows
    beta = logistic.fit(df, 3)[0]
    for j in range(4):
        step = np.eye(4)[j] * 1e-5
        assert abs(loss(beta + step, x, y) - loss(beta - step, x, y)) / 2e-5 < 1e-4
    slopes = logistic.gradient(df, beta[None, :], ["a", "b", "c"]).collect()
    assert {r.name for r in slopes} == {"(intercept)", "a", "b", "c"} and max(abs(r.slope) for r in slopes) < 1e-6
    # finite differences of the gradient's own loss, away from the optimum
    far = beta + 0.3
    want = [(loss(far + np.eye(4)[j] * 1e-6, x, y) - loss(far - np.eye(4)[j] * 1e-6, x, y)) / 2e-6 for j in range(4)]
    got = {r.name: r.slope for r in logistic.gradient(df, far[None, :], ["a", "b", "c"]).collect()}
    assert np.allclose([got[n] for n in ("(intercept)", "a", "b", "c")], want, rtol=1e-5)
    ml = LogisticRegression(featuresCol="f", labelCol="y", maxIter=1000, regParam=1 / 400, standardization=False, tol=1e-12)
    other = ml.fit(df.withColumn("f", array_to_vector("vec")))
    assert np.allclose([other.intercept, *other.coefficients], beta, atol=1e-4)


def test_many_labels_at_once(rows, monkeypatch):
    x, y, df = rows
    monkeypatch.setattr(logistic, "BATCH", 50)

    def labels(batch):
        own, ids = (batch.column(c).to_numpy().astype(np.int64) for c in ("y", "row_id"))
        return np.stack([np.where(ids < cut, 1 - own, own) for cut in (0, 100, 400)] + [np.ones(len(ids))], axis=1).astype(float)

    together = logistic.fit(df, 3, 4, labels)
    for k, cut in enumerate((0, 100, 400)):
        alone = logistic.fit(df.withColumn("y", F.when(F.col("row_id") < cut, 1 - F.col("y")).otherwise(F.col("y"))), 3)[0]
        assert np.allclose(together[k], alone, atol=1e-8)
    assert np.isfinite(together).all() and together[3, 0] > 5  # one label only


def test_separable_labels(spark):
    df = spark.createDataFrame([([float(i)], int(i > 50)) for i in range(100)], "vec array<double>, y int")
    beta = logistic.fit(df, 1)[0]
    assert np.isfinite(beta).all() and abs(-beta[0] / beta[1] - 50.5) < 0.5
    assert max(abs(r.slope) for r in logistic.gradient(df, beta[None, :], ["x"]).collect()) < 1e-6


def test_sweep_equals_single_fits(spark):
    rng = np.random.RandomState(2)
    rows = []
    for i in range(300):
        a, b = rng.randn(), rng.rand()
        clean = int(a + b + rng.randn() * 0.5 > 0.5)
        noisy = i < 200 and i % 5 == 0
        rows.append((i, 1 - clean if noisy else clean, clean, i % 3 == 0, noisy, None if i % 17 == 0 else a, b))
    df = spark.createDataFrame(rows, "row_id long, y int, y_clean int, protected boolean, is_noisy boolean, a double, b double")
    train, test = df.where("row_id < 200"), df.where("row_id >= 200")
    spec, how = Spec(("a", "b")), NOISE_TYPES["random_label"]
    model = logistic_model(spec)
    methods = ("fair_heuristic", "random")
    ranked = rank_rows(model, train, train, methods)
    how = type(how)("restore", (0.0, 0.3, 1.0), 1.0, methods)
    got = {(r.method, r.seed, round(r.proportion, 2)): r for r in cleaning_curve(model, train, test, ranked, spec, how, None).collect()}
    assert len(got) == 12
    ranks = ranked.collect()
    for (method, seed, p), r in got.items():
        chosen = [q.row_id for q in ranks if (q.method, q.seed) == (method, seed) and q.rank <= r.n_cleaned]
        one = train.withColumn("y", F.when(F.col("row_id").isin(chosen), F.col("y_clean")).otherwise(F.col("y")))
        want = evaluate_guarded(model, one, test)
        assert r.accuracy == pytest.approx(want["accuracy"]) and r.dp_gap == pytest.approx(want["dp_gap"])


def test_powers_outside_the_first_bracket(spark):
    rng = np.random.RandomState(3)
    base = rng.randn(3000) * 0.01
    data = {"low": (1 + base * 9) ** (-1 / 9.0) - 1 + 0.0, "usual": np.exp(base * 30) - 1, "flat": np.full(3000, 4.0)}
    df = spark.createDataFrame([(float(data["low"][i]), float(data["usual"][i]), 4.0 if i % 2 else None) for i in range(3000)], "low double, usual double, flat double")
    lam = fit_yeo_johnson(df.repartition(5), ["low", "usual", "flat"])
    assert lam["flat"] == 1.0 and lam["low"] < -5.5

    def like(x, at):
        z = np.where(x >= 0, ((1 + np.abs(x)) ** at - 1) / at, -((1 + np.abs(x)) ** (2 - at) - 1) / (2 - at))
        return -len(x) / 2 * np.log(z.var()) + (at - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for c in ("low", "usual"):
        assert like(data[c], lam[c]) >= max(like(data[c], lam[c] + d) for d in (-0.01, 0.01))
