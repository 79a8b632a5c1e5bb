"""One pass over the distances for all utilities, and what a task holds of the training rows."""

import numpy as np
import pytest

from rowmend.core import Spec
from rowmend.models.naive_bayes import NaiveBayes
from rowmend.operators import shapley
from rowmend.plans import experiments

from .conftest import frame


def rows_of(n, seed, digits=1):
    rng = np.random.RandomState(seed)
    x = np.round(rng.randn(n, 3), digits)
    return [(i, int(rng.rand() < 0.4), bool(rng.rand() < 0.5), i % 2, *map(float, x[i])) for i in range(n)]


SCHEMA = "row_id bigint, y int, protected boolean, pred int, a double, b double, c double"


@pytest.mark.parametrize("steps", [None, 128])
@pytest.mark.parametrize("splits", [32_000_000, 300])
def test_utilities_of_one_pass(spark, monkeypatch, steps, splits):
    monkeypatch.setattr(shapley, "SPLIT_VALUES", splits)
    train = frame(spark, rows_of(90, 1), SCHEMA)
    val = frame(spark, rows_of(30, 2), SCHEMA)
    cols = ["a", "b", "c"]
    both = shapley.knn_shapley_of(train, val, cols, {"plain": "accuracy", "fair": "parity"}, k=2, steps=steps).toPandas().set_index("row_id")
    for name, utility in (("plain", "accuracy"), ("fair", "parity")):
        one = shapley.knn_shapley(train, val, cols, utility, k=2, steps=steps).toPandas().set_index("row_id")["score"]
        assert one.abs().max() > 0 and (both[name] - one).abs().max() < 1e-12


def test_both_rankings_take_the_distances_once(spark, monkeypatch):
    passes = []
    real = shapley._in_one
    monkeypatch.setattr(shapley, "_in_one", lambda *a: passes.append(a) or real(*a))
    train = frame(spark, rows_of(60, 3), SCHEMA).selectExpr("*", "row_id % 3 = 0 AS is_noisy")
    val = frame(spark, [(i + 1000, *rest) for i, *rest in rows_of(20, 4)], SCHEMA).drop("pred")
    ranked = experiments.rank_rows(NaiveBayes(Spec(("a", "b", "c"))), train, val, ("shapley", "fair_shapley"))
    assert {r["method"]: r["count"] for r in ranked.groupBy("method").count().collect()} == {"shapley": 20, "fair_shapley": 20}
    assert len(passes) == 1


def test_rows_that_come_twice_keep_their_own_passes(spark):
    """The predictions of two validation rows of one id meet both of them; plain values count each row once."""
    train = frame(spark, rows_of(40, 5), SCHEMA).selectExpr("*", "TRUE AS is_noisy")
    val = frame(spark, rows_of(12, 6) + rows_of(12, 6)[:3], SCHEMA).drop("pred")
    model = NaiveBayes(Spec(("a", "b", "c")))
    ranked = experiments.rank_rows(model, train, val, ("shapley", "fair_shapley"))
    apply, cols = model.space(train)
    want = shapley.rank_by_shapley(shapley.knn_shapley(apply(train), apply(val), cols))
    got = {r["row_id"]: r["rank"] for r in ranked.where("method = 'shapley'").collect()}
    assert got == {r["row_id"]: r["rank"] for r in want.collect()}


@pytest.mark.parametrize("steps", [None, 128])
def test_features_in_a_file(spark, monkeypatch, steps):
    """Features beyond what a task holds are read from its file, piece by piece."""
    train, val = frame(spark, rows_of(200, 7, 3), SCHEMA), frame(spark, rows_of(40, 8, 3), SCHEMA)
    cols = ["a", "b", "c"]
    held = shapley.knn_shapley(train, val, cols, steps=steps).toPandas().set_index("row_id")["score"]
    for name, value in (("HELD_VALUES", 90), ("PIECE_VALUES", 30), ("TILE", 7), ("DISTANCES", 500)):
        monkeypatch.setattr(shapley, name, value)
    filed = shapley.knn_shapley(train, val, cols, steps=steps).toPandas().set_index("row_id")["score"]
    assert held.abs().max() > 0 and (held - filed).abs().max() < 1e-13


def test_strict_order_with_few_and_with_many_ties():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, labels, k = int(rng.integers(1, 60)), int(rng.integers(2, 5)), int(rng.integers(1, 6))
        x, y = np.round(rng.normal(size=(n, 2)), trial % 4), rng.integers(0, labels, n)
        rows = shapley._Rows(labels, 2)
        rows.add(np.arange(n), np.ones(n, np.int64), x, y)
        tops = [(i, x[i % n], rng.normal(size=(2, labels)), None, None) for i in range(4)]
        got = shapley._gains(rows.ready(), tops, k, shapley.FINE_STEPS, 2)
        want = np.zeros((2, n))
        for (_, _, us, _, _), d2 in rows.each(tops):
            _, counts, _, at = rows.cells(d2, shapley.FINE_STEPS, None)
            for total, u in zip(want, us):
                total += shapley._values(counts, u, k).ravel()[at * labels + y]
        assert np.abs(got - want).max() < 1e-12


def test_arrow_takes_little_at_once():
    """10,000 chunks, which Arrow sends together, stay under 50 MB; a block is no smaller for many validation rows."""
    assert 10_000 * shapley.CHUNK_VALUES * 8 < 50e6 and shapley.BLOCK_ROWS > 20_000
