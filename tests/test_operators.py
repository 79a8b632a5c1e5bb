import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowmend.core import Spec, nan_to_null, stable
from rowmend.models.mllib import logistic_model
from rowmend.models.naive_bayes import NaiveBayes
from rowmend.models.preprocess import MedianImputer, Standardizer, fit_yeo_johnson
from rowmend.operators import confident, encode, fairness, metrics, noise, repair, shapley
from rowmend.plans import groups

from .conftest import frame


# ------------------------------------------------------------------ metrics


@pytest.mark.parametrize(
    "pred, prot, want",
    [
        ([1, 1, 0, 1, 0], [True, True, True, False, False], abs(2 / 3 - 1 / 2)),
        ([1, 0, 1, 0], [True, True, False, False], 0.0),
        ([1, 0, 1], [True, True, True], 0.0),
        ([1, 0, 1], [False, False, False], 0.0),
    ],
)
def test_parity_gap(spark, pred, prot, want):
    df = frame(spark, list(zip(pred, prot)), "pred int, protected boolean")
    got = df.agg(metrics.demographic_parity_gap().alias("g")).first()["g"]
    assert abs(got - want) < 1e-12


def test_parity_impact_scores(spark):
    rows = [(0, 0, True), (1, 0, True), (2, 1, True), (3, 1, False), (4, 1, False)]
    df = frame(spark, rows, "row_id bigint, y int, protected boolean")
    got = {r["row_id"]: r["score"] for r in fairness.parity_impact_scores(df).collect()}
    assert got[0] == pytest.approx(1 / 6) and got[2] == pytest.approx(-1 / 3) and got[3] == pytest.approx(0)
    order = [r["row_id"] for r in fairness.rank_by_parity_impact(df, df.where("row_id in (0, 2, 3)")).orderBy("rank").collect()]
    assert order == [0, 3, 2]


# ------------------------------------------------------------------- noise


def test_outlier_injection(spark):
    """Cap and share by hand on a table of known moments; a NULL neither counts nor becomes a number by itself."""
    data = [(i, i % 2, i % 3 == 0, None if i == 0 else float(i % 10), -float(i)) for i in range(121)]
    df = frame(spark, data, "row_id bigint, y int, protected boolean, price double, other double")
    out, cap = noise.inject_outlier(df, "price", 0.25, seed=3)
    got = out.toPandas().set_index("row_id").sort_index()
    sd = 8.25**0.5  # of 0..9, twelve times each
    assert abs(cap - (4.5 + 2 * sd)) < 1e-9 and got.is_noisy.sum() == 30
    k = (got.price[got.is_noisy] - 4.5) / sd
    assert k.between(3 - 1e-9, 5 + 1e-9).all() and k.nunique() > 20
    clean = pd.Series([r[3] for r in data], dtype="float64")
    assert got.price[~got.is_noisy].equals(clean[~got.is_noisy.to_numpy()].rename("price").rename_axis("row_id"))
    assert (got.other == [r[4] for r in data]).all()
    parts = noise.inject_outlier(df.repartition(5), "price", 0.25, seed=3)[0].where("is_noisy")
    assert {r.row_id for r in parts.select("row_id").collect()} == set(got.index[got.is_noisy])


def test_constant_column_degenerates_to_the_mean(spark):
    df = frame(spark, [(i, 0, False, 3.0) for i in range(20)], "row_id bigint, y int, protected boolean, x double")
    out, cap = noise.inject_outlier(df, "x", 0.5)
    assert cap == 3.0 and {r["x"] for r in out.collect()} == {3.0}


def test_group_noise_touches_only_the_group(spark):
    df = frame(
        spark, [(i, i % 2, i % 3 == 0, float(i)) for i in range(300)], "row_id bigint, y int, protected boolean, x double"
    )
    flipped = noise.inject_group_label(df, 0.2).toPandas()
    assert flipped["is_noisy"].sum() == 20 and flipped[flipped["is_noisy"]]["protected"].all()
    assert (flipped["y"] != flipped["y_clean"]).sum() == 20
    blank = noise.inject_group_missing(df, ["x"], 0.2).toPandas()
    assert blank["x"].isna().sum() == 20 and blank["x_clean"].notna().all()
    assert noise.inject_group_label(df, 0.001).where("is_noisy").count() == 0


def test_actions_on_an_empty_selection(spark):
    df = frame(spark, [(i, i % 2, float(i)) for i in range(10)], "row_id bigint, y_clean int, x double")
    df = df.withColumn("y", F.lit(1))
    none = F.lit(False)
    for act in (repair.action_cap("x", 1.0), repair.action_remove(), repair.action_flip(), repair.action_restore_labels()):
        assert sorted(act(df, none).select(*df.columns).collect()) == sorted(df.collect())


# ----------------------------------------------------------------- shapley


def brute_shapley(x, y, vx, vy, k):
    """Average marginal gain over all orders; utility = share of agreeing
    labels among the min(k, size) nearest, divided by k."""
    n = len(x)
    out = np.zeros(n)
    for v, label in zip(vx, vy):
        dist = np.abs(x - v)

        def utility(s):
            near = sorted(s, key=lambda i: (dist[i], i))[:k]
            return sum(y[i] == label for i in near) / k

        perms = list(permutations(range(n)))
        for p in perms:
            for j, i in enumerate(p):
                out[i] += (utility(p[: j + 1]) - utility(p[:j])) / len(perms)
    return out / len(vx)


@pytest.mark.parametrize("k", [1, 3])
def test_shapley_equals_all_orders(spark, k):
    rng = np.random.RandomState(4)
    x, y = rng.randn(6), np.array([0, 1, 1, 0, 1, 0])
    vx, vy = rng.randn(3), np.array([1, 0, 1])
    train = frame(spark, [(i, int(y[i]), float(x[i])) for i in range(6)], "row_id bigint, y int, x double")
    val = frame(spark, [(i, int(vy[i]), float(vx[i])) for i in range(3)], "row_id bigint, y int, x double")
    got = {r["row_id"]: r["score"] for r in shapley.knn_shapley(train, val, ["x"], k=k).collect()}
    want = brute_shapley(x, y, vx, vy, k)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(6))


def test_shapley_of_copies_is_the_mean_over_their_orders(spark):
    """A third of the rows are copies of one row, with both labels."""
    rng = np.random.RandomState(5)
    x = np.concatenate([np.full(4, 0.3), rng.randn(3)])
    y = np.array([0, 1, 1, 1, 0, 1, 0])
    v, label, k = 0.1, 1, 2
    want = np.zeros(7)
    tie_orders = list(permutations(range(4)))
    for order in tie_orders:
        pos = {i: j for j, i in enumerate(order)}
        ranked = sorted(range(7), key=lambda i: (abs(x[i] - v), pos.get(i, 0)))
        u = [float(y[i] == label) for i in ranked]
        s = u[-1] * min(k, 7) / (k * 7)
        want[ranked[-1]] += s
        for i in range(5, -1, -1):
            s += (u[i] - u[i + 1]) / k * min(k, i + 1) / (i + 1)
            want[ranked[i]] += s
    want /= len(tie_orders)
    train = frame(spark, [(i, int(y[i]), float(x[i])) for i in range(7)], "row_id bigint, y int, x double")
    val = frame(spark, [(0, label, v)], "row_id bigint, y int, x double")
    for steps in (None, shapley.COARSE_STEPS):
        got = {r["row_id"]: r["score"] for r in shapley.knn_shapley(train, val, ["x"], k=k, steps=steps).collect()}
        if steps is None:
            assert all(abs(got[i] - want[i]) < 1e-12 for i in range(7))
        assert got[1] == got[2] == got[3] and sum(got.values()) == pytest.approx(sum(want))


def test_coarse_steps_stay_close_and_keep_the_total(spark):
    rng = np.random.RandomState(6)
    n = 3000
    x = rng.randn(n, 3)
    y = (x[:, 0] > 0).astype(int)
    cols = ["a", "b", "c"]
    train = frame(spark, [(i, int(y[i]), *map(float, x[i])) for i in range(n)], "row_id bigint, y int, a double, b double, c double")
    val = train.where("row_id < 40").withColumn("a", F.col("a") + 0.01)
    fine = shapley.knn_shapley(train, val, cols, steps=shapley.FINE_STEPS).toPandas().set_index("row_id")["score"]
    for parts in (1, 5):
        coarse = shapley.knn_shapley(train.repartition(parts), val, cols, steps=shapley.COARSE_STEPS)
        coarse = coarse.toPandas().set_index("row_id")["score"]
        assert abs(coarse.sum() - fine.sum()) < 1e-9
        assert (coarse - fine).abs().max() < 2e-3


def test_flipped_rows_score_below_the_rest(spark):
    """Labels taken away from one group only score low under the parity utility."""
    rows = []
    for i in range(400):
        merit, member = (i * 37 % 101) / 50 - 1, i * 7 % 5 < 2
        clean = int(merit > 0)
        lost = i < 300 and member and clean == 1 and i % 3 == 0
        rows.append((i, 0 if lost else clean, clean, member, lost, merit, float(member), (i * 53 % 97) / 97))
    df = frame(
        spark, rows, "row_id bigint, y int, y_clean int, protected boolean, is_noisy boolean, merit double, member double, other double"
    )
    train, val = df.where("row_id < 300"), df.where("row_id >= 300")
    model = logistic_model(Spec(("merit", "member", "other")), max_iter=20)
    apply, cols = model.space(train)
    pred = model.predict(train, val).select("row_id", "pred")
    values = stable(shapley.knn_shapley(apply(train), apply(val).join(pred, "row_id"), cols, "parity"))
    scores = values.join(train.select("row_id", "is_noisy"), "row_id").groupBy("is_noisy").agg({"score": "avg", "row_id": "count"}).toPandas()
    mean = scores.set_index("is_noisy")["avg(score)"]
    assert scores["count(row_id)"].sum() == 300 and mean[True] < mean[False]
    ranked = shapley.rank_by_shapley(values, train.where("is_noisy"))
    assert ranked.count() == train.where("is_noisy").count() == ranked.select("rank").distinct().count()


def test_space_of_categories_alone(spark):
    schema = "row_id bigint, y int, job string"
    train = frame(spark, [(0, 1, "b"), (1, 0, None), (2, 1, "a"), (3, 0, "b")], schema)
    apply, cols = NaiveBayes(Spec((), ("job",))).space(train)
    val = apply(frame(spark, [(7, 1, "a"), (8, 0, None), (9, 1, "new"), (10, 1, "b")], schema))
    assert cols == ["job"] and {r.row_id: r.job for r in val.collect()} == {7: 1.0, 8: -1.0, 9: -1.0, 10: 0.0}
    assert shapley.knn_shapley(apply(train), val, cols).count() == 4


def test_guarded_evaluation(spark):
    schema = "row_id bigint, y int, protected boolean, job string"
    rows = frame(spark, [(0, 1, True, "b"), (1, 0, False, "a"), (2, 1, False, "b")], schema)
    model = NaiveBayes(Spec((), ("job",)))
    assert metrics.evaluate_guarded(model, rows, rows) == {"accuracy": 1.0, "dp_gap": 0.5}
    for unfit in (rows.where("y = 1"), rows.limit(0)):
        assert metrics.evaluate_guarded(model, unfit, rows) == {"accuracy": None, "dp_gap": None}


def test_parity_utility_without_a_lead(spark):
    def gains(rows):
        out = shapley.with_utility(frame(spark, rows, "row_id bigint, protected boolean, pred double"), "parity")
        return [(r["u0"], r["u1"]) for r in out.orderBy("row_id").collect()]

    assert gains([(0, True, 1.0), (1, True, 0.0)]) == [(0, 0)] * 2
    assert gains([(0, True, 1.0), (1, True, 0.0), (2, False, 0.0), (3, False, 1.0)]) == [(0, 0)] * 4
    assert gains([(0, True, 1.0), (1, True, 1.0), (2, False, 0.0)]) == [(0, -0.5), (0, -0.5), (0, 1)]


def test_blocks_of_validation_rows_add_up(spark, monkeypatch):
    df = frame(spark, [(i, i % 2, float(i * i % 17)) for i in range(20)], "row_id bigint, y int, x double")
    for steps, splits in ((None, 100), (16, 100), (None, 6), (16, 6)):
        whole = shapley.knn_shapley(df, df, ["x"], k=2, steps=steps).toPandas().set_index("row_id")["score"]
        with monkeypatch.context() as m:
            m.setattr(shapley, "BLOCK_ROWS", 7)
            m.setattr(shapley, "CHUNK_VALUES", 3)
            m.setattr(shapley, "SPLIT_VALUES", splits)
            cut = shapley.knn_shapley(df, df, ["x"], k=2, steps=steps).toPandas().set_index("row_id")["score"]
        assert len(whole) == 20 and (whole - cut).abs().max() < 1e-12
    with pytest.raises(ValueError, match="at least one"):
        shapley.knn_shapley(df, df.where("row_id < 0"), ["x"])


@pytest.mark.parametrize("splits", [1_000_000, 150])
@pytest.mark.parametrize("k,error", [(1, 0.02), (5, 0.05), (3, 1.0), (1, 1e-9)])
def test_truncated_values_stay_within_their_error(spark, monkeypatch, splits, k, error):
    monkeypatch.setattr(shapley, "SPLIT_VALUES", splits)
    monkeypatch.setattr(shapley, "CHUNK_VALUES", 20)
    rng = np.random.RandomState(9)
    x = np.round(rng.randn(200, 2), 1)  # many ties
    x[:60] = x[0]
    rows = [(i, int(rng.rand() < 0.4), *map(float, x[i])) for i in range(200)]
    train = frame(spark, rows, "row_id bigint, y int, a double, b double")
    val = train.where("row_id % 9 = 0")
    exact = shapley.knn_shapley(train, val, ["a", "b"], k=k).toPandas().set_index("row_id")["score"]
    near = shapley.knn_shapley(train, val, ["a", "b"], k=k, error=error).toPandas().set_index("row_id")["score"]
    off = (exact - near).abs()
    assert len(near) == 200 and off.max() <= error + 1e-12
    assert (off.max() < 1e-12) == (error < 1e-6)


def test_own_utility_of_three_labels(spark):
    """Closeness of labels, against all orders."""
    x, y, v, label, k = [0.1, 0.5, 0.2, 0.9, 0.4], ["a", "c", "b", "a", "c"], 0.0, "b", 2
    worth = {"a": 0.25, "b": 1.0, "c": -0.5}
    want = np.zeros(5)
    for order in permutations(range(5)):
        have = []
        gain = lambda s: sum(worth[y[i]] for i in sorted(s, key=lambda i: x[i])[:k]) / k
        for i in order:
            want[i] += (gain([*have, i]) - gain(have)) / 120
            have.append(i)
    train = frame(spark, [(i, y[i], x[i]) for i in range(5)], "row_id bigint, y string, x double")
    val = frame(spark, [(0, label, v)], "row_id bigint, y string, x double")
    closeness = lambda name: F.when(F.col("y") == "b", F.lit(worth[name])).otherwise(0.0)
    got = shapley.knn_shapley(train, val, ["x"], closeness, k=k, labels=("a", "b", "c")).toPandas().set_index("row_id")["score"]
    assert np.abs(got.sort_index().to_numpy() - want).max() < 1e-12
    with pytest.raises(Exception, match="none of"):
        shapley.knn_shapley(train, val, ["x"], closeness, labels=("a", "b")).collect()


def test_missing_features_are_an_error(spark):
    train = frame(spark, [(0, 1, 1.0), (1, 0, float("nan"))], "row_id bigint, y int, x double")
    with pytest.raises(Exception, match="NULL or NaN"):
        shapley.knn_shapley(train, train.where("row_id = 0"), ["x"]).collect()


@pytest.mark.parametrize("scale", [1e-150, 1e-10, 1.0, 31_000.0, 1e140])
@pytest.mark.parametrize("steps", [None, 128])
def test_shapley_at_any_scale(spark, scale, steps):
    x, y = np.arange(6) * scale, np.array([1, 0, 1, 0, 0, 1])
    train = frame(spark, [(i, int(y[i]), float(x[i])) for i in range(6)], "row_id bigint, y int, x double")
    val = frame(spark, [(0, 1, 0.0)], "row_id bigint, y int, x double")
    got = {r["row_id"]: r["score"] for r in shapley.knn_shapley(train, val, ["x"], steps=steps).collect()}
    want = brute_shapley(x / scale, y, np.zeros(1), np.ones(1, int), 1)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(6))


# ------------------------------------------------- confidence, entropy, codes


def test_entropy_ranks_every_row_once(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(100, 2)
    y = (x.sum(axis=1) > 0).astype(int)
    df = frame(spark, [(i, int(y[i]), False, *map(float, x[i])) for i in range(100)], "row_id bigint, y int, protected boolean, a double, b double")
    oof = NaiveBayes(Spec(("a", "b"))).oof(df)
    ranked = confident.rank_by_entropy(oof).orderBy("rank").collect()
    assert sorted(r["row_id"] for r in ranked) == list(range(100))
    assert [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True)


def test_planted_label_errors_come_first(spark):
    rows = [(i, int(i % 2 == 0) if i not in (3, 10) else int(i % 2 == 1), False, "a" if i % 2 == 0 else "b") for i in range(60)]
    df = frame(spark, rows, "row_id bigint, y int, protected boolean, c string")
    oof = NaiveBayes(Spec((), ("c",))).oof(df)
    flagged = confident.find_label_issues(oof).collect()
    assert {r["row_id"] for r in flagged} == {3, 10}


def test_codes_in_first_appearance_order(spark):
    rows = [(5, "z"), (6, None), (7, "a"), (8, "z"), (9, "m")]
    df = frame(spark, rows, "row_id bigint, c string").repartition(3)
    got = {r["row_id"]: r["c"] for r in encode.factorize(df, ["c"]).collect()}
    assert got == {5: 0.0, 6: -1.0, 7: 1.0, 8: 0.0, 9: 2.0}


def test_nan_becomes_null_and_is_imputed(spark):
    df = nan_to_null(frame(spark, [(0, 1.0), (1, math.nan), (2, 2.0), (3, 3.0), (4, 4.0)], "row_id bigint, x double"))
    assert df.where("x is null").count() == 1
    fitted = MedianImputer(["x"]).fit(df).transform(df)
    assert fitted.where("row_id = 1").first()["x"] == 2.5
    z = Standardizer(["x"]).fit(fitted).transform(fitted).toPandas()["x"]
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=0) - 1) < 1e-12


def test_yeo_johnson_finds_the_log(spark):
    rng = np.random.RandomState(3)
    df = frame(spark, [(i, float(np.exp(v) - 1)) for i, v in enumerate(rng.randn(2000) * 0.3 + 2)], "row_id bigint, x double")
    assert abs(fit_yeo_johnson(df, ["x"])["x"]) < 0.15


def test_stable_folds_use_only_other_folds(spark):
    """A row's own label must not reach its out-of-fold probability."""
    rows = [(i, i % 2, False, float(i % 5)) for i in range(100)]
    df = frame(spark, rows, "row_id bigint, y int, protected boolean, x double")
    model = NaiveBayes(Spec(("x",)))
    before = {r["row_id"]: (r["fold"], r["p1"]) for r in model.oof(df).collect()}
    assert len(before) == 100 and all(0 < p < 1 for _, p in before.values())


def test_group_values_in_batches(spark, monkeypatch):
    rows = [(i, int(i * 7 % 10 < 5), i % 2 == 0, "abc"[i % 3], float(i * 7 % 10)) for i in range(90)]
    df = frame(spark, rows, "row_id bigint, y int, protected boolean, grp string, x double")
    train, val = df.where("row_id < 60"), df.where("row_id >= 60")

    def values():
        got = groups.group_shapley(train, val, Spec(("x",)), "grp", n_perms=5).collect()
        return {r["grp"]: (round(r["score"], 12), r["n_rows"]) for r in got}

    whole = values()
    monkeypatch.setattr(groups, "BATCH_NUMBERS", 8)  # one permutation a batch
    assert len(whole) == 3 and values() == whole
