import pytest
from pyspark.sql import functions as F

from checks import views
from rowmend import run, run_experiment, stable
from rowmend.core import Spec
from rowmend.plans import reports
from rowmend.plans.experiments import NOISE_TYPES, RANKERS
from rowmend.sources import readers, store


@pytest.fixture(scope="module")
def docs(spark, small):
    return stable(views.docs(spark, small))


def test_group_label_run_wiring(spark, docs):
    exp = run_experiment(docs, views.DOCS, "group_label", grid=[0.0, 0.5, 1.0])
    curve = exp.curve.toPandas()
    assert set(curve["method"]) == set(RANKERS)
    assert len(curve) == 3 * (len(RANKERS) + 2)
    assert curve["accuracy"].between(0, 1).all() and curve["dp_gap"].between(0, 1).all()
    start = curve[curve["proportion"] == 0]
    assert start["accuracy"].nunique() == 1 and start["dp_gap"].nunique() == 1
    entropy = exp.rankings.where("method = 'entropy'")
    n = exp.train.count()
    assert entropy.count() == n == entropy.select("row_id").distinct().count()
    noisy = {r["row_id"] for r in exp.train.where("is_noisy").collect()}
    for method in ("shapley", "fair_shapley", "fair_heuristic"):
        assert {r["row_id"] for r in exp.rankings.where(F.col("method") == method).collect()} == noisy


def test_sweep_equals_refitting(spark, docs):
    """The one-pass sweep against one fit per point."""
    from rowmend.models.naive_bayes import NaiveBayes
    from rowmend.operators import metrics, repair

    exp = run_experiment(docs, views.DOCS, "outlier", grid=[0.0, 0.35, 1.0], methods=("random",))
    for r in exp.curve.where("seed = 101").collect():
        order = exp.rankings.where("seed = 101")
        fixed = repair.apply_prefix(exp.train, order, r["proportion"], repair.action_cap("n_chars", exp.cap))
        model = NaiveBayes(views.DOCS)
        # bins stay those of the uncleaned rows
        from rowmend.models.naive_bayes import Binner

        scored = model._predict(Binner.fit(exp.train, views.DOCS), fixed, exp.test)
        got = metrics.evaluate(scored).first()
        assert got["accuracy"] == pytest.approx(r["accuracy"]) and got["dp_gap"] == pytest.approx(r["dp_gap"])


def test_removing_every_row_gives_null(spark):
    rows = [(i, i % 2, i % 3 == 0, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, y int, protected boolean, x double")
    exp = run_experiment(df, Spec(("x",), (), "x"), "group_missing", methods=("entropy",), grid=[0.0, 1.0])
    last = exp.curve.where("proportion = 1.0").first()
    n = exp.train.count()
    assert last["n_cleaned"] == int(0.95 * n) and last["accuracy"] is not None
    from rowmend.plans.experiments import Noise, cleaning_curve
    from rowmend.models.naive_bayes import NaiveBayes

    how = Noise("remove", (0.0, 1.0), 1.0, ("entropy",))
    spec = Spec(("x",), (), "x")
    curve = cleaning_curve(NaiveBayes(spec), exp.train, exp.test, exp.rankings, spec, how, None)
    last = curve.where("proportion = 1.0").first()
    assert last["n_cleaned"] == n and last["accuracy"] is None and last["dp_gap"] is None


def test_logistic_curve(spark, docs):
    exp = run(
        spark, (docs, views.DOCS), "random_label", model="logistic", proportions=[0.0, 1.0], methods=("random",)
    )
    rows = exp.curve.collect()
    assert len(rows) == 6 and all(0 <= r["accuracy"] <= 1 for r in rows)
    ends = {r["accuracy"] for r in rows if r["proportion"] == 1.0}
    assert len(ends) == 1  # all flips restored: the order no longer matters


def test_unknown_names(spark, docs):
    with pytest.raises(ValueError, match="unknown noise type"):
        run(spark, (docs, views.DOCS), "nonsense")
    with pytest.raises(ValueError, match="unknown model"):
        run(spark, (docs, views.DOCS), "outlier", model="nonsense")
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "nonsense", ".")
    assert set(NOISE_TYPES) >= {"outlier", "random_label", "group_label", "group_missing", "no_noise"}


def test_space_separated_dataset(spark, tmp_path):
    line = "A11 6 A34 A43 1169 A65 A75 4 {sex} A101 4 A121 67 A143 A152 2 A173 1 A192 A201 {label}\n"
    (tmp_path / "german.data").write_text(
        line.format(sex="A93", label=1) + line.format(sex="A92", label=2) + line.format(sex="A95", label=1)
    )
    df, spec = readers.load_dataset(spark, "german", str(tmp_path))
    rows = df.orderBy("row_id").collect()
    assert [r["y"] for r in rows] == [1, 0, 1]
    assert [r["protected"] for r in rows] == [False, True, True]
    assert [r["personal_status"] for r in rows] == [0.0, 1.0, 2.0]
    assert len(spec.num) == 7 and len(spec.cat) == 13 and spec.outlier == "duration"


def test_comma_separated_dataset(spark, tmp_path):
    (tmp_path / "adult.data").write_text(
        "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K\n"
        "50, ?, 83311, Bachelors, 13, Married, Exec, Wife, White, Female, 0, 0, 13, United-States, >50K\n"
    )
    df, spec = readers.load_dataset(spark, "adult", str(tmp_path))
    rows = df.orderBy("row_id").collect()
    assert [r["y"] for r in rows] == [0, 1] and [r["protected"] for r in rows] == [False, True]
    assert [r["workclass"] for r in rows] == [0.0, -1.0]
    assert spec.outlier == "hours_per_week" and rows[0]["hours_per_week"] == 40.0


def test_header_dataset_with_missing_numbers(spark, tmp_path):
    (tmp_path / "titanic.csv").write_text(
        "PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked\n"
        '1,0,3,"B, Mr. O",male,22,1,0,A/5,7.25,,S\n2,1,1,"C, Mrs. J",female,,1,0,PC,71.28,C85,\n'
    )
    df, spec = readers.load_dataset(spark, "titanic", str(tmp_path))
    rows = df.orderBy("row_id").collect()
    assert set(spec.features) == {"Pclass", "Sex", "Age", "SibSp", "Parch", "Fare", "Embarked"}
    assert rows[1]["Age"] is None and rows[1]["Embarked"] == -1.0 and rows[1]["protected"]


CURVE_DDL = (
    "dataset string, noise_type string, model string, method string, seed int, proportion double, "
    "n_cleaned bigint, accuracy double, dp_gap double"
)


def test_store_reads_older_tables(spark, tmp_path):
    path = str(tmp_path / "curves")
    old = spark.createDataFrame([("shapley", -1, 0.0, 0.8)], "method string, seed int, proportion double, accuracy double")
    store.write_table(store.tagged(old, "d", "outlier", "nb"), path)
    new = spark.createDataFrame(
        [("random", 100, 0.0, 0, 0.9, 0.1)], "method string, seed int, proportion double, n_cleaned bigint, accuracy double, dp_gap double"
    )
    store.write_table(store.tagged(new, "d", "no_noise", "nb"), path)
    rows = {r["method"]: r for r in store.read_curves(spark, path).collect()}
    assert rows["shapley"]["dp_gap"] is None and rows["random"]["dp_gap"] == 0.1


def _curves(spark):
    rows = []
    for model, finals in (("a", {"shapley": 0.8, "confident": 0.8, "entropy": 0.0}), ("b", {"shapley": 0.7, "confident": 0.9})):
        for method, final in finals.items():
            rows += [("d", "outlier", model, method, -1, 0.0, 0, 0.6, 0.2), ("d", "outlier", model, method, -1, 1.0, 9, final, 0.1)]
        for seed, final in ((100, 0.5), (101, 0.7)):
            rows += [("d", "outlier", model, "random", seed, 0.0, 0, 0.6, 0.2), ("d", "outlier", model, "random", seed, 1.0, 9, final, 0.3)]
    return spark.createDataFrame(rows, CURVE_DDL)


def test_reports_on_hand_computed_curves(spark):
    curves = _curves(spark)
    best = {r["model"]: (r["best"], r["best_accuracy"], r["gain"]) for r in reports.best_method(curves).collect()}
    assert best == {"a": ("shapley", 0.8, 0.2), "b": ("confident", 0.9, 0.3)}
    heat = reports.improvement_heatmap(curves).first()
    assert heat["shapley"] == pytest.approx(0.15) and heat["confident"] == pytest.approx(0.25)
    assert heat["entropy"] == pytest.approx(-0.6)  # a final of 0.0 is a value, not a gap
    table = {r["model"]: r for r in reports.accuracy_table(curves).collect()}
    assert table["a"]["entropy"] == 0.0 and table["b"]["entropy"] is None and table["a"]["random"] == 0.6
    assert [r["model"] for r in reports.top_gains(curves, limit=1).collect()] == ["b"]
    assert reports.dp_summary(curves).where("model = 'a'").first()["random"] == 0.3
