"""Fits of a curve, and the settings of the forest that make one quick."""

from rowmend.core import Spec
from rowmend.models.mllib import forest_model
from rowmend.plans import experiments

from .conftest import frame


class Counted:
    """A scorer that says 1, and the rows it was fitted on."""

    def __init__(self):
        self.fits = []

    def predict(self, train, rows):
        self.fits.append(sorted(r["row_id"] for r in train.where("x = 9").collect()))
        return rows.selectExpr("*", "1 AS pred")


def test_points_that_clean_the_same_rows_share_a_fit(spark):
    train = frame(spark, [(i, i % 2, i % 2, True, float(i), False) for i in range(8)], "row_id bigint, y int, y_clean int, is_noisy boolean, x double, protected boolean")
    noisy = range(4)
    ranks = [("shapley", -1, i, i + 1) for i in noisy] + [("random", s, i, (i + s) % 4 + 1) for s in experiments.SEEDS for i in noisy]
    ranks += [("confident", -1, i, i - 2) for i in (3, 4)]  # other rows
    rankings = frame(spark, [(m, s, i, r, 2 if m == "confident" else 4) for m, s, i, r in ranks], "method string, seed int, row_id bigint, rank bigint, n_ranked bigint")
    how = experiments.Noise("cap", (0.0, 0.5, 1.0), rankers=("shapley", "confident", "random"))
    model = Counted()
    curve = experiments.cleaning_curve(model, train, train, rankings, Spec(("x",), outlier="x"), how, 9.0, threads=1)
    assert curve.count() == 15 and {r["n_cleaned"] for r in curve.collect()} == {0, 1, 2, 4}
    # none, two halves of four series and one of another, both ends
    assert len(model.fits) == 1 + 5 + 2
    assert [0, 1, 2, 3] in model.fits and [3, 4] in model.fits


def test_rows_keep_their_nodes_while_trees_grow(spark):
    rows = [(i, i % 2, float(i * 7 % 10), float(i * 3 % 11)) for i in range(40)]
    train = frame(spark, rows, "row_id bigint, y int, a double, b double")
    stages = forest_model(Spec(("a", "b")))._stages(train)
    assert stages[-1].getCacheNodeIds()
