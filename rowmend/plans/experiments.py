"""Experiments: split, corrupt, rank, repair along a grid, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Spec, in_parallel, spread, stable
from ..models.mllib import forest_model, logistic_model
from ..models.naive_bayes import NaiveBayes
from ..operators import confident, fairness, noise, repair, shapley
from ..operators.encode import factorize
from ..operators.metrics import evaluate_guarded
from ..operators.sampling import split_rows

GRID = repair.proportion_grid()  # 0, 5, ..., 100 %
CONTROL_GRID = repair.proportion_grid(11)  # 0, 5, ..., 50 %
RANKERS = ("shapley", "fair_shapley", "fair_heuristic", "confident", "entropy", "random")
SEEDS = (100, 101, 102)
SINGLE = -1  # seed column of rankings that use no seed


@dataclass
class Experiment:
    """Result tables of one run."""

    noise_type: str
    model: str
    grid: list[float]
    train: DataFrame  # the corrupted training rows with their clean values
    test: DataFrame
    val: DataFrame
    rankings: DataFrame  # method, seed, row_id, score, rank, n_ranked
    curve: DataFrame  # method, seed, proportion, n_cleaned, accuracy, dp_gap
    cap: float | None = None
    split: DataFrame | None = None
    extras: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Noise:
    """How a noise type corrupts and repairs."""

    action: str  # cap, restore, remove or flip
    grid: tuple[float, ...] = tuple(GRID)
    entropy_cap: float = 1.0
    rankers: tuple[str, ...] = RANKERS


NOISE_TYPES: dict[str, Noise] = {
    "outlier": Noise("cap"),
    "random_label": Noise("restore"),
    "group_label": Noise("restore"),
    "group_missing": Noise("remove", entropy_cap=0.95),
    "no_noise": Noise("flip", grid=tuple(CONTROL_GRID)),
    "outlier_removal": Noise("remove", rankers=("shapley",)),
}


def make_model(name, spec: Spec):
    """Scorer by key ("nb", "logistic" or "forest"), or what a function makes of the spec."""
    if callable(name):
        return name(spec)
    builders = {"nb": NaiveBayes, "logistic": logistic_model, "forest": forest_model}
    if name not in builders:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(builders)}")
    return builders[name](spec)


def corrupt(split: DataFrame, spec: Spec, noise_type: str, level: float, seed: int):
    """(corrupted train rows, cap or None)."""
    train = split.where(F.col("split") == "train")
    if noise_type in ("outlier", "outlier_removal"):
        return noise.inject_outlier_pooled(split, spec.outlier, level, seed=seed)
    if noise_type == "random_label":
        return noise.inject_random_label(train, level, seed), None
    if noise_type == "group_label":
        return noise.inject_group_label(train, level, seed), None
    if noise_type == "group_missing":
        return noise.inject_group_missing(train, [spec.outlier], level, seed), None
    return noise.no_noise(train), None


def rank_rows(model, train: DataFrame, val: DataFrame, methods, k: int = 1,
              shapley_steps: int | None = None, shapley_error: float | None = None) -> DataFrame:
    """All requested rankings of one corrupted training table, stacked."""
    candidates = train.where("is_noisy").select("row_id")

    def labelled(method: str, ranking: DataFrame) -> DataFrame:
        if "seed" not in ranking.columns:
            ranking = ranking.withColumn("seed", F.lit(SINGLE))
        if "score" not in ranking.columns:
            ranking = ranking.withColumn("score", F.lit(None).cast("double"))
        return ranking.select(
            F.lit(method).alias("method"), F.col("seed").cast("int").alias("seed"), "row_id", "score",
            F.col("rank").cast("long").alias("rank"), F.col("n_ranked").cast("long").alias("n_ranked"),
        )

    def by_distance() -> list[DataFrame]:
        wanted = [m for m in ("shapley", "fair_shapley") if m in methods]
        if not wanted:
            return []
        apply, cols = model.space(train)
        train_space = stable(apply(train).select("row_id", "y", *cols))

        def scored(rows: DataFrame, utilities: dict[str, str]) -> DataFrame:
            return shapley.knn_shapley_of(train_space, rows, cols, utilities, k, shapley_steps, shapley_error)

        def plain() -> DataFrame:
            scores = scored(apply(val).select("row_id", "y", *cols), {"score": "accuracy"})
            return labelled("shapley", shapley.rank_by_shapley(scores, candidates))

        def with_pred(*more: str) -> DataFrame:
            pred = model.predict(train, val).select("row_id", "pred")
            return apply(val).select("row_id", *more, "protected", *cols).join(pred, "row_id")

        def parity() -> DataFrame:
            scores = scored(with_pred(), {"score": "parity"})
            return labelled("fair_shapley", shapley.rank_by_shapley(scores, candidates))

        ids = val.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids")).first()
        if len(wanted) == 2 and ids["n"] == ids["ids"]:  # else the join of the predictions has other rows
            both = stable(scored(with_pred("y"), {"shapley": "accuracy", "fair_shapley": "parity"}))
            ranked = lambda m: labelled(m, shapley.rank_by_shapley(both.select("row_id", F.col(m).alias("score")), candidates))
            return in_parallel(*[lambda m=m: ranked(m) for m in wanted])
        return in_parallel(*[{"shapley": plain, "fair_shapley": parity}[m] for m in wanted])

    def by_probability() -> list[DataFrame]:
        wanted = [m for m in ("confident", "entropy") if m in methods]
        if not wanted:
            return []
        oof = stable(model.oof(train))
        how = {"confident": confident.find_label_issues, "entropy": confident.rank_by_entropy}
        return in_parallel(*[lambda m=m: labelled(m, how[m](oof)) for m in wanted])

    def by_labels() -> list[DataFrame]:
        if "fair_heuristic" not in methods:
            return []
        return [labelled("fair_heuristic", fairness.rank_by_parity_impact(train, candidates))]

    def by_chance() -> list[DataFrame]:
        return [labelled("random", confident.rank_random(candidates, SEEDS))] if "random" in methods else []

    parts = [r for group in in_parallel(by_distance, by_probability, by_labels, by_chance) for r in group]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def series_of(methods) -> list[tuple[str, int]]:
    return [(m, s) for m in methods for s in (SEEDS if m == "random" else (SINGLE,))]


def repair_action(kind: str, spec: Spec, cap: float | None) -> repair.Action:
    if kind == "cap":
        return repair.action_cap(spec.outlier, cap)
    return {
        "restore": repair.action_restore_labels,
        "remove": repair.action_remove,
        "flip": repair.action_flip,
    }[kind]()


def _moves(train: DataFrame, rankings: DataFrame, spec: Spec, how: Noise, cap: float | None):
    top = F.when(F.col("method") == "entropy", F.lit(how.entropy_cap)).otherwise(1.0)
    ranked = rankings.select(
        "method", "seed", "row_id", repair.first_grid_index(list(how.grid), top).alias("_point")
    )
    after = {f"{c}_after": F.col(c) for c in spec.features}
    after["y_after"] = F.col("y")
    after["keep_after"] = F.lit(how.action != "remove")
    if how.action == "cap":
        after[f"{spec.outlier}_after"] = F.lit(cap)
    elif how.action == "restore":
        after["y_after"] = F.col("y_clean")
    elif how.action == "flip":
        after["y_after"] = 1 - F.col("y")
    return ranked.join(train.withColumns(after), "row_id")


def cleaning_curve(model, train: DataFrame, test: DataFrame, rankings: DataFrame,
                   spec: Spec, how: Noise, cap: float | None, threads: int = 4) -> DataFrame:
    """(method, seed, proportion, n_cleaned, accuracy, dp_gap).

    The Naive Bayes scorer updates its counts along the grid in one pass; logistic models
    of all points are fitted together where repairs change labels only.
    Other models are refitted at every point, and a fit refused as invalid gives
    NULL metrics; the driver keeps a few fits in
    flight, and points that clean the same rows share one fit.
    """
    grid, methods = list(how.grid), how.rankers
    spark = train.sparkSession
    series = series_of(methods)
    sizes = {(m, s): 0 for m, s in series}
    for r in rankings.groupBy("method", "seed").agg(F.max("n_ranked").alias("n")).collect():
        sizes[(r["method"], r["seed"])] = r["n"]

    def cleaned(method: str, seed: int, p: float) -> int:
        top = how.entropy_cap if method == "entropy" else 1.0
        return int(min(p, top) * sizes[(method, seed)])

    points = [
        (m, s, g, float(p), cleaned(m, s, p)) for m, s in series for g, p in enumerate(grid)
    ]
    if hasattr(model, "sweep"):
        table = spark.createDataFrame(
            points, "method string, seed int, g int, proportion double, n_cleaned long"
        )
        moves = _moves(train, rankings, spec, how, cap)
        metrics = model.sweep(train, moves, test, grid, series)
        return metrics.join(F.broadcast(table), ["method", "seed", "g"]).select(
            "method", "seed", "proportion", "n_cleaned", "accuracy", "dp_gap"
        )

    if hasattr(model, "relabel_sweep") and how.action in ("restore", "flip"):
        table = spark.createDataFrame(points, "method string, seed int, g int, proportion double, n_cleaned long")
        moves = _moves(train, rankings, spec, how, cap).select("method", "seed", "row_id", "_point", "y_after")
        metrics = model.relabel_sweep(train, moves, test, grid, series)
        return metrics.join(F.broadcast(table), ["method", "seed", "g"]).select(
            "method", "seed", "proportion", "n_cleaned", "accuracy", "dp_gap"
        )

    action = repair_action(how.action, spec, cap)

    # the rows and their rank in every ranking, stored once: a point is a projection
    column = {(m, s): f"_rank_{i}" for i, (m, s) in enumerate(series)}
    ranks = rankings.groupBy("row_id").agg(
        *[F.max(F.when((F.col("method") == m) & (F.col("seed") == s), F.col("rank"))).alias(c) for (m, s), c in column.items()]
    )
    ranked = stable(train.join(ranks, "row_id", "left"))

    def fit_point(key):
        method, seed, n = key
        chosen = F.coalesce(F.col(column[(method, seed)]) <= n, F.lit(False)) if n else F.lit(False)
        rows = action(ranked, chosen).select("row_id", "y", *spec.features)
        got = evaluate_guarded(model, rows, test)
        return key, (got["accuracy"], got["dp_gap"])

    # rankings of the same rows clean the same ones at their end
    kinds = ranked.groupBy(*[F.col(c).isNotNull().alias(c) for c in column.values()]).count().collect()
    ends: dict[tuple, tuple[str, int, int]] = {}

    def fit_of(method: str, seed: int, n: int) -> tuple[str, int, int]:
        if not n:
            return "", 0, 0
        if n < sizes[(method, seed)]:
            return method, seed, n
        return ends.setdefault(tuple(k[column[(method, seed)]] for k in kinds), (method, seed, n))

    fits = [fit_of(m, s, n) for m, s, _, _, n in points]
    fitted = dict(in_parallel(*[lambda key=key: fit_point(key) for key in sorted(set(fits))], threads=threads))
    rows = [(m, s, p, n, *fitted[key]) for (m, s, _, p, n), key in zip(points, fits)]
    return spark.createDataFrame(
        rows, "method string, seed int, proportion double, n_cleaned long, accuracy double, dp_gap double"
    )


def run_experiment(
    df: DataFrame, spec: Spec, noise_type: str, model: str | Callable = "nb", level: float = 0.2,
    seed: int = 42, split_seed: int = 0, grid: list[float] | None = None,
    methods: tuple[str, ...] | None = None, k: int = 1, shapley_steps: int | None = None, val_cap: int | None = None,
    shapley_error: float | None = None,
) -> Experiment:
    """Run one experiment on a frame (row_id, y, protected, features).

    ``model``: a key of ``make_model``, or a function from the spec to a scorer (``forest_model`` with
    other arguments, say).  ``shapley_steps`` and ``shapley_error``: see ``knn_shapley``.
    ``val_cap`` bounds the validation rows; those left out are ``unused`` in the split."""
    if noise_type not in NOISE_TYPES:
        raise ValueError(f"unknown noise type {noise_type!r}; choose from {sorted(NOISE_TYPES)}")
    default = NOISE_TYPES[noise_type]
    how = Noise(
        default.action, tuple(grid) if grid else default.grid, default.entropy_cap,
        tuple(methods) if methods else default.rankers,
    )
    scorer = make_model(model, spec)
    if model != "nb" and spec.cat:
        df = factorize(df, spec.cat)
    used = df.select("row_id", "y", "protected", *spec.features)
    split = stable(spread(split_rows(used, val_cap=val_cap, seed=split_seed)))
    # predicates and literals on top of the split table: nothing to store
    train, cap = corrupt(split, spec, noise_type, level, seed)
    val = split.where(F.col("split") == "val")
    test = split.where(F.col("split") == "test")
    rankings = stable(rank_rows(scorer, train, val, how.rankers, k, shapley_steps, shapley_error))
    curve = cleaning_curve(scorer, train, test, rankings, spec, how, cap)
    name = model if isinstance(model, str) else getattr(scorer, "name", "own")
    return Experiment(noise_type, name, list(how.grid), train, test, val, rankings, curve, cap, split)


def run_outlier(df, spec, **kw) -> Experiment:
    """Pooled outliers, repaired by assigning the cap."""
    return run_experiment(df, spec, "outlier", **kw)


def run_outlier_removal(df, spec, **kw) -> Experiment:
    """Pooled outliers, repaired by dropping rows in Shapley order."""
    return run_experiment(df, spec, "outlier_removal", **kw)


def run_random_label(df, spec, **kw) -> Experiment:
    """Uniform label flips, repaired by restoring labels."""
    return run_experiment(df, spec, "random_label", **kw)


def run_group_label(df, spec, **kw) -> Experiment:
    """Label flips in the protected group, repaired by restoring labels."""
    return run_experiment(df, spec, "group_label", **kw)


def run_group_missing(df, spec, **kw) -> Experiment:
    """Missing values in the protected group, repaired by dropping rows."""
    return run_experiment(df, spec, "group_missing", **kw)


def run_no_noise_control(df, spec, **kw) -> Experiment:
    """Clean rows whose labels are flipped in ranking order, up to 50 %."""
    return run_experiment(df, spec, "no_noise", **kw)
