"""Registered queries: each runs one operator over the test tables and, where
the operator can be stated in SQL, names the statement that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.core import Spec, ensure_checkpoint_dir, nan_to_null, stable
from rowmend.functions import uniform, yeo_johnson
from rowmend.models.mllib import forest_model, logistic_model
from rowmend.models.naive_bayes import NaiveBayes
from rowmend.models.preprocess import MedianImputer, Standardizer, anova_f, fit_yeo_johnson
from rowmend.operators import confident, encode, fairness, metrics, noise, ranking, repair, sampling, shapley
from rowmend.plans import experiments, provenance, reports
from rowmend.sources import readers, results, store

from . import logisticsql as L
from . import sqltext as S
from . import views
from .views import DOCS, EVENTS, LINES, ORDERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def R(col: str, digits: int = 6) -> F.Column:
    return F.round(col, digits).alias(col)


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------- scans and sinks

ORDER_TEXT = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


def _order_text(spark, sf):
    return views.table(spark, sf, "orders").select(*ORDER_TEXT.names)


@query(
    "scan_delimited_header_less",
    "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice FROM orders",
)
def scan_delimited_header_less(spark, sf):
    path = scratch(spark, "csv")
    status = F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_orderstatus"))
    text = _order_text(spark, sf).withColumn("o_orderstatus", F.concat(F.lit(" "), status))
    text.write.option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_delimited(spark, path, ORDER_TEXT, null_value="?", trim=True)


@query("scan_space_delimited", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_space_delimited(spark, sf):
    path = scratch(spark, "txt")
    _order_text(spark, sf).write.option("sep", " ").csv(path)
    return readers.read_delimited(spark, path, ORDER_TEXT, sep=" ")


@query("scan_csv_header", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv_header(spark, sf):
    path = scratch(spark, "csvh")
    _order_text(spark, sf).write.csv(path, header=True)
    return readers.read_header_csv(spark, path, ORDER_TEXT)


@query("nan_to_null", "SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders")
def nan_to_null_q(spark, sf):
    o = views.table(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return nan_to_null(o.select(F.col("o_orderkey").alias("row_id"), price.alias("price")))


# ------------------------------------------------------- encoding operators


@query("derive_binary_label", "SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders")
def derive_binary_label(spark, sf):
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), encode.binary_label("o_orderstatus", "F").alias("y")
    )


@query(
    "protected_mask",
    "SELECT c_custkey AS row_id, coalesce(c_mktsegment IN ('HOUSEHOLD', 'MACHINERY'), FALSE) AS protected FROM customer",
)
def protected_mask(spark, sf):
    return views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), encode.member("c_mktsegment", ["HOUSEHOLD", "MACHINERY"]).alias("protected")
    )


@query("project_features", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def project_features(spark, sf):
    return encode.frame_columns(views.table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query(
    "cast_double",
    "SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_suppkey AS DOUBLE) AS l_suppkey FROM lineitem",
)
def cast_double(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return encode.cast_double(lines, ["l_linenumber", "l_suppkey"])


FACTORIZE_SQL = S.with_(
    S.view("orders")
    + [("w", "SELECT row_id, nullif(status, 'P') AS status, segment FROM v")]
    + [
        (f"d_{c}", f"SELECT {c}, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM w WHERE {c} IS NOT NULL GROUP BY {c}")
        for c in ("status", "segment")
    ],
    """SELECT row_id, CAST(coalesce(a.code, -1) AS DOUBLE) AS status, CAST(coalesce(b.code, -1) AS DOUBLE) AS segment
       FROM w LEFT JOIN d_status a ON a.status = w.status LEFT JOIN d_segment b ON b.segment = w.segment""",
)


@query("factorize", FACTORIZE_SQL)
def factorize(spark, sf):
    v = views.orders(spark, sf)
    status = F.when(F.col("status") != "P", F.col("status"))
    return encode.factorize(v.select("row_id", status.alias("status"), "segment"), ["status", "segment"])


@query(
    "factorize_many_values",
    """SELECT o_orderkey AS row_id, CAST(code AS DOUBLE) AS name FROM orders JOIN customer c ON o_custkey = c_custkey
       JOIN (SELECT c_name, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) d ON d.c_name = c.c_name""",
)
def factorize_many_values(spark, sf):
    o, c = views.table(spark, sf, "orders"), views.table(spark, sf, "customer")
    named = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_name").alias("name")
    )
    return encode.factorize(named, ["name"])


@query(
    "row_provenance",
    S.with_(
        S.split("orders"),
        """SELECT row_id AS dataset_index, row_number() OVER (ORDER BY row_id) - 1 AS train_position
           FROM sp WHERE split = 'train'""",
    ),
)
def row_provenance(spark, sf):
    train = sampling.split_rows(views.orders(spark, sf).select("row_id")).where("split = 'train'")
    return encode.with_position(train).select(F.col("row_id").alias("dataset_index"), "train_position")


# ------------------------------------------------------ ranks, splits, folds


@query(
    "global_rank",
    S.with_(S.view("lines"), "SELECT row_id, row_number() OVER (ORDER BY price, row_id) AS rank FROM v"),
)
def global_rank(spark, sf):
    lines = views.lines(spark, sf).select("row_id", "price")
    return ranking.score_rank(lines, "price", rows_per_bucket=50_000).select("row_id", "rank")


@query(
    "global_rank_ties",
    S.with_(S.view("lines"), "SELECT row_id, row_number() OVER (ORDER BY discount DESC, row_id) AS rank FROM v"),
)
def global_rank_ties(spark, sf):
    lines = views.lines(spark, sf).select("row_id", "discount")
    return ranking.score_rank(lines, "discount", descending=True, rows_per_bucket=20_000).select("row_id", "rank")


@query(
    "global_rank_hash",
    S.with_(S.view("lines"), f"SELECT row_id, row_number() OVER (ORDER BY {S.hkey('order:7')}, row_id) AS rank FROM v"),
)
def global_rank_hash(spark, sf):
    return ranking.hash_rank(views.lines(spark, sf).select("row_id"), "order:7").select("row_id", "rank")


@query("split_train_val_test", S.with_(S.split("orders"), "SELECT row_id, split FROM sp"))
def split_train_val_test(spark, sf):
    return sampling.split_rows(views.orders(spark, sf).select("row_id"))


@query(
    "val_cap",
    S.with_(
        S.split("lines", cap=100),
        "SELECT split, count(*) AS n, sum(CAST(row_id % 1000 AS BIGINT)) AS check_sum FROM sp GROUP BY split",
    ),
)
def val_cap(spark, sf):
    out = sampling.split_rows(views.lines(spark, sf).select("row_id"), val_cap=100)
    return out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("row_id") % 1000).alias("check_sum")
    )


@query(
    "sample_exact_uniform",
    S.with_(S.view("lines") + S.sampled("v", 0.15), "SELECT row_id FROM picked"),
)
def sample_exact_uniform(spark, sf):
    v = views.lines(spark, sf).select("row_id")
    return v.where(sampling.exact_sample(v, 0.15))


@query(
    "sample_exact_in_group",
    S.with_(S.view("events") + S.sampled("v", 0.3, "protected"), "SELECT row_id FROM picked"),
)
def sample_exact_in_group(spark, sf):
    v = views.events(spark, sf).select("row_id", "protected")
    return v.where(sampling.exact_sample(v, 0.3, where=F.col("protected"))).select("row_id")


@query(
    "stratified_kfold",
    S.with_(
        S.view("lines"),
        f"""SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {S.hkey('fold:0')}, row_id) - 1) % 5 AS INT) AS fold FROM v""",
    ),
)
def stratified_kfold(spark, sf):
    return sampling.stratified_folds(views.lines(spark, sf).select("row_id", "y"))


@query("uniform_draw", S.with_(S.view("events"), f"SELECT row_id, {S.unif('level:42')} AS u FROM v"))
def uniform_draw(spark, sf):
    return views.events(spark, sf).select("row_id", uniform("level:42").alias("u"))


# -------------------------------------------------------------------- noise


@query(
    "inject_outlier",
    S.with_(
        S.view("lines") + S.noisy("v", LINES, "outlier"),
        """SELECT row_id, is_noisy, round(price, 4) AS price, price_clean,
           (SELECT round(m + 2 * s, 4) FROM st) AS cap FROM noise_all""",
    ),
)
def inject_outlier(spark, sf):
    out, cap = noise.inject_outlier(views.lines(spark, sf), "price", 0.2)
    return out.select("row_id", "is_noisy", R("price", 4), "price_clean", F.round(F.lit(cap), 4).alias("cap"))


@query(
    "inject_outlier_pooled",
    S.with_(
        S.corrupted("orders", ORDERS, "outlier"),
        "SELECT row_id, is_noisy, round(price, 4) AS price, price_clean, y, (SELECT round(cap, 4) FROM cap) AS cap FROM tr",
    ),
)
def inject_outlier_pooled(spark, sf):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    out, cap = noise.inject_outlier_pooled(split, "price", 0.2)
    return out.select("row_id", "is_noisy", R("price", 4), "price_clean", "y", F.round(F.lit(cap), 4).alias("cap"))


@query(
    "inject_random_label",
    S.with_(S.view("lines") + S.noisy("v", LINES, "random_label"), "SELECT row_id, is_noisy, y_clean, y FROM noise_all"),
)
def inject_random_label(spark, sf):
    return noise.inject_random_label(views.lines(spark, sf), 0.2).select("row_id", "is_noisy", "y_clean", "y")


@query(
    "inject_group_label",
    S.with_(S.view("orders") + S.noisy("v", ORDERS, "group_label"), "SELECT row_id, protected, is_noisy, y_clean, y FROM noise_all"),
)
def inject_group_label(spark, sf):
    out = noise.inject_group_label(views.orders(spark, sf), 0.2)
    return out.select("row_id", "protected", "is_noisy", "y_clean", "y")


@query(
    "inject_group_missing",
    S.with_(S.view("events") + S.noisy("v", EVENTS, "group_missing"), "SELECT row_id, is_noisy, value, value_clean, y FROM noise_all"),
)
def inject_group_missing(spark, sf):
    out = noise.inject_group_missing(views.events(spark, sf), ["value"], 0.2)
    return out.select("row_id", "is_noisy", "value", "value_clean", "y")


# ------------------------------------------------------------------- repair

# random order of the flipped orders; the first 35 % of it is repaired
FLIPPED = S.view("orders") + S.noisy("v", ORDERS, "random_label") + [
    (
        "sel",
        f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {S.hkey('shuffle:100')}, row_id) AS r,
              count(*) OVER () AS n FROM noise_all WHERE is_noisy) WHERE r <= floor(0.35::DOUBLE * n)""",
    )
]


def _flipped(spark, sf):
    out = noise.inject_random_label(views.orders(spark, sf), 0.2)
    order = confident.rank_random(out.where("is_noisy"), [100])
    return out, order


@query(
    "action_cap",
    S.with_(FLIPPED, "SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM sel) THEN 250000.0::DOUBLE ELSE price END AS price FROM noise_all"),
)
def action_cap(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.apply_prefix(df, order, 0.35, repair.action_cap("price", 250000.0)).select("row_id", "price")


@query(
    "action_cap_clip",
    S.with_(FLIPPED, "SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM sel) THEN least(price, 250000.0::DOUBLE) ELSE price END AS price FROM noise_all"),
)
def action_cap_clip(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.apply_prefix(df, order, 0.35, repair.action_cap("price", 250000.0, "clip")).select("row_id", "price")


@query("action_remove", S.with_(FLIPPED, "SELECT row_id, y FROM noise_all WHERE row_id NOT IN (SELECT row_id FROM sel)"))
def action_remove(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.apply_prefix(df, order, 0.35, repair.action_remove()).select("row_id", "y")


@query("remove_listed", S.with_(FLIPPED, "SELECT row_id, y FROM noise_all WHERE row_id NOT IN (SELECT row_id FROM sel)"))
def remove_listed(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.remove_listed(df, order.where(repair.in_prefix(0.35))).select("row_id", "y")


@query(
    "action_flip",
    S.with_(FLIPPED, "SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM sel) THEN 1 - y ELSE y END AS y FROM noise_all"),
)
def action_flip(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.apply_prefix(df, order, 0.35, repair.action_flip()).select("row_id", "y")


RESTORE_SQL = S.with_(
    FLIPPED, "SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM sel) THEN y_clean ELSE y END AS y FROM noise_all"
)


@query("action_restore_labels", RESTORE_SQL)
def action_restore_labels(spark, sf):
    df, order = _flipped(spark, sf)
    return repair.apply_prefix(df, order, 0.35, repair.action_restore_labels()).select("row_id", "y")


@query("restore_from_table", RESTORE_SQL)
def restore_from_table(spark, sf):
    df, order = _flipped(spark, sf)
    trusted = views.orders(spark, sf).select("row_id", "y")
    return repair.restore_from(df, trusted, order.where(repair.in_prefix(0.35))).select("row_id", "y")


PREFIX_SQL = S.view("orders") + [
    ("k", f"SELECT row_id, row_number() OVER (ORDER BY {S.hkey('shuffle:100')}, row_id) AS rank, count(*) OVER () AS n FROM v")
]


def _prefix_sql(cap: float) -> str:
    return S.with_(
        PREFIX_SQL,
        f"""SELECT g * 0.05::DOUBLE AS proportion, count(*) AS n_cleaned, sum(row_id) AS id_sum
            FROM k CROSS JOIN range(0, 21) r(g) WHERE rank <= floor(least(g * 0.05::DOUBLE, {cap}::DOUBLE) * n) GROUP BY g""",
    )


def _prefixes(spark, sf, cap: float):
    """Sizes and id sums of every prefix: rows enter at one grid point each,
    the 21 totals are running sums."""
    grid = repair.proportion_grid()
    order = confident.rank_random(views.orders(spark, sf).select("row_id"), [100])
    at = order.withColumn("g", repair.first_grid_index(grid, cap)).where(F.col("g") < len(grid))
    per = at.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("s"))
    # one row per grid point: 21 at most
    spread = per.withColumn("p", F.explode(F.sequence(F.col("g"), F.lit(len(grid) - 1))))
    return spread.groupBy("p").agg(F.sum("n").alias("n_cleaned"), F.sum("s").alias("id_sum")).select(
        (F.col("p").cast("double") * F.lit(0.05)).alias("proportion"), "n_cleaned", "id_sum"
    )


@query("cleaned_prefix", _prefix_sql(1.0))
def cleaned_prefix(spark, sf):
    return _prefixes(spark, sf, 1.0)


@query("cleaned_prefix_capped", _prefix_sql(0.95))
def cleaned_prefix_capped(spark, sf):
    return _prefixes(spark, sf, 0.95)


# ----------------------------------------------------- preprocessing, models


@query(
    "impute_median",
    S.with_(
        S.view("lines") + S.noisy("v", LINES, "group_missing"),
        "SELECT row_id, coalesce(price, (SELECT median(price) FROM noise_all)) AS price FROM noise_all",
    ),
)
def impute_median(spark, sf):
    df = noise.inject_group_missing(views.lines(spark, sf), ["price"], 0.2)
    return MedianImputer(["price"]).fit(df).transform(df).select("row_id", "price")


@query(
    "impute_mode",
    S.with_(
        S.view("orders") + S.noisy("v", Spec((), ("status",), "status"), "group_missing"),
        """SELECT row_id, coalesce(status, (SELECT status FROM noise_all WHERE status IS NOT NULL GROUP BY status
           ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM noise_all""",
    ),
)
def impute_mode(spark, sf):
    from rowmend.models.preprocess import ModeImputer

    df = noise.inject_group_missing(views.orders(spark, sf), ["status"], 0.2)
    return ModeImputer(["status"]).fit(df).transform(df).select("row_id", "status")


@query(
    "standard_scale",
    S.with_(
        S.view("lines"),
        """SELECT row_id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price,
           round((quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER (), 6) AS quantity FROM v""",
    ),
)
def standard_scale(spark, sf):
    df = views.lines(spark, sf)
    return Standardizer(["price", "quantity"]).fit(df).transform(df).select("row_id", R("price"), R("quantity"))


def _yj_sql(x: str, lam: float) -> str:
    up = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}::DOUBLE) - 1) / {lam}::DOUBLE"
    down = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}::DOUBLE) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


@query(
    "yeo_johnson_fixed",
    S.with_(
        S.view("orders"),
        "SELECT row_id, "
        + ", ".join(f"round({_yj_sql('(balance / 1000.0::DOUBLE)', lam)}, 6) AS l{i}" for i, lam in enumerate((-0.5, 0.0, 0.7, 2.0)))
        + " FROM v",
    ),
)
def yeo_johnson_fixed(spark, sf):
    x = F.col("balance") / 1000.0
    return views.orders(spark, sf).select(
        "row_id", *[F.round(yeo_johnson(x, lam), 6).alias(f"l{i}") for i, lam in enumerate((-0.5, 0.0, 0.7, 2.0))]
    )


@query(
    "yeo_johnson_fit",
    L.materialized(
        S.view("lines") + L.best_power("v", "price", "lam_price") + L.best_power("v", "quantity", "lam_quantity")
        + [("far", "SELECT 1.0::DOUBLE - ln(1.0::DOUBLE + price / 1000.0::DOUBLE) AS price FROM v")] + L.best_power("far", "price", "lam_far"),
        "SELECT round(p.lam, 4) AS lambda_price, round(q.lam, 4) AS lambda_quantity, round(f.lam, 4) AS lambda_far FROM lam_price p, lam_quantity q, lam_far f",
    ),
)
def yeo_johnson_fit(spark, sf):
    """Lambda per column."""
    x = views.lines(spark, sf).select("row_id", "price", "quantity").withColumn("far", 1.0 - F.log(1.0 + F.col("price") / 1000.0))
    lam = fit_yeo_johnson(stable(x), ["price", "quantity", "far"])
    return spark.createDataFrame([tuple(lam.values())], "lambda_price double, lambda_quantity double, lambda_far double").select(
        *[R(f"lambda_{c}", 4) for c in lam]
    )


ANOVA_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(((sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2)) / (count(*) - 1))
        / (sum(n * s) / (sum(n) - count(*))), 6) AS f
        FROM (SELECT y, count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS s FROM ({views.LINES_SQL}) GROUP BY y)"""
    for c in LINES.num
)


@query("anova_f", ANOVA_SQL)
def anova_f_q(spark, sf):
    return anova_f(views.lines(spark, sf), LINES.num).select("feature", R("f"))


@query("pca_select")
def pca_select(spark, sf):
    """Principal components of the line items, best by ANOVA F."""
    df = views.lines(spark, sf)
    apply, cols = forest_model(LINES, n_components=4, k_best=2).space(df)
    return apply(df).select("row_id", F.transform(cols[0], lambda x: F.round(x, 6)).alias("components"))


OOF = S.view("orders") + [("tr", "SELECT * FROM v"), S.bin_stats(ORDERS)] + S.oof(ORDERS)


@query("oof_predict", S.with_(OOF, "SELECT row_id, y, fold, round(p1, 6) AS p1 FROM oof"))
def oof_predict(spark, sf):
    return NaiveBayes(ORDERS).oof(stable(views.orders(spark, sf))).select("row_id", "y", "fold", R("p1"))


LINE_OOF = S.view("lines") + [("tr", "SELECT * FROM v"), S.bin_stats(LINES)] + S.oof(LINES)


@query("oof_predict_lines", S.with_(LINE_OOF, "SELECT row_id, y, fold, round(p1, 6) AS p1 FROM oof"))
def oof_predict_lines(spark, sf):
    return NaiveBayes(LINES).oof(views.lines(spark, sf)).select("row_id", "y", "fold", R("p1"))


def _train_test(spark, sf, view, spec):
    split = stable(sampling.split_rows(view(spark, sf).select("row_id", "y", "protected", *spec.features)))
    return split.where("split = 'train'"), split.where("split = 'val'"), split.where("split = 'test'")


@query("model_logistic", L.predictions(DOCS, "docs"))
def model_logistic(spark, sf):
    frame = encode.factorize(stable(views.docs(spark, sf)), DOCS.cat)
    train, _, test = _train_test(spark, sf, lambda *_: frame, DOCS)
    out = logistic_model(DOCS).predict(train, test)
    return out.select("row_id", "y", "protected", R("p1", 3), "pred")


@query(
    "logistic_certificate",
    "SELECT unnest(['(intercept)', " + ", ".join(f"'{c}'" for c in DOCS.features) + "]) AS name, TRUE AS flat",
)
def logistic_certificate(spark, sf):
    """No slope of the penalised loss is left at the fitted coefficients: the one optimum."""
    frame = encode.factorize(stable(views.docs(spark, sf)), DOCS.cat)
    train, _, _ = _train_test(spark, sf, lambda *_: frame, DOCS)
    return logistic_model(DOCS).certificate(train).select("name", (F.abs("slope") < 1e-6).alias("flat"))


@query("model_forest")
def model_forest(spark, sf):
    frame = encode.factorize(stable(views.docs(spark, sf)), DOCS.cat)
    train, _, test = _train_test(spark, sf, lambda *_: frame, DOCS)
    out = forest_model(DOCS).predict(train, test)
    return out.select("row_id", "y", "protected", R("p1"), "pred")


@query("oof_predict_logistic", L.out_of_fold(DOCS, "docs"))
def oof_predict_logistic(spark, sf):
    frame = encode.factorize(stable(views.docs(spark, sf)), DOCS.cat)
    return logistic_model(DOCS).oof(frame).select("row_id", "y", "fold", R("p1", 3))


# ------------------------------------------------------------------ rankers

VEC_D2 = "list_sum(list_transform(range(1, 65), lambda i: (t.vec[i] - w.vec[i]) * (t.vec[i] - w.vec[i])))"
VECTOR_SPACE = S.split("vectors") + [
    ("t_sp", "SELECT row_id, y, vec FROM sp WHERE split = 'train'"),
    ("v_sp", "SELECT row_id AS vid, y AS vy, protected AS vp, vec FROM sp WHERE split = 'val'"),
]
FINE = shapley.FINE_STEPS
COARSE = shapley.COARSE_STEPS


def _vectors(spark, sf):
    split = stable(sampling.split_rows(views.vectors(spark, sf)))
    return split.where("split = 'train'"), split.where("split = 'val'")


def _recursion(k: int, worth: str = "CAST(y = vy AS DOUBLE)", last: str = "n") -> list[tuple[str, str]]:
    """The textbook recursion over strictly ordered neighbours, or over the first ``last`` of them, as if there were no others
    that are worth anything."""
    return VECTOR_SPACE + [
        ("d", f"SELECT vid, row_id, {worth} AS u, {VEC_D2} AS d2 FROM t_sp t, v_sp w"),
        ("o", "SELECT *, row_number() OVER (PARTITION BY vid ORDER BY d2, row_id) AS i, count(*) OVER (PARTITION BY vid) AS n FROM d"),
        ("e", f"SELECT *, u - lead(u, 1, 0) OVER (PARTITION BY vid ORDER BY i) AS du FROM o WHERE i <= {last}"),
        (
            "s",
            f"""SELECT row_id, sum(CASE WHEN i = {last} THEN u * least({k}, i) / ({k}.0::DOUBLE * i) ELSE du * least({k}, i) / ({k}.0::DOUBLE * i) END)
                OVER (PARTITION BY vid ORDER BY i DESC) AS s FROM e""",
        ),
    ]


def _knn_strict_sql(k: int, **how) -> str:
    return S.with_(_recursion(k, **how), "SELECT row_id, round(avg(s), 8) AS score FROM s GROUP BY row_id")


@query("knn_shapley", _knn_strict_sql(1))
def knn_shapley(spark, sf):
    train, val = _vectors(spark, sf)
    return shapley.knn_shapley(train, val, ["vec"]).select("row_id", R("score", 8))


@query("knn_shapley_k5", _knn_strict_sql(5))
def knn_shapley_k5(spark, sf):
    train, val = _vectors(spark, sf)
    return shapley.knn_shapley(train, val, ["vec"], k=5).select("row_id", R("score", 8))


@query(
    "knn_shapley_unscaled",
    _knn_strict_sql(1).replace(VEC_D2, f"1e20::DOUBLE * ({VEC_D2})"),
)
def knn_shapley_unscaled(spark, sf):
    """The same order from distances far from 1."""
    far = F.transform("vec", lambda x: x * 1e10)
    train, val = (part.withColumn("vec", far) for part in _vectors(spark, sf))
    return shapley.knn_shapley(train, val, ["vec"]).select("row_id", R("score", 8))


NEAR, NEAR_K = 50, 2
_SHARE = "(least({k}, {i}) / ({k}.0::DOUBLE * {i}))"


@query(
    "knn_shapley_truncated",
    S.with_(
        _recursion(NEAR_K)
        + [
            ("whole", "SELECT row_id, avg(s) AS score FROM s GROUP BY row_id"),
            (
                "s2",
                f"""SELECT row_id, u * {_SHARE.format(k=NEAR_K, i="i")}
                      + coalesce(sum(u * ({_SHARE.format(k=NEAR_K, i="i")} - {_SHARE.format(k=NEAR_K, i="greatest(i - 1, 1)")}))
                        OVER (PARTITION BY vid ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
                    FROM o WHERE i <= {NEAR}""",
            ),
            ("near_sums", "SELECT row_id, sum(s) / (SELECT count(*) FROM v_sp) AS score FROM s2 GROUP BY row_id"),
        ],
        f"""SELECT row_id, round(coalesce(b.score, 0), 8) + 0 AS score, round(a.score, 8) AS whole, abs(a.score - coalesce(b.score, 0)) <= 1.0 / {NEAR} AS within
            FROM whole a LEFT JOIN near_sums b USING (row_id)""",
    ),
)
def knn_shapley_truncated(spark, sf):
    """Only the nearest ranks, next to the whole values: no score is off by more than asked for."""
    train, val = _vectors(spark, sf)
    near = shapley.knn_shapley(train, val, ["vec"], k=NEAR_K, error=1 / NEAR)
    whole = shapley.knn_shapley(train, val, ["vec"], k=NEAR_K).withColumnRenamed("score", "whole")
    off = F.abs(F.col("whole") - F.col("score")) <= 1.0 / NEAR
    return near.join(whole, "row_id").select("row_id", R("score", 8), R("whole", 8), off.alias("within"))


# worth of a neighbour by its label (0 or 1) and that of the validation row
WORTH = {(0, 0): 1.0, (1, 0): -0.25, (0, 1): -1.5, (1, 1): 2.0}


@query(
    "knn_shapley_own_utility",
    _knn_strict_sql(3, worth="CASE " + " ".join(f"WHEN y = {y} AND vy = {v} THEN {w}" for (y, v), w in WORTH.items()) + " END"),
)
def knn_shapley_own_utility(spark, sf):
    train, val = _vectors(spark, sf)
    worth = lambda label: F.when(F.col("y") == 0, WORTH[label, 0]).otherwise(WORTH[label, 1])
    return shapley.knn_shapley(train, val, ["vec"], worth, k=3).select("row_id", R("score", 8))


ORDER_SPACE = S.corrupted("orders", ORDERS, "random_label") + [S.bin_stats(ORDERS)] + S.space(ORDERS)


def _order_space(spark, sf, kind="random_label"):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    train, _ = experiments.corrupt(split, ORDERS, kind, 0.2, 42)
    val = split.where("split = 'val'")
    model = NaiveBayes(ORDERS)
    apply, cols = model.space(train)
    return model, train, val, apply, cols


@query(
    "knn_shapley_orders",
    S.with_(ORDER_SPACE + S.pairs(4, COARSE) + S.shapley_values(S.ACC_UTIL), "SELECT row_id, round(score, 9) AS score FROM shap"),
)
def knn_shapley_orders(spark, sf):
    _, train, val, apply, cols = _order_space(spark, sf)
    return shapley.knn_shapley(apply(train), apply(val), cols, steps=COARSE).select("row_id", R("score", 9))


@query(
    "rank_by_shapley",
    S.with_(
        ORDER_SPACE + S.pairs(4, COARSE) + S.shapley_values(S.ACC_UTIL, k=3)
        + [("s12", "SELECT row_id, round(score, 12) AS score FROM shap"), S.ranked("s12", "score", "r", where=S.NOISY_IDS)],
        "SELECT row_id, rank, n_ranked FROM r",
    ),
)
def rank_by_shapley(spark, sf):
    _, train, val, apply, cols = _order_space(spark, sf)
    scores = shapley.knn_shapley(apply(train), apply(val), cols, k=3, steps=COARSE)
    return shapley.rank_by_shapley(scores, train.where("is_noisy")).select("row_id", "rank", "n_ranked")


@query(
    "dp_shapley",
    S.with_(
        S.corrupted("docs", DOCS, "group_label") + [S.bin_stats(DOCS)] + S.space(DOCS) + S.pairs(5, FINE)
        + S.predictions(DOCS) + S.shapley_values(S.parity_util()),
        "SELECT row_id, round(score, 9) AS score FROM shap",
    ),
)
def dp_shapley(spark, sf):
    split = stable(sampling.split_rows(views.docs(spark, sf)))
    train, _ = experiments.corrupt(split, DOCS, "group_label", 0.2, 42)
    model = NaiveBayes(DOCS)
    apply, cols = model.space(train)
    val = split.where("split = 'val'")
    pred = model.predict(train, val).select("row_id", "pred")
    scored = shapley.knn_shapley(apply(train), apply(val).join(pred, "row_id"), cols, "parity", steps=FINE)
    return scored.select("row_id", R("score", 9))


@query(
    "dp_heuristic",
    S.with_(
        S.view("lines") + S.heuristic("v") + [S.ranked("heur", "score", "r", True)],
        "SELECT row_id, round(score, 9) AS score, rank, n_ranked FROM r",
    ),
)
def dp_heuristic(spark, sf):
    out = fairness.rank_by_parity_impact(views.lines(spark, sf))
    return out.select("row_id", R("score", 9), "rank", "n_ranked")


def _order_oof(spark, sf):
    return stable(NaiveBayes(ORDERS).oof(stable(views.orders(spark, sf))))


@query("self_confidence", S.with_(OOF + S.issues(), "SELECT row_id, y, round(conf, 6) AS conf FROM cf"))
def self_confidence(spark, sf):
    return confident.self_confidence(_order_oof(spark, sf)).select("row_id", "y", R("conf"))


@query("confident_joint", S.with_(OOF + S.issues(), "SELECT given, suggested, n FROM joint"))
def confident_joint(spark, sf):
    return confident.confident_joint(_order_oof(spark, sf))


@query(
    "find_label_issues",
    S.with_(OOF + S.issues() + [S.ranked("iss", "score", "r")], "SELECT row_id, round(score, 6) AS score, rank, n_ranked FROM r"),
)
def find_label_issues(spark, sf):
    return confident.find_label_issues(_order_oof(spark, sf)).select("row_id", R("score"), "rank", "n_ranked")


@query(
    "find_label_issues_all_rows",
    S.with_(OOF + S.issues() + [S.ranked("cf", "conf", "r")], "SELECT row_id, rank, n_ranked FROM r"),
)
def find_label_issues_all_rows(spark, sf):
    return confident.find_label_issues(_order_oof(spark, sf), all_rows=True).select("row_id", "rank", "n_ranked")


@query(
    "entropy_rank",
    S.with_(OOF + [S.ENTROPY, S.ranked("ent", "score", "r", True)], "SELECT row_id, round(score, 6) AS score, rank, n_ranked FROM r"),
)
def entropy_rank(spark, sf):
    return confident.rank_by_entropy(_order_oof(spark, sf)).select("row_id", R("score"), "rank", "n_ranked")


@query(
    "random_rank",
    S.with_(
        S.view("lines"),
        " UNION ALL ".join(
            f"SELECT {s} AS seed, row_id, row_number() OVER (ORDER BY {S.hkey(f'shuffle:{s}')}, row_id) AS rank, count(*) OVER () AS n_ranked FROM v WHERE y = 1"
            for s in (100, 101, 102)
        ),
    ),
)
def random_rank(spark, sf):
    out = confident.rank_random(views.lines(spark, sf).where("y = 1"))
    return out.select("seed", "row_id", "rank", "n_ranked")


# ------------------------------------------------------------------ metrics

# the shipped flag stands in for a prediction
PRED_SQL = f"SELECT y, protected, CAST(quantity > 25 AS INT) AS pred, tax FROM ({views.LINES_SQL})"


def _predicted(spark, sf):
    return views.lines(spark, sf).withColumn("pred", (F.col("quantity") > 25).cast("int"))


@query("accuracy", f"SELECT tax, round(avg(CAST(pred = y AS DOUBLE)), 9) AS accuracy FROM ({PRED_SQL}) GROUP BY tax")
def accuracy(spark, sf):
    return _predicted(spark, sf).groupBy("tax").agg(F.round(metrics.accuracy(), 9).alias("accuracy"))


@query(
    "demographic_parity_gap",
    f"""SELECT tax, round(coalesce(abs(avg(pred) FILTER (protected) - avg(pred) FILTER (NOT protected)), 0), 9) AS dp_gap
        FROM ({PRED_SQL}) GROUP BY tax""",
)
def demographic_parity_gap(spark, sf):
    return _predicted(spark, sf).groupBy("tax").agg(F.round(metrics.demographic_parity_gap(), 9).alias("dp_gap"))


def _guarded_sql() -> str:
    """A scorer per order status, fitted on its rows; those of P have one label, and no row has status X."""
    ctes = S.corrupted("orders", ORDERS, "random_label")
    parts = []
    for status in ("F", "O"):
        own = [(f"tr_{status}", f"SELECT * FROM tr WHERE status = '{status}'"), S.bin_stats(ORDERS, f"tr_{status}")]
        own += S.predictions(ORDERS, f"tr_{status}", "test", f"pred_{status}")
        ctes += [(name.replace("bst", f"bst_{status}"), sql.replace(", bst", f", bst_{status}")) for name, sql in own]
        parts.append(
            f"""SELECT '{status}' AS status, round(avg(CAST(pred = y AS DOUBLE)), 9) AS accuracy,
                round(coalesce(abs(avg(pred) FILTER (protected) - avg(pred) FILTER (NOT protected)), 0), 9) AS dp_gap
                FROM test t JOIN pred_{status} p ON p.row_id = t.row_id"""
        )
    parts += [f"SELECT '{status}', NULL::DOUBLE, NULL::DOUBLE" for status in ("P", "X")]
    return S.with_(ctes, " UNION ALL ".join(parts))


@query("evaluate_guarded", _guarded_sql())
def evaluate_guarded(spark, sf):
    """Metrics of a model per order status; NULL without rows or with one label only."""
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    train, _ = experiments.corrupt(split, ORDERS, "random_label", 0.2, 42)
    test = split.where("split = 'test'")
    rows = []
    for status in ("F", "O", "P", "X"):
        own = train.where((F.col("status") == status) & ((F.col("y") == 0) | (F.col("status") != "P")))
        got = metrics.evaluate_guarded(NaiveBayes(ORDERS), own, test)
        rows.append((status, got["accuracy"], got["dp_gap"]))
    out = spark.createDataFrame(rows, "status string, accuracy double, dp_gap double")
    return out.select("status", R("accuracy", 9), R("dp_gap", 9))


@query(
    "baseline_eval",
    S.with_(
        S.corrupted("orders", ORDERS, "outlier") + [S.bin_stats(ORDERS)] + S.predictions(ORDERS, "tr", "test"),
        """SELECT round(avg(CAST(pred = y AS DOUBLE)), 9) AS accuracy,
           round(coalesce(abs(avg(pred) FILTER (protected) - avg(pred) FILTER (NOT protected)), 0), 9) AS dp_gap
           FROM test t JOIN pred p ON p.row_id = t.row_id""",
    ),
)
def baseline_eval(spark, sf):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    train, _ = experiments.corrupt(split, ORDERS, "outlier", 0.2, 42)
    scored = NaiveBayes(ORDERS).predict(train, split.where("split = 'test'"))
    return metrics.evaluate(scored).select(R("accuracy", 9), R("dp_gap", 9))


# --------------------------------------------------------------- experiments

CURVE_COLS = "method, seed, round(proportion, 2) AS proportion, n_cleaned, round(accuracy, 9) AS accuracy, round(dp_gap, 9) AS dp_gap"


def _curve(exp: experiments.Experiment) -> DataFrame:
    return exp.curve.select("method", "seed", R("proportion", 2), "n_cleaned", R("accuracy", 9), R("dp_gap", 9))


def _curve_sql(view: str, spec: Spec, kind: str, steps: int, methods=None) -> str:
    return S.with_(S.experiment(view, spec, kind, steps, methods), f"SELECT {CURVE_COLS} FROM crv")


CHEAP = ("fair_heuristic", "confident", "entropy", "random")


@query("cleaning_curve", _curve_sql("orders", ORDERS, "random_label", COARSE, CHEAP))
def cleaning_curve(spark, sf):
    return _curve(experiments.run_random_label(views.orders(spark, sf), ORDERS, methods=CHEAP))


@query("cleaning_curve_lines", _curve_sql("lines", LINES, "outlier", COARSE, ("entropy", "random")))
def cleaning_curve_lines(spark, sf):
    return _curve(experiments.run_outlier(views.lines(spark, sf), LINES, methods=("entropy", "random")))


@query(
    "random_mean_std",
    S.with_(
        S.experiment("orders", ORDERS, "group_label", COARSE, ("random",)),
        """SELECT method, round(proportion, 2) AS proportion, round(avg(accuracy), 9) AS accuracy_mean,
           round(stddev_pop(accuracy), 9) AS accuracy_std, round(avg(dp_gap), 9) AS dp_gap_mean,
           round(stddev_pop(dp_gap), 9) AS dp_gap_std FROM crv GROUP BY method, proportion""",
    ),
)
def random_mean_std(spark, sf):
    exp = experiments.run_group_label(views.orders(spark, sf), ORDERS, methods=("random",))
    cols = ("accuracy_mean", "accuracy_std", "dp_gap_mean", "dp_gap_std")
    return metrics.random_mean_std(exp.curve).select("method", R("proportion", 2), *[R(c, 9) for c in cols])


def _register_run(kind: str, name: str) -> None:
    @query(name, _curve_sql("docs", DOCS, kind, FINE))
    def run(spark, sf):
        return _curve(experiments.run_experiment(views.docs(spark, sf), DOCS, kind, shapley_steps=FINE))


for _kind, _name in (
    ("outlier", "run_outlier"),
    ("random_label", "run_random_label"),
    ("no_noise", "run_no_noise_control"),
    ("group_label", "run_group_label"),
    ("group_missing", "run_group_missing"),
    ("outlier_removal", "run_outlier_removal"),
):
    _register_run(_kind, _name)


@query(
    "run_methods",
    S.with_(
        S.corrupted("orders", ORDERS, "group_label") + S.rankings(ORDERS, S.ALL, COARSE),
        "SELECT method, seed, row_id, rank, n_ranked FROM rnk",
    ),
)
def run_methods(spark, sf):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    train, _ = experiments.corrupt(split, ORDERS, "group_label", 0.2, 42)
    out = experiments.rank_rows(
        NaiveBayes(ORDERS), train, split.where("split = 'val'"), experiments.RANKERS, shapley_steps=COARSE
    )
    return out.select("method", "seed", "row_id", "rank", "n_ranked")


# ------------------------------------------------- curves of the MLlib models


def _model_curve(spark, sf, model: str, kind: str) -> DataFrame:
    exp = experiments.run_experiment(
        views.docs(spark, sf), DOCS, kind, model=model, grid=[0.0, 0.5, 1.0], methods=("shapley", "random")
    )
    return _curve(exp)


FREE = ("fair_heuristic", "random")  # rankings that need no model


@query("curve_logistic", L.curve("docs", DOCS, "group_label", FREE))
def curve_logistic(spark, sf):
    """A fit for each of 21 points of each ranking, all at once."""
    return _curve(experiments.run_group_label(views.docs(spark, sf), DOCS, model="logistic", methods=FREE))


@query("curve_logistic_control", L.curve("docs", DOCS, "no_noise", FREE))
def curve_logistic_control(spark, sf):
    return _curve(experiments.run_no_noise_control(views.docs(spark, sf), DOCS, model="logistic", methods=FREE))


@query("curve_logistic_rankers")
def curve_logistic_rankers(spark, sf):
    return _curve(experiments.run_group_label(views.docs(spark, sf), DOCS, model="logistic"))


@query("curve_forest")
def curve_forest(spark, sf):
    return _model_curve(spark, sf, "forest", "outlier")


# ------------------------------------------------------------ groups of rows


def _group_sql(perms: int) -> str:
    spec = ORDERS
    return S.with_(
        S.split("orders")
        + [("tr", "SELECT * FROM sp WHERE split = 'train'"), ("val", "SELECT * FROM sp WHERE split = 'val'"), S.bin_stats(spec)]
        + [
            ("tb", f"SELECT segment AS grp, y, {S.bins(spec)} FROM tr, bst"),
            ("tl", S.unpivot("tb", spec, "grp, y")),
            ("gr", "SELECT grp, count(*) AS n_rows FROM tb GROUP BY grp"),
            (
                "pm",
                f"""SELECT p, grp, n_rows, row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws(':', 'perm:0', CAST(p AS VARCHAR), grp)), grp) AS pos
                    FROM gr CROSS JOIN range(0, {perms}) r(p)""",
            ),
            ("pt", f"SELECT p, q AS pos FROM range(0, {perms}) r(p), range(0, (SELECT count(*) + 1 FROM gr)) s(q)"),
            ("co", "SELECT pt.p, pt.pos, pm.grp FROM pt JOIN pm ON pm.p = pt.p AND pm.pos <= pt.pos"),
            ("cc", "SELECT p, pos, f, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM co JOIN tl USING (grp) GROUP BY ALL"),
            ("cn", "SELECT p, pos, count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM co JOIN tb USING (grp) GROUP BY ALL"),
            ("dm", "SELECT f, count(DISTINCT v)::DOUBLE AS nv FROM tl GROUP BY f"),
            ("vb", f"SELECT row_id, y, {S.bins(spec)} FROM val, bst"),
            ("vl", S.unpivot("vb", spec, "row_id, y")),
            (
                "sc",
                """SELECT pt.p, pt.pos, l.row_id, any_value(l.y) AS y,
                     CAST(round(sum(ln((coalesce(c1, 0) + 1.0::DOUBLE) / (coalesce(n1, 0) + nv)) - ln((coalesce(c0, 0) + 1.0::DOUBLE) / (coalesce(n0, 0) + nv)))
                       + any_value(ln((coalesce(n1, 0) + 1.0::DOUBLE) / (coalesce(n0, 0) + 1.0::DOUBLE))), 9) > 0 AS INT) AS pred
                   FROM pt CROSS JOIN vl l JOIN dm ON dm.f = l.f LEFT JOIN cn ON cn.p = pt.p AND cn.pos = pt.pos
                   LEFT JOIN cc ON cc.p = pt.p AND cc.pos = pt.pos AND cc.f = l.f AND cc.v = l.v GROUP BY pt.p, pt.pos, l.row_id""",
            ),
            ("ut", "SELECT p, pos, avg(CAST(pred = y AS DOUBLE)) AS u FROM sc GROUP BY p, pos"),
            ("gn", "SELECT p, pos, u - lag(u) OVER (PARTITION BY p ORDER BY pos) AS gain FROM ut"),
        ],
        "SELECT grp AS segment, round(avg(gain), 9) AS score, max(n_rows) AS n_rows FROM pm JOIN gn ON gn.p = pm.p AND gn.pos = pm.pos GROUP BY grp",
    )


@query("group_mc_shapley", _group_sql(10))
def group_mc_shapley(spark, sf):
    from rowmend.plans.groups import group_shapley

    train, val, _ = _train_test(spark, sf, views.orders, ORDERS)
    return group_shapley(train, val, ORDERS, "segment", n_perms=10).select("segment", R("score", 9), "n_rows")


# ----------------------------------------------------------- provenance


def _docs_run(spark, sf, kind, methods=None):
    return experiments.run_experiment(
        stable(views.docs(spark, sf)), DOCS, kind, methods=methods, shapley_steps=FINE
    )


def _outlier_train(spark, sf):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    return experiments.corrupt(split, ORDERS, "outlier", 0.2, 42)[0]


RECORD_SQL = S.with_(
    S.corrupted("orders", ORDERS, "outlier") + [(f"k_{c}", S.codes("tr", c)) for c in ORDERS.cat],
    """SELECT row_number() OVER (ORDER BY row_id) - 1 AS train_position, row_id AS dataset_index, is_noisy AS is_true_noisy,
       protected AS is_protected, y_clean AS clean_label, y AS noisy_label,
       round(price_clean, 4) AS clean_price, round(price, 4) AS noisy_price, balance,
       CAST(coalesce(a.code, -1) AS DOUBLE) AS status, CAST(coalesce(b.code, -1) AS DOUBLE) AS segment
       FROM tr LEFT JOIN k_status a ON a.k = tr.status LEFT JOIN k_segment b ON b.k = tr.segment""",
)


def _flat(records: DataFrame) -> DataFrame:
    return records.select(
        "train_position", "dataset_index", "is_true_noisy", "is_protected", "clean_label", "noisy_label",
        F.round(F.col("clean_features")[0], 4).alias("clean_price"),
        F.round(F.col("noisy_features")[0], 4).alias("noisy_price"),
        F.col("noisy_features")[1].alias("balance"),
        F.col("noisy_features")[2].alias("status"),
        F.col("noisy_features")[3].alias("segment"),
    )


@query("train_records", RECORD_SQL)
def train_records(spark, sf):
    return _flat(provenance.train_records(_outlier_train(spark, sf), ORDERS))


@query("record_sink", RECORD_SQL)
def record_sink(spark, sf):
    records = provenance.train_records(_outlier_train(spark, sf), ORDERS)
    path = scratch(spark, "records")
    store.write_records(records, path)
    return _flat(spark.read.schema(records.schema).json(path))


CACHE = S.corrupted("orders", ORDERS, "group_label") + S.rankings(ORDERS, ("confident", "entropy", "random"), COARSE)


def _order_rankings(spark, sf):
    split = stable(sampling.split_rows(views.orders(spark, sf)))
    train, _ = experiments.corrupt(split, ORDERS, "group_label", 0.2, 42)
    methods = ("confident", "entropy", "random")
    return stable(experiments.rank_rows(NaiveBayes(ORDERS), train, split.where("split = 'val'"), methods))


@query(
    "cleaned_cache",
    S.with_(
        CACHE,
        """SELECT method, seed, row_id, rank, round(min(g * 0.05::DOUBLE), 2) AS min_proportion FROM rnk, range(0, 21) r(g)
           WHERE rank <= floor(g * 0.05::DOUBLE * n_ranked) GROUP BY method, seed, row_id, rank""",
    ),
)
def cleaned_cache(spark, sf):
    cache = provenance.cleaned_cache(_order_rankings(spark, sf), repair.proportion_grid())
    return cache.withColumn("min_proportion", F.round("min_proportion", 2))


@query(
    "prefix_sizes",
    S.with_(
        CACHE,
        """SELECT method, seed, round(g * 0.05::DOUBLE, 2) AS proportion, CAST(floor(g * 0.05::DOUBLE * max(n_ranked)) AS BIGINT) AS n_cleaned
           FROM rnk, range(0, 21) r(g) GROUP BY method, seed, g""",
    ),
)
def prefix_sizes(spark, sf):
    out = provenance.prefix_sizes(_order_rankings(spark, sf), repair.proportion_grid())
    return out.withColumn("proportion", F.round("proportion", 2))


@query(
    "overlap_summary",
    S.with_(
        CACHE
        + [
            ("gg", "SELECT g, g * 0.05::DOUBLE AS p FROM range(0, 21) r(g)"),
            ("a", "SELECT g, row_id FROM rnk, gg WHERE method = 'entropy' AND rank <= floor(p * n_ranked)"),
            ("b", "SELECT g, row_id FROM rnk, gg WHERE method = 'confident' AND rank <= floor(p * n_ranked)"),
        ],
        """SELECT round(p, 2) AS proportion, na AS entropy_count, nb AS confident_count, ni AS intersection_count,
             round(CASE WHEN na + nb - ni > 0 THEN ni / (na + nb - ni)::DOUBLE ELSE 0 END, 9) AS jaccard
           FROM (SELECT gg.p, (SELECT count(*) FROM a WHERE a.g = gg.g) AS na, (SELECT count(*) FROM b WHERE b.g = gg.g) AS nb,
                   (SELECT count(*) FROM a JOIN b ON a.g = b.g AND a.row_id = b.row_id WHERE a.g = gg.g) AS ni FROM gg)""",
    ),
)
def overlap_summary(spark, sf):
    out = provenance.overlap_summary(_order_rankings(spark, sf), repair.proportion_grid(), "entropy", "confident")
    return out.withColumns({"proportion": F.round("proportion", 2), "jaccard": F.round("jaccard", 9)})


SAVED = ("shapley", "confident", "random")


def _saved_run(spark, sf, kind) -> str:
    """A run saved twice: first with other rankings, which must not stay."""
    path = scratch(spark, "results")
    frame = stable(views.docs(spark, sf))
    for methods in (("fair_heuristic",), SAVED):
        exp = experiments.run_experiment(frame, DOCS, kind, methods=methods)
        results.save_run(exp, DOCS, "docs", path, 0.2, "lang")
    return path


_POSITIONS = ("pos", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS train_position, is_noisy FROM tr")


@query(
    "summary_rows",
    S.with_(
        S.corrupted("docs", DOCS, "outlier") + S.rankings(DOCS, SAVED, FINE)
        + [
            _POSITIONS,
            ("gg", "SELECT g, g * 0.05::DOUBLE AS p FROM range(0, 21) r(g)"),
            ("a", "SELECT g, row_id FROM rnk, gg WHERE method = 'shapley' AND rank <= floor(p * n_ranked)"),
            ("b", "SELECT g, row_id FROM rnk, gg WHERE method = 'confident' AND rank <= floor(p * n_ranked)"),
        ],
        """SELECT 'noisy' AS part, '' AS method, 0 AS seed, train_position AS i, row_id AS j, 0.0::DOUBLE AS x FROM pos WHERE is_noisy
           UNION ALL SELECT 'ranking', method, seed, rank, row_id, train_position FROM rnk JOIN pos USING (row_id)
           UNION ALL SELECT 'cleaned', method, seed, rank, row_id, round(min(p), 2) FROM rnk, gg WHERE rank <= floor(p * n_ranked) GROUP BY method, seed, rank, row_id
           UNION ALL SELECT 'overlap', '', g, na, nb, round(CASE WHEN na + nb - ni > 0 THEN ni / (na + nb - ni)::DOUBLE ELSE 0 END, 9) FROM (
             SELECT gg.g, (SELECT count(*) FROM a WHERE a.g = gg.g) AS na, (SELECT count(*) FROM b WHERE b.g = gg.g) AS nb,
               (SELECT count(*) FROM a JOIN b ON a.g = b.g AND a.row_id = b.row_id WHERE a.g = gg.g) AS ni FROM gg)
           UNION ALL SELECT 'run', split, 0, count(*), 0, round((SELECT cap FROM cap), 6) FROM sp WHERE split IN ('train', 'val', 'test') GROUP BY split
           UNION ALL SELECT 'feature', f, 0, k - 1, 0, 0.2 FROM (SELECT unnest(["""
        + ", ".join(f"'{c}'" for c in DOCS.features) + "]) AS f, unnest(range(1, " + str(len(DOCS.features) + 1) + ")) AS k)",
    ),
)
def summary_rows(spark, sf):
    """All lists of a run's summary, read back from the normalised tables."""
    path = _saved_run(spark, sf, "outlier")
    get = lambda name: results.read(spark, path, name)
    zero, none = F.lit(0).cast("long"), F.lit("")
    ranked, overlap, runs = get("rankings"), get("overlap"), get("runs")
    parts = [
        get("noisy").select(F.lit("noisy"), none, F.lit(0), "train_position", "dataset_index", F.lit(0.0)),
        ranked.select(F.lit("ranking"), "method", "seed", "rank", "dataset_index", F.col("train_position").cast("double")),
        get("cleaned").select(F.lit("cleaned"), "method", "seed", "rank", "dataset_index", F.round("min_proportion", 2)),
        overlap.select(
            F.lit("overlap"), none, F.round(F.col("proportion") * 20).cast("int"), "shapley_count", "confident_count", F.round("jaccard", 9)
        ),
        runs.select(F.lit("run"), F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(0).alias("o"), F.col(f"n_{s}").alias("n")) for s in ("train", "val", "test")])),
                    zero, F.round("cap_value", 6)),
        get("features").crossJoin(F.broadcast(runs.select("level"))).select(F.lit("feature"), "name", F.lit(0), F.col("place").cast("long"), zero, "level"),
    ]
    out = parts[0].toDF("part", "method", "seed", "i", "j", "x")
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "control_summary",
    S.with_(
        S.experiment("docs", DOCS, "no_noise", FINE, SAVED),
        """SELECT round(proportion, 2) AS proportion, round(max((SELECT max(accuracy) FROM crv WHERE proportion = 0)), 9) AS baseline,
             round(max(accuracy) FILTER (method = 'shapley'), 9) AS shapley, round(max(accuracy) FILTER (method = 'confident'), 9) AS confident,
             round(avg(accuracy) FILTER (method = 'random'), 9) AS random_mean, round(stddev_pop(accuracy) FILTER (method = 'random'), 9) AS random_std
           FROM crv GROUP BY crv.proportion""",
    ),
)
def control_summary(spark, sf):
    """Curves of the run without noise, next to its baseline."""
    out = results.control_summary(spark, _saved_run(spark, sf, "no_noise"))
    return out.select(R("proportion", 2), *[R(c, 9) for c in ("baseline", "shapley", "confident", "random_mean", "random_std")])


@query("summary_sink")
def summary_sink(spark, sf):
    path = scratch(spark, "summary")
    exp = _docs_run(spark, sf, "outlier", ("shapley", "random"))
    summary = provenance.experiment_summary(exp, "docs")
    store.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


# --------------------------------------------------------------- reports

KINDS = ("outlier", "random_label", "group_label", "group_missing", "no_noise", "outlier_removal")
_STORES: dict[tuple[str, str], str] = {}


def _curves(spark, sf) -> DataFrame:
    """Curves of all noise types on the documents, written to the result
    store once per session and read back by every report."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        path = scratch(spark, "curves")
        frame = stable(views.docs(spark, sf))
        for kind in KINDS:
            exp = experiments.run_experiment(frame, DOCS, kind, shapley_steps=FINE)
            store.write_table(store.tagged(exp.curve, "docs", kind, "nb"), path)
        _STORES[key] = path
    return store.read_curves(spark, _STORES[key])


def _all_curves_sql() -> list[tuple[str, str]]:
    parts = []
    for kind in KINDS:
        one = S.with_(S.experiment("docs", DOCS, kind, FINE), "SELECT * FROM crv")
        parts.append(f"SELECT 'docs' AS dataset, '{kind}' AS noise_type, 'nb' AS model, x.* FROM ({one}) x")
    return [("c", " UNION ALL ".join(parts))]


FINALS = _all_curves_sql() + [
    ("mc", "SELECT dataset, noise_type, model, method, proportion, avg(accuracy) AS accuracy, avg(dp_gap) AS dp_gap FROM c GROUP BY ALL"),
    (
        "fin",
        """SELECT dataset, noise_type, model, method, min_by(accuracy, proportion) AS baseline, max_by(accuracy, proportion) AS final,
             min_by(dp_gap, proportion) AS baseline_dp, max_by(dp_gap, proportion) AS final_dp FROM mc GROUP BY ALL""",
    ),
]
K = "dataset, noise_type, model"


def _wide_sql(methods, value: str, base: str, base_name: str, digits: int = 4) -> str:
    cols = ", ".join(f"round(max({value}) FILTER (method = '{m}'), {digits}) AS {m}" for m in methods)
    return f"SELECT {K}, round(max({base}), {digits}) AS {base_name}, {cols} FROM fin GROUP BY {K}"


BEST = [
    ("cand", f"SELECT *, round(final, 9) AS f9, list_position(['shapley', 'confident', 'entropy', 'random'], method) AS o FROM fin WHERE method IN ('shapley', 'confident', 'entropy', 'random') AND final IS NOT NULL"),
    ("best", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY f9 DESC, o) AS r FROM cand"),
    ("bst1", f"SELECT {K}, method AS best, round(f9, 4) AS best_accuracy, round(f9 - baseline, 6) AS gain FROM best WHERE r = 1"),
]


@query("curves_from_store", S.with_(_all_curves_sql(), f"SELECT {K}, {CURVE_COLS} FROM c"))
def curves_from_store(spark, sf):
    c = _curves(spark, sf)
    return c.select(*reports.KEYS, "method", "seed", R("proportion", 2), "n_cleaned", R("accuracy", 9), R("dp_gap", 9))


@query("experiment_summary", S.with_(FINALS, _wide_sql(reports.ALL_METHODS, "final", "baseline", "baseline")))
def experiment_summary(spark, sf):
    return reports.experiment_summary(_curves(spark, sf))


@query("best_method", S.with_(FINALS + BEST, f"SELECT {K}, best, best_accuracy, gain FROM bst1"))
def best_method(spark, sf):
    return reports.best_method(_curves(spark, sf))


@query(
    "improvement_heatmap",
    S.with_(
        FINALS,
        "SELECT dataset, noise_type, "
        + ", ".join(f"round(avg(final - baseline) FILTER (method = '{m}'), 6) AS {m}" for m in ("shapley", "confident", "entropy"))
        + " FROM fin WHERE baseline > 0 AND final IS NOT NULL GROUP BY dataset, noise_type",
    ),
)
def improvement_heatmap(spark, sf):
    return reports.improvement_heatmap(_curves(spark, sf))


@query(
    "accuracy_table",
    S.with_(
        FINALS + BEST + [("wide", _wide_sql(reports.METHODS, "final", "baseline", "baseline"))],
        f"SELECT wide.*, best FROM wide LEFT JOIN bst1 USING ({K})",
    ),
)
def accuracy_table(spark, sf):
    return reports.accuracy_table(_curves(spark, sf))


@query(
    "top_gains",
    S.with_(FINALS + BEST, f"SELECT {K}, best, best_accuracy, gain FROM bst1 WHERE gain > -0.5 ORDER BY gain DESC, {K} LIMIT 4"),
)
def top_gains(spark, sf):
    return reports.top_gains(_curves(spark, sf), min_gain=-0.5, limit=4)


@query(
    "outlier_focus",
    S.with_(
        FINALS,
        """SELECT dataset, model, round(max(baseline) FILTER (noise_type = 'outlier'), 4) AS baseline,
           round(max(final) FILTER (noise_type = 'outlier' AND method = 'shapley'), 4) AS cap_final,
           round(max(final) FILTER (noise_type = 'outlier_removal' AND method = 'shapley'), 4) AS removal_final,
           round(max(final) FILTER (noise_type = 'outlier' AND method = 'random'), 4) AS random_final FROM fin GROUP BY dataset, model""",
    ),
)
def outlier_focus(spark, sf):
    return reports.outlier_focus(_curves(spark, sf))


@query(
    "no_noise_summary",
    S.with_(
        _all_curves_sql()
        + [
            ("n", "SELECT dataset, model, method, proportion, avg(accuracy) AS a, stddev_pop(accuracy) AS s FROM c WHERE noise_type = 'no_noise' GROUP BY ALL"),
            (
                "w",
                """SELECT dataset, model, proportion, round(max(a) FILTER (method = 'shapley'), 6) AS shapley,
                   round(max(a) FILTER (method = 'confident'), 6) AS confident, round(max(a) FILTER (method = 'entropy'), 6) AS entropy,
                   round(max(a) FILTER (method = 'random'), 6) AS random_mean, round(max(s) FILTER (method = 'random'), 6) AS random_std
                   FROM n GROUP BY ALL""",
            ),
        ],
        "SELECT * REPLACE (round(proportion, 2) AS proportion), first_value(shapley) OVER (PARTITION BY dataset, model ORDER BY proportion) AS baseline FROM w",
    ),
)
def no_noise_summary(spark, sf):
    return reports.no_noise_summary(_curves(spark, sf)).withColumn("proportion", F.round("proportion", 2))


@query("dp_summary", S.with_(FINALS, _wide_sql(reports.ALL_METHODS, "final_dp", "baseline_dp", "baseline_dp")))
def dp_summary(spark, sf):
    return reports.dp_summary(_curves(spark, sf))


# -------------------------------------------------------------- variants

OTSU = OOF + S.issues() + [
    ("mo", "SELECT count(*) AS n, avg(score) AS m, median(score) AS med FROM iss"),
    ("mm", "SELECT avg(pow(score - m, 2)) AS m2, avg(pow(score - m, 3)) AS m3, avg(pow(score - m, 4)) AS m4 FROM iss, mo"),
    ("bc", "SELECT (m3 * m3 / (m2 * m2 * m2) + 1) / (m4 / (m2 * m2)) AS bc FROM mm"),
    ("hb", "SELECT least(CAST(floor(score * 256) AS BIGINT), 255) AS bin, count(*) AS n FROM iss GROUP BY 1"),
    (
        "sp2",
        """SELECT h.bin, (SELECT sum(n) FROM hb x WHERE x.bin <= h.bin)::DOUBLE AS n0, (SELECT sum(n) FROM hb x WHERE x.bin > h.bin)::DOUBLE AS n1,
             (SELECT sum(n * (bin + 0.5::DOUBLE) / 256) FROM hb x WHERE x.bin <= h.bin) AS s0,
             (SELECT sum(n * (bin + 0.5::DOUBLE) / 256) FROM hb x WHERE x.bin > h.bin) AS s1 FROM hb h""",
    ),
    ("ot", "SELECT (bin + 1) / 256.0::DOUBLE AS otsu FROM sp2 WHERE n1 > 0 ORDER BY round(n0 / (n0 + n1) * n1 / (n0 + n1) * pow(s0 / n0 - s1 / n1, 2), 12) DESC, bin LIMIT 1"),
    ("thr", "SELECT CASE WHEN bc > 5.0::DOUBLE / 9 THEN otsu ELSE med END AS threshold, otsu, med AS median, bc FROM mo, bc, ot"),
]


@query("otsu_threshold", S.with_(OTSU, "SELECT round(threshold, 6) AS threshold, round(otsu, 6) AS otsu, round(median, 6) AS median, round(bc, 6) AS bc FROM thr"))
def otsu_threshold(spark, sf):
    from rowmend.plans.variants import otsu_threshold

    flagged = stable(confident.find_label_issues(_order_oof(spark, sf)))
    return otsu_threshold(flagged).select(R("threshold"), R("otsu"), R("median"), R("bc"))


@query(
    "adaptive_route",
    S.with_(
        OTSU,
        """SELECT v.row_id, CASE WHEN i.row_id IS NOT NULL THEN 1 - v.y ELSE v.y END AS y FROM v LEFT JOIN iss i ON i.row_id = v.row_id
           WHERE i.row_id IS NULL OR i.score >= (SELECT threshold FROM thr)""",
    ),
)
def adaptive_route(spark, sf):
    from rowmend.plans import variants

    flagged = stable(confident.find_label_issues(_order_oof(spark, sf)))
    threshold = variants.otsu_threshold(flagged).first()["threshold"]
    out = variants.adaptive_route(views.orders(spark, sf), flagged, threshold, repair.action_flip())
    return out.select("row_id", "y")


def _ref(table: str, id_col: str, n: int, salt: str, out: str) -> tuple[str, str]:
    return (out, f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {S.hkey(salt, id_col)}, {id_col}) AS rr FROM {table}) WHERE rr <= {n}")


KERNEL = S.corrupted("orders", ORDERS, "outlier") + S.space(ORDERS) + [
    _ref("v_sp", "vid", 500, "kval:0", "kv"),
    _ref("t_sp", "row_id", 2000, "ktrain:0", "kt"),
    ("k1", "SELECT t.row_id, avg(exp(-0.5::DOUBLE * (pow(t.z0 - w.z0, 2) + pow(t.z1 - w.z1, 2)))) AS s FROM t_sp t, kv w GROUP BY t.row_id"),
    ("k2", "SELECT t.row_id, avg(exp(-0.5::DOUBLE * (pow(t.z0 - w.z0, 2) + pow(t.z1 - w.z1, 2)))) AS s FROM t_sp t, kt w GROUP BY t.row_id"),
    ("ks", "SELECT row_id, k1.s - k2.s AS similarity FROM k1 JOIN k2 USING (row_id)"),
]


@query("kernel_similarity", S.with_(KERNEL, "SELECT row_id, round(similarity, 8) AS similarity FROM ks"))
def kernel_similarity(spark, sf):
    from rowmend.plans.variants import kernel_similarity

    _, train, val, apply, _ = _order_space(spark, sf, "outlier")
    return kernel_similarity(apply(train), apply(val), ORDERS.num).select("row_id", R("similarity", 8))


@query(
    "kernel_rank",
    S.with_(
        KERNEL + [("bst", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ORDERS.num) + " FROM val")]
        + S.predictions(ORDERS, "val", "tr", "vp")
        + [
            (
                "kb",
                """SELECT row_id, round(0.97::DOUBLE * similarity + (1 - 0.97::DOUBLE) * round(CASE WHEN y = 1 THEN p1 ELSE 1.0::DOUBLE - p1 END, 9), 12) AS score
                   FROM ks JOIN vp USING (row_id) JOIN tr USING (row_id)""",
            ),
            S.ranked("kb", "score", "r", where=S.NOISY_IDS),
        ],
        "SELECT row_id, round(score, 8) AS score, rank, n_ranked FROM r",
    ),
)
def kernel_rank(spark, sf):
    from rowmend.plans import variants

    model, train, val, apply, _ = _order_space(spark, sf, "outlier")
    similarity = variants.kernel_similarity(apply(train), apply(val), ORDERS.num)
    candidates = train.where("is_noisy").select("row_id")
    own = confident.self_confidence(model.predict(val, train)).join(candidates, "row_id", "left_semi")
    return variants.kernel_rank(similarity, own.select("row_id", "conf")).select("row_id", R("score", 8), "rank", "n_ranked")


HYBRID = (
    S.corrupted("docs", DOCS, "group_label") + [S.bin_stats(DOCS)] + S.space(DOCS) + S.pairs(5, FINE)
    + S.shapley_values(S.ACC_UTIL) + S.oof(DOCS) + S.issues()
    + [
        ("hc", f"SELECT s.row_id, -s.score AS a, 1 - cf.conf AS b FROM shap s JOIN cf ON cf.row_id = s.row_id WHERE s.{S.NOISY_IDS}"),
        ("hl", "SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM hc"),
        (
            "hs",
            """SELECT row_id, round(0.5::DOUBLE * CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 0 END
                 + (1 - 0.5::DOUBLE) * CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 0 END, 9) AS score FROM hc, hl""",
        ),
        S.ranked("hs", "score", "r", True),
    ]
)


@query("hybrid_rank", S.with_(HYBRID, "SELECT row_id, round(score, 6) AS score, rank, n_ranked FROM r"))
def hybrid_rank(spark, sf):
    from rowmend.plans.variants import hybrid_rank

    split = stable(sampling.split_rows(views.docs(spark, sf)))
    train, _ = experiments.corrupt(split, DOCS, "group_label", 0.2, 42)
    model = NaiveBayes(DOCS)
    apply, cols = model.space(train)
    scores = shapley.knn_shapley(apply(train), apply(split.where("split = 'val'")), cols, steps=FINE)
    own = confident.self_confidence(model.oof(train))
    out = hybrid_rank(scores, own, train.where("is_noisy"))
    return out.select("row_id", R("score"), "rank", "n_ranked")


@query(
    "detect_noise_type",
    S.with_(
        S.corrupted("orders", ORDERS, "outlier") + [S.bin_stats(ORDERS)] + S.space(ORDERS) + S.oof(ORDERS) + S.issues()
        + [
            ("dr", "SELECT row_id, row_number() OVER (ORDER BY conf, row_id) <= floor(0.2::DOUBLE * count(*) OVER ()) AS fl FROM cf"),
            ("dz", "SELECT t.*, fl FROM t_sp t JOIN dr ON dr.row_id = t.row_id"),
            (
                "da",
                """SELECT avg(CAST(abs(z0) > 3 OR abs(z1) > 3 AS DOUBLE)) FILTER (fl) AS anomaly,
                     1 - (var_pop(z0) FILTER (fl) + var_pop(z1) FILTER (fl)) / (var_pop(z0) + var_pop(z1)) AS clustering FROM dz""",
            ),
            (
                "dn",
                """SELECT *, CASE WHEN anomaly >= 0.25 THEN CASE WHEN clustering < 0.30 THEN 'outlier' ELSE 'group_missing' END
                     ELSE CASE WHEN clustering >= 0.30 THEN 'group_label' ELSE 'random_label' END END AS noise_type FROM da""",
            ),
        ],
        """SELECT round(anomaly, 6) AS anomaly, round(clustering, 6) AS clustering, noise_type,
           CASE noise_type WHEN 'outlier' THEN 'kernel' WHEN 'group_label' THEN 'shapley' ELSE 'confident' END AS ranker FROM dn""",
    ),
)
def detect_noise_type(spark, sf):
    from rowmend.plans.variants import detect_noise_type

    model, train, _, apply, _ = _order_space(spark, sf, "outlier")
    own = confident.self_confidence(model.oof(train))
    out = detect_noise_type(apply(train), own, ORDERS.num)
    return out.select(R("anomaly"), R("clustering"), "noise_type", "ranker")
