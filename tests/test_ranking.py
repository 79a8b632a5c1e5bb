import pytest
from pyspark.sql import functions as F

from rowmend.functions import harmonic, order_key
from rowmend.operators import ranking
from rowmend.operators.encode import median_of
from rowmend.operators.sampling import exact_sample, split_rows, stratified_folds


def expected_order(rows):
    return {r: i + 1 for i, (_, r) in enumerate(sorted((s, r) for r, s in rows))}


@pytest.mark.parametrize("per_bucket", [100, 10_000_000])
def test_score_rank_with_a_value_on_a_third_of_the_rows(spark, per_bucket):
    df = spark.range(3000).select(
        (F.col("id") * 7 % 3001).alias("row_id"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise((F.col("id") * 13 % 997) / 997.0).alias("s"),
    )
    want = expected_order([(r["row_id"], r["s"]) for r in df.collect()])
    ranked = ranking.score_rank(df, "s", rows_per_bucket=per_bucket)
    assert {r["row_id"]: r["rank"] for r in ranked.collect()} == want


def test_score_rank_spreads_the_tied_rows(spark):
    """The tied third must not be numbered in one window partition."""
    df = spark.range(9000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("s"))
    plan = ranking.score_rank(df, "s", rows_per_bucket=500)
    by_row = plan.withColumn("p", F.spark_partition_id()).where("s = 1").select("p").distinct().count()
    assert by_row > 1


def test_score_rank_descending_by_group(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"), (F.col("id") * 31 % 101).cast("double").alias("s")
    )
    got = ranking.score_rank(df, "s", by=["y"], descending=True, rows_per_bucket=50).collect()
    for y in (0, 1):
        rows = [(r["row_id"], -r["s"], r["rank"]) for r in got if r["y"] == y]
        want = expected_order([(r, s) for r, s, _ in rows])
        assert {r: k for r, _, k in rows} == want


def test_score_rank_with_other_columns(spark):
    """NULL scores and groups, ids that groups share, and columns that stay out of the sort."""
    rows = [(k % 50, "a" if k < 50 else None if k < 100 else "b", None if k % 3 == 0 else float(k * 7 % 11), f"text {k}") for k in range(150)]
    df = spark.createDataFrame(rows, "row_id bigint, g string, s double, payload string").repartition(4)
    ranked = ranking.score_rank(df, "s", by=["g"], rows_per_bucket=20)
    got = {(r["g"], r["row_id"]): (r["rank"], r["payload"]) for r in ranked.collect()}
    for g in ("a", "b", None):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[g, r[0]] for r in order] == [(i + 1, r[3]) for i, r in enumerate(order)]
    text = ranked._jdf.queryExecution().toString()
    assert not any("payload" in line for line in text.splitlines() if "rangepartitioning" in line.lower())


def test_score_rank_of_nothing(spark):
    df = spark.createDataFrame([], "row_id bigint, s double")
    assert ranking.score_rank(df, "s", total_col="n").count() == 0


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 17 / 17.0).alias("s"))
    seen = []
    for n in (1, 4, 16):
        part = df.repartition(n)
        a = sorted((r["row_id"], r["rank"]) for r in ranking.score_rank(part, "s", rows_per_bucket=100).collect())
        b = sorted((r["row_id"], r["rank"]) for r in ranking.hash_rank(part, "x").collect())
        seen.append((a, b))
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("collect_rows", [1, 50_000])
def test_first_rows_refines_large_buckets(spark, monkeypatch, collect_rows):
    monkeypatch.setattr(ranking, "COLLECT_ROWS", collect_rows)
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    total, cuts = ranking.first_rows(df, "salt", lambda n: [0, 1, 7_777, n])
    assert total == 20_000
    order = [r["row_id"] for r in df.orderBy(order_key("salt"), "row_id").collect()]
    for cut, k in zip(cuts, (0, 1, 7_777, 20_000)):
        got = {r["row_id"] for r in df.where(cut.holds("salt")).collect()}
        assert got == set(order[:k])


def test_split_sizes(spark):
    for n, cap, want in ((891, 1000, (623, 89, 179)), (1000, 1000, (700, 100, 200)), (1000, 40, (700, 40, 200))):
        out = split_rows(spark.range(n).withColumnRenamed("id", "row_id"), val_cap=cap)
        got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert (got["train"], got["val"], got["test"]) == want
        assert sum(got.values()) == n


def test_sample_is_a_predicate_without_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    out = df.where(exact_sample(df, 0.25))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert out.count() == 250


def test_folds_are_balanced(spark):
    df = spark.range(503).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    counts = stratified_folds(df).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_no_row_level_sort_in_one_task(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 7 / 7.0).alias("s"))
    for plan in (ranking.score_rank(df, "s", rows_per_bucket=500), ranking.hash_rank(df, "x")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:  # only the bucket counts meet in one task
                assert "HashAggregate" in lines[i + 1] and "count(1)" in lines[i + 1]
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_harmonic(spark):
    got = spark.range(0, 3000).select("id", harmonic(F.col("id")).alias("h")).collect()
    total = 0.0
    for r in got:
        if r["id"]:
            total += 1.0 / r["id"]
        assert abs(r["h"] - total) < 1e-12


@pytest.mark.parametrize("collect_rows", [3, 50_000])
def test_exact_median(spark, collect_rows):
    import statistics

    for n in (1, 2, 7, 1000, 4001):
        rows = [(i, float((i * 7919) % 1009), 5.0 if i % 3 else float(i), None) for i in range(n)]
        df = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double")
        got = median_of(df, ["a", "b", "c"], collect_rows=collect_rows)
        assert got["a"] == statistics.median(r[1] for r in rows)
        assert got["b"] == statistics.median(r[2] for r in rows)
        assert got["c"] is None
