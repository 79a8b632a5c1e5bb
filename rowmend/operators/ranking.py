"""Exact global ranks and exact prefixes without a one-task sort.

An un-partitioned window would send every row to one task.  Both helpers cut
the order into buckets first, count the buckets (a small table), and number
rows only inside their bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import stable
from ..functions import order_key

PREFIX = 3  # hexadecimal digits per bucket level: 4096 buckets
LEAST_ROWS = 10_000  # smaller inputs are not spread over more cores
COLLECT_ROWS = 50_000  # a boundary bucket is read by the driver only below this


# ------------------------------------------------------------ hash prefixes


@dataclass(frozen=True)
class Cut:
    """The first ``size`` rows in order-key order.

    Ids are unique and the key is 128 bits long, so the key of the last row is
    enough; a single comparison also keeps the digest to one per row.
    """

    size: int
    key: str | None = None
    everything: bool = False

    def holds(self, salt: str, row_id: str = "row_id") -> Column:
        if self.everything:
            return F.lit(True)
        if self.key is None:
            return F.lit(False)
        return order_key(salt, row_id) <= self.key


def first_rows(
    df: DataFrame, salt: str, sizes: Callable[[int], Sequence[int]]
) -> tuple[int, list[Cut]]:
    """Cut points of the hash order, found by radix selection.

    One pass counts rows per key prefix; only the bucket that holds a cut is
    looked at again, so no row is shuffled and the result is a predicate that
    a scan can evaluate row by row.  ``sizes`` maps the row count to the
    wanted prefix lengths.  Returns the row count and one cut per length.
    """
    keyed = df.select("row_id", order_key(salt).alias("h"))

    def counts(prefix: str, digits: int) -> list[tuple[str, int]]:
        part = keyed.where(F.col("h").startswith(prefix)) if prefix else keyed
        rows = part.groupBy(F.substring("h", 1, digits).alias("b")).count().collect()
        return sorted((r["b"], r["count"]) for r in rows)

    top = counts("", PREFIX)
    total = sum(c for _, c in top)

    def bucket_of(table, rest: int) -> tuple[str, int, int]:
        for bucket, c in table:
            if rest <= c:
                return bucket, c, rest
            rest -= c
        raise ValueError("row count changed between two passes over the input")

    sizes_wanted = [int(k) for k in sizes(total)]
    # boundary bucket per cut; refined by longer prefixes until it is small
    at = {}
    for k in sizes_wanted:
        if 0 < k < total:
            digits, (bucket, c, rest) = PREFIX, bucket_of(top, k)
            while c > COLLECT_ROWS and digits < 30:
                digits += PREFIX
                bucket, c, rest = bucket_of(counts(bucket, digits), rest)
            at[k] = (bucket, rest)
    found = {}
    if at:
        wanted = F.lit(False)
        for bucket, _ in at.values():
            wanted = wanted | F.col("h").startswith(bucket)
        rows = sorted(r["h"] for r in keyed.where(wanted).select("h").collect())
        for k, (bucket, rest) in at.items():
            found[k] = [h for h in rows if h.startswith(bucket)][rest - 1]

    def cut(k: int) -> Cut:
        if k <= 0:
            return Cut(0)
        return Cut(k, found[k]) if k < total else Cut(total, everything=True)

    return total, [cut(k) for k in sizes_wanted]


def hash_rank(
    df: DataFrame, salt: str | Column, by: Sequence[str] = (), rank_col: str = "rank"
) -> DataFrame:
    """Exact 1..N rank of every row in hash order, within ``by``.

    Buckets are key prefixes: uniform and independent of the data, so no
    sampling pass is needed.  ``by`` must be a column set of few values.
    """
    groups = list(by)
    keyed = df.withColumn("_h", order_key(salt)).withColumn("_b", F.substring("_h", 1, PREFIX))
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # at most 4096 rows per group of ``by``
    offsets = (
        keyed.groupBy(*groups, "_b")
        .count()
        .select(*groups, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_h", "row_id")
    return (
        keyed.join(F.broadcast(offsets), [*groups, "_b"], "left")
        .withColumn(rank_col, F.col("_off") + F.row_number().over(inside))
        .drop("_h", "_b", "_off")
    )


# ------------------------------------------------------------- score ranks


def score_rank(
    df: DataFrame,
    score: str,
    by: Sequence[str] = (),
    descending: bool = False,
    rank_col: str = "rank",
    rows_per_bucket: int = 250_000,
    total_col: str | None = None,
) -> DataFrame:
    """Exact 1..N rank by (score, row_id), within ``by``; NULL scores come first.

    Only ids, groups and scores are put in order: range partitions, whose borders lie
    between (score, row_id) pairs, so that a score or a NULL that many rows share is
    spread along ``row_id``; their number comes from the number of rows.  A row's place is
    its place in its partition behind the rows of all partitions before, a table with a row
    for each partition.  Other columns are joined by ``row_id`` (unique within ``by``) afterwards, if there are any.
    ``by`` must be a column set of few values.
    """
    groups, spark = list(by), df.sparkSession
    whole = set(df.columns) <= {"row_id", score, *groups}
    kept = df.columns if whole else [*groups, "row_id"]
    value = F.lit(0.0) - F.col(score) if descending else F.col(score) + 0.0
    narrow = stable(df.select(*kept, value.alias("_s")))
    n = narrow.count()
    parts = max(1, -(-n // rows_per_bucket), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    order = [F.col(c).asc_nulls_first() for c in (*groups, "_s", "row_id")]
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition and place in it; stored, so that all passes see the same ones
    placed = stable(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.col("_at") - F.shiftleft(F.col("_p"), 33)
    ranked = placed.join(F.broadcast(offsets), "_p").withColumn("_pos", F.col("_off") + within + 1)
    if groups:
        firsts = ranked.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.min("_pos").alias("_first"))
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        ranked = ranked.join(F.broadcast(firsts), same).withColumn("_pos", F.col("_pos") - F.col("_first") + 1)
    ranked = ranked.withColumn(rank_col, F.col("_pos"))
    if whole:
        out = ranked.select(*kept, rank_col)
    else:
        names = {c: f"_k_{c}" for c in ("row_id", *groups)}
        same = F.lit(True)
        for c, k in names.items():
            same = same & df[c].eqNullSafe(F.col(k))
        keyed = ranked.select(*[F.col(c).alias(k) for c, k in names.items()], F.col(rank_col).alias("_rank"))
        out = df.join(keyed, same).withColumn(rank_col, F.col("_rank")).drop(*names.values(), "_rank")
    return out.withColumn(total_col, F.lit(n).cast("long")) if total_col else out
