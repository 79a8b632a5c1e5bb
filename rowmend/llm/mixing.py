"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in random order, gone through up to
``epochs`` times.  A document's virtual finish time is the words its source
has sent, itself included, divided by the source's target.  The mix is the
documents by virtual finish time until the budget is spent, so at any moment
all sources have come equally far towards their targets.  The document that a
source is sending at virtual time 1, when its target is met, is cut there.

Nulls: a null text has no words and is never taken; a null source is a source
of its own, sorted last; a null id is allowed.  An empty table gives an empty
mix.  Repeated rows are separate documents with the same place in the queue
order (ties are summed together, see ``queue``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmend.core import stable

WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, target.  ``sizes`` has one row per source.

    The targets are min(cap, level * weight) with the one level that spends
    the budget: where handing out the excess again and again ends.  The rows
    here are sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(kinds, F.expr(f"cast((rank - 1) % {len(weights)} + 1 as int)")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    # the first source, by cap to weight, that the level doesn't fill ends the filling
    ranked = ranked.withColumn("open", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    ranked = ranked.withColumn("open", F.first("open", ignorenulls=True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 17,
    bin_rows: int = 100_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each document.

    docs: doc_id, source, text.  Each queue is cut into pieces by the random key,
    of about ``bin_rows`` rows were all in one source, so that a source with a
    third of all rows is added up by many tasks; only the sums of the pieces meet.
    """
    sized = stable(docs.select("doc_id", "source", n_words().alias("size")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stable(targets(sums, weights, share, epochs))
    bins = 1 + sized.count() // bin_rows
    queued = queue(sized.where("size > 0"), goal, epochs, seed, max(bins, 64))
    budget = goal.agg(F.sum("target").alias("budget"))
    picked = by_finish_time(queued, budget)
    # a document's own row and its takings are added up by key, so repeated and null ids are safe
    none = F.lit(0).cast("long")
    takings = (
        picked.select("doc_id", "source", "size", "words", none.alias("rows"))
        .unionByName(sized.select("doc_id", "source", "size", none.alias("words"), F.lit(1).cast("long").alias("rows")))
        .groupBy("doc_id", "source", "size")
        .agg(F.sum("words").alias("words"), F.sum("rows").alias("rows"))
    )
    each = takings.select("*", F.explode(F.expr("sequence(1L, rows)")).alias("k")).select(
        "doc_id", "source", "size", F.expr("words div rows + if(k <= words % rows, 1, 0)").alias("taken")
    )
    named = goal.withColumnRenamed("source", "s")
    return each.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def queue(sized: DataFrame, goal: DataFrame, epochs: int, seed: int, bins: int) -> DataFrame:
    """Each document once per epoch, with its virtual finish time."""
    rounds = sized.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rounds = rounds.withColumn("key", key)
    rounds = rounds.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / 2**32).cast("int"))
    sums = rounds.groupBy("source", "epoch", "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("epoch", "bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bin").alias("b"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"),
    )
    offsets = offsets.join(goal.select(F.col("source").alias("g"), "target"), F.col("s").eqNullSafe(F.col("g"))).drop("g")
    own = Window.partitionBy("source", "epoch", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = rounds.withColumn("run", F.sum("size").over(own))
    placed = run.join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bin") == F.col("b"))
    )
    sent = F.col("offset") + F.col("run")
    left = F.ceil("target").cast("long") - (sent - F.col("size"))
    return placed.where(left > 0).select(
        "doc_id", "source", "size", "key", F.least("size", left).alias("words"),
        F.least(F.lit(1.0), sent / F.col("target")).alias("finish"),
    )


def by_finish_time(queued: DataFrame, budget: DataFrame) -> DataFrame:
    """The documents in order of finish time that begin within the budget: a
    range sort, the sums of its partitions, then running sums inside each."""
    spark = queued.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "key", "source", "doc_id", "size"]
    ordered = stable(
        stable(queued).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    sums = ordered.groupBy("part").agg(F.sum("words").alias("part_words"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("start"))
    starts = starts.crossJoin(F.broadcast(budget))  # one row
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ordered.join(F.broadcast(starts), F.col("part") == F.col("p")).withColumn(
        "begin", F.col("start") + F.coalesce(F.sum("words").over(own), F.lit(0))
    )
    return run.where("begin < budget")
