"""Suffixes in order, in buckets that splitters from a sample cut out.

A suffix is a row of tokens: 64-bit hashes of pieces of its text, each piece
containing the one before, so that equal texts are equal tokens.  Buckets are
ranges of token rows, and of the rows' own places where tokens are equal: a
text that a third of all suffixes share is spread over many buckets.  Each
bucket sorts its suffixes by multikey quicksort (by the first token, then the
runs of equal ones by the next) and compares neighbours; the first and last
suffixes of the buckets are then compared across the boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.core import stable

from .packed import discard

BUCKET_ROWS = 300_000


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, and only runs of equals by the next, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    tied = None
    for depth in range(1, len(keys)):
        same = keys[depth - 1][order][1:] == keys[depth - 1][order][:-1]
        tied = same if tied is None else tied & same
        run = np.r_[False, tied] | np.r_[tied, False]
        places = np.flatnonzero(run)
        if not len(places):
            break
        group = np.cumsum(~np.r_[False, tied])[places]
        rows = order[places]
        order[places] = rows[np.lexsort((keys[depth][rows], group))]
    return order


def neighbours(rows: DataFrame, core: str, tokens: list[str], place: list[str], n_rows: int) -> DataFrame:
    """Adds, for every suffix with another that has the same ``core`` token:
    ``least`` and ``many`` (the smallest first place column among those equal in
    all tokens, and whether there are two or more) and ``mixed`` (whether some
    have the same core and other tokens).  Suffixes with a core of their own are dropped.

    ``place``: columns that tell suffixes apart, the document's first."""
    keys = [core, *tokens]
    all_keys = [*keys, *place]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n_rows // BUCKET_ROWS)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in all_keys)
    none = np.iinfo(np.int64).max

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        cols = [table.column(c).to_numpy() for c in keys]
        doc = table.column(place[0]).fill_null(none).to_numpy()
        order = multikey_sort([*cols, doc])
        cols, doc = [c[order] for c in cols], doc[order]
        same_core = cols[0][1:] == cols[0][:-1]
        same = same_core.copy()
        for c in cols[1:]:
            same &= c[1:] == c[:-1]
        n = len(doc)
        run = np.cumsum(np.r_[True, ~same]) - 1
        first = np.flatnonzero(np.r_[True, ~same])
        least = doc[first][run]
        many = (np.diff(np.r_[first, n]) > 1)[run]
        core_run = np.cumsum(np.r_[True, ~same_core]) - 1
        core_first = np.flatnonzero(np.r_[True, ~same_core])
        kinds = np.bincount(core_run[first], minlength=len(core_first))
        mixed = (kinds > 1)[core_run]
        # runs that touch a border may go on beyond it
        edge = (core_run == 0) | (core_run == core_run[-1])
        keep = np.flatnonzero(edge | mixed | many)
        border = np.zeros(n, bool)
        border[[0, -1]] = True
        out = table.take(pa.array(order[keep]))
        for lo in range(0, len(keep), 200_000):
            part, k = out.slice(lo, 200_000).combine_chunks(), keep[lo : lo + 200_000]
            arrays = [part.column(c).combine_chunks() for c in all_keys]
            arrays += [pa.array(least[k]), pa.array(many[k]), pa.array(mixed[k]), pa.array(border[k])]
            yield pa.RecordBatch.from_arrays(arrays, [*all_keys, "least", "many", "mixed", "border"])

    ranged = rows.select(*all_keys).repartitionByRange(parts, *all_keys)
    found = stable(
        ranged.mapInArrow(local, schema + ", least long, many boolean, mixed boolean, border boolean")
        .withColumn("part", F.spark_partition_id())
    )
    # across the boundaries: two suffixes from each bucket say which runs go on, and how they began
    ends = found.where("border")
    by_run, by_core = Window.partitionBy(*keys), Window.partitionBy(core)
    parts_of = lambda w: F.min("part").over(w) != F.max("part").over(w)
    ends = ends.select(
        *keys, F.min("least").over(by_run).alias("_least"), parts_of(by_run).alias("_on"),
        (parts_of(by_core) & ((F.min(tokens[0]).over(by_core) != F.max(tokens[0]).over(by_core)) | F.max("mixed").over(by_core))).alias("_mixed"),
        parts_of(by_core).alias("_core_on"),
    ).distinct()
    runs = ends.where("_on").groupBy(*[F.col(k).alias(f"_run_{k}") for k in keys]).agg(F.min("_least").alias("_least"))
    cores = ends.where("_core_on").groupBy(F.col(core).alias("_core")).agg(F.max("_mixed").alias("_mixed"))
    same_run = F.lit(True)
    for k in keys:
        same_run = same_run & (F.col(k) == F.col(f"_run_{k}"))
    # at most two runs of a bucket are asked for, so both tables have at most two rows for each bucket
    whole = found.join(F.broadcast(runs), same_run, "left").join(F.broadcast(cores), F.col(core) == F.col("_core"), "left")
    whole = whole.withColumn("least", F.least("least", F.coalesce("_least", "least"))).withColumn("many", F.col("many") | F.col("_least").isNotNull())
    whole = whole.withColumn("mixed", F.col("mixed") | F.coalesce("_mixed", F.lit(False)))
    cols = [*all_keys, "least", "many", "mixed"]
    out = stable(whole.select(*cols).where("many or mixed"))
    discard(found)
    return out
