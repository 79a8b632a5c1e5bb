"""Shared contract: the row layout every operator expects, and the few
helpers that touch the session.

A *frame* is a DataFrame with a unique ``row_id`` (long), a binary label ``y``
(int), a ``protected`` flag (boolean) and feature columns.  Missing values are
NULL; NaN is turned into NULL on the way in, because Spark aggregates would
otherwise propagate it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup is broadcast only after its size was checked against both.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 50_000_000


@dataclass(frozen=True)
class Spec:
    """Column roles of a frame (names only, no data)."""

    num: tuple[str, ...]
    cat: tuple[str, ...] = ()
    outlier: str | None = None

    @property
    def features(self) -> tuple[str, ...]:
        return self.num + self.cat

    @staticmethod
    def from_schema(df: DataFrame, outlier: str | None = None) -> "Spec":
        """Numeric columns and string columns of a frame, by data type."""
        reserved = {"row_id", "y", "y_clean", "protected", "split", "is_noisy"}
        fields = [f for f in df.schema.fields if f.name not in reserved]
        return Spec(
            num=tuple(f.name for f in fields if isinstance(f.dataType, T.NumericType)),
            cat=tuple(f.name for f in fields if isinstance(f.dataType, T.StringType)),
            outlier=outlier,
        )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one
    only when the session runs in local mode and names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="rowmend-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise a frame that later steps read more than once.

    The frame becomes a Parquet table in the shared checkpoint folder: a lost
    executor neither loses rows nor recomputes them with different low-order
    bits between two passes, and readers still prune columns and rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a frame that comes from fewer files than cores; a
    frame of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def in_parallel(*steps: Callable[[], object], threads: int = 6) -> list:
    """Run independent driver steps at the same time, so that their jobs share
    the cluster instead of queueing behind one another."""
    with ThreadPoolExecutor(max(1, min(threads, len(steps)))) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def broadcastable(table: DataFrame, by: str, text: str, row_bytes: int = 0) -> set:
    """Groups of a lookup table that are small enough to broadcast, by rows
    and by the characters of their text column and ``row_bytes`` for each row."""
    sizes = table.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(text).cast("long")).alias("chars")
    )
    fits = (F.col("n") <= BROADCAST_ROWS) & (F.coalesce("chars", F.lit(0)) + F.col("n") * row_bytes <= BROADCAST_CHARS)
    return {r[by] for r in sizes.where(fits).select(by).collect()}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )
