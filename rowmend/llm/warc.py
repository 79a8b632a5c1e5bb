"""WARC archives: writing them, and reading them back by boundary chains.

An archive is split among tasks at any byte.  Where a record really begins
cannot be told locally, as a payload may itself hold the magic line of a
record.  So tasks emit, for every place where the magic line stands, a
candidate: its offset and the offset where the next record would begin by its
Content-Length.  Pointer jumping from the start of each file then keeps the
candidates that the chain reaches; magic lines inside payloads are not.

Nulls: a null payload is an empty one; a null url is left out of the header; a
null page id is written as an empty id and read back as null.  Repeated rows
give one record each.  An empty table gives an archive without records.
Texts are UTF-8; a single record has to fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmend.core import BROADCAST_ROWS, stable

from .packed import stored

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"  # after each record's block, and as the writer's line separator
SALTS = 16

# RFC 4648
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits, which are 8 letters, at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads of at least ``least_bytes`` the one with the
    largest id is the response.  A payload that a third of all records share
    is counted before the shuffle, and joined in ``SALTS`` pieces."""
    rows = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    groups = stable(
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    if groups.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(groups), F.col("payload_digest") == F.col("d"), "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        salted = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s"))
        joined = rows.withColumn("salt", salt).join(salted, same, "left")
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record(r: DataFrame) -> DataFrame:
    """One text per record, without the gap that ends it."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    response = F.col("record_type") == "response"
    # control characters would break the header apart
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "")
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.when(response, F.col("payload_bytes")).otherwise(0).cast("string")),
    )
    block = F.when(response, F.col("payload")).otherwise("")
    return r.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives under ``path``, one for each task that writes, in any file
    system that Spark writes to."""
    record(with_revisits(pages, least_bytes)).write.option("lineSep", GAP).text(path)


def _beside(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join of rows that carry texts with a narrow table, which is broadcast
    if it was counted and found small; else both are shuffled."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, "left")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, body: the text after each magic line up to the next one,
    and the offset in the file at which that magic line begins.

    The reader cuts files at any byte and hands the pieces of a cut to one
    task, in order; a cut's offset is the length of those before it.  The
    pieces are stored, so that every use sees the same cuts."""

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, so_far = None, 0
        for batch in batches:
            size = pc.binary_length(batch.column("body")).to_numpy().astype(np.int64) + len(MAGIC)
            cuts = pc.dictionary_encode(batch.column("cut"))
            code, names = cuts.indices.to_numpy(), cuts.dictionary.to_pylist()
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            begin = np.zeros(len(size), np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(size)]):
                if names[code[a]] != cut:
                    cut, so_far = names[code[a]], 0
                begin[a:b] = so_far + np.cumsum(size[a:b]) - size[a:b]
                so_far += int(size[a:b].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("cut"), pa.array(begin), pa.array(size), batch.column("body")],
                ["file", "cut", "ahead", "bytes", "body"],
            )

    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
        F.expr("concat(_metadata.file_name, ' ', lpad(_metadata.file_block_start, 20, '0'))").alias("cut"),
        F.col("value").alias("body"),
    )
    kept = stored(raw.mapInArrow(ahead, "file string, cut string, ahead long, bytes long, body string"))
    earlier = Window.partitionBy("file").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    per_cut = kept.groupBy("file", "cut").agg(F.sum("bytes").alias("bytes"))
    base = stable(per_cut.select("cut", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")))
    # a file begins with a magic line, so its first piece is the nothing before that line
    offset = F.col("base") + F.col("ahead") - len(MAGIC)
    return _beside(kept, base, ["cut"]).select("file", offset.alias("offset"), "body").where("offset >= 0")


def candidates(found: DataFrame) -> DataFrame:
    """Adds head, length, begin and next to every place that may be a record."""
    head = F.substring_index("body", GAP, 1)
    length = F.regexp_extract(F.col("head"), "(?:^|\r\n)Content-Length: ([0-9]{1,18})(?:\r\n|$)", 1)
    return (
        found.where(F.instr("body", GAP) > 0)
        .withColumn("head", head)
        .withColumn("length", F.when(length != "", length.cast("long")))
        .where("length is not null")
        .withColumn("begin", F.col("offset") + len(MAGIC) + F.octet_length("head") + len(GAP))
        .withColumn("next", F.col("begin") + F.col("length") + len(GAP))
    )


def reachable(links: DataFrame) -> DataFrame:
    """file, offset of the records on the chain from offset 0 of each file.

    Round k knows the records within 2^k steps of the start and the place 2^k
    steps after every candidate; the reached ones mark those places, and the
    steps double.  So the rounds are the logarithm of the records per file."""
    state = stable(links.select("file", "offset", "next", (F.col("offset") == 0).alias("on")))
    reached = -1
    while True:
        now = state.where("on").count()
        if now == reached:
            return state.where("on").select("file", "offset")
        reached = now
        marked = state.where("on").select("file", F.col("next").alias("offset"), F.lit(True).alias("mark")).distinct()
        jump = state.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        state = stable(
            state.join(marked, ["file", "offset"], "left")
            .join(jump, ["file", "next"], "left")
            .select("file", "offset", F.col("after").alias("next"), (F.col("on") | F.coalesce("mark", F.lit(False))).alias("on"))
        )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, head, payload."""
    found = pieces(spark, path)
    links = stable(candidates(found).select("file", "offset", "next"))
    records = stable(links.join(reachable(links), ["file", "offset"], "left_semi"))
    # a piece whose magic line isn't a record's belongs to the record before it, within the same megabytes
    stray = found.select("file", "offset").join(records, ["file", "offset"], "left_anti").withColumn("mb", F.expr("shiftright(offset, 20)"))
    spread = records.withColumn("mb", F.explode(F.expr("sequence(shiftright(offset, 20), shiftright(next, 20))")))
    inside = F.expr("s.file = r.file and s.mb = r.mb and s.offset > r.offset and s.offset < r.next")
    owned = stable(stray.alias("s").join(spread.alias("r"), inside).select("s.file", "s.offset", F.col("r.offset").alias("owner")))
    owners = owned.select("file", F.col("owner").alias("offset"), "owner").distinct()
    marked = _beside(found, stable(owned.unionByName(owners)), ["file", "offset"])
    alone = marked.where("owner is null").select("file", "offset", "body")
    order = F.array_sort(F.collect_list(F.struct("offset", "body")))
    rebuilt = (
        marked.where("owner is not null")
        .groupBy("file", F.col("owner").alias("begin"))
        .agg(F.array_join(F.transform(order, lambda x: x["body"]), MAGIC).alias("body"))
        .select("file", F.col("begin").alias("offset"), "body")
    )
    block = F.substring(F.encode("body", "UTF-8"), (F.col("begin") - F.col("offset") - len(MAGIC) + 1).cast("int"), F.col("length").cast("int"))
    return candidates(alone.unionByName(rebuilt)).select("file", "offset", "head", F.decode(block, "UTF-8").alias("payload"))


def fields(records: DataFrame) -> DataFrame:
    """The header fields that ``record`` writes, and the payload's own length and digest."""

    def field(name: str, pattern: str) -> Column:
        found = F.regexp_extract("head", f"(?:^|\r\n){name}: {pattern}(?:\r\n|$)", 1)
        return F.when(found != "", found)

    response = F.col("record_type") == "response"
    return (
        records.withColumn("record_type", field("WARC-Type", "([a-z]+)"))
        .withColumn("page_id", field("WARC-Record-ID", "<urn:page:([-0-9]*)>").cast("long"))
        .withColumn("refers_to", field("WARC-Refers-To", "<urn:page:([-0-9]+)>").cast("long"))
        .withColumn("url", field("WARC-Target-URI", "([^\r\n]*)"))
        .withColumn("payload_digest", F.when(response, base32_sha1(F.col("payload"))).otherwise(field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")))
        .withColumn("payload_bytes", F.when(response, F.octet_length("payload").cast("long")).otherwise(field("X-Payload-Length", "([0-9]+)").cast("long")))
        .select("file", "offset", "page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )
