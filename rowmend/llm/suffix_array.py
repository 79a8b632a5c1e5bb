"""Repeated byte strings by a sparse suffix array.

A string of ``length`` bytes that stands in two places is found by sorting
suffixes and comparing neighbours.  Sorting a suffix for every byte, each with
its bytes, is out of reach, so suffixes are taken at anchors: the places that
have the smallest hash of 64 bytes among all in a string of that length.  Equal
strings have equal anchors, so no repeat is missed.  The suffixes, as rows of
tokens, are range-partitioned by sampled splitters, sorted in their buckets and
compared across the boundaries (``buckets``).  Where two share an anchor's text
but not all around it, the strings around it are cut into slices of 16 starts,
and then into single ones, and sorted anew; only what is left undecided goes on.

Nulls: a null text is an empty one, a null id a document of its own; both are
returned.  Repeated rows are further places where their strings stand.  Texts
shorter than ``length`` lose nothing.  An empty table gives an empty result.
Texts may be of any length; a document's own list of places has to fit into memory.
Other columns stay; one with the name of a result (n_bytes, n_removed, n_spans,
kept_sha256) is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.core import stable

from .buckets import neighbours
from .packed import byte_hash, chunks, discard, mix, opened, segments, signed, squeezed, stored

GRAM = 64
SLICE = 16
CHUNK = 600_000  # bytes hashed at a time
PLACE = ["doc", "tag", "at", "n", "x"]
ROWS = "core long, t1 long, t2 long, doc long, tag long, at int, n int, x int"


def tagged(docs: DataFrame) -> DataFrame:
    """doc and tag (a hash of the text) tell documents apart, also those that repeat an id or have none.

    Ids that are no whole numbers are numbered in their order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        docs = docs.withColumn("doc", F.col("doc_id").cast("long"))
    else:
        ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id")
        docs = docs.join(stable(ids.withColumn("doc", F.monotonically_increasing_id())), "doc_id", "left")
    return docs.withColumns({"text": text, "tag": F.xxhash64(text)})


def under(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as one, so that none meets a name used here."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def over(cut: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """The columns of docs, but for those that ``made`` replaces, and ``made``."""
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in made]
    return cut.select(*kept, *made)


def _batch(core, t1, t2, ids: list[pa.Array], which: np.ndarray, at, n, x) -> Iterator[pa.RecordBatch]:
    names = ["core", "t1", "t2", *PLACE]
    for lo in range(0, len(core), 200_000):
        s = slice(lo, lo + 200_000)
        row = pa.array(which[s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(core[s])), pa.array(signed(t1[s])), pa.array(signed(t2[s])), *(i.take(row) for i in ids),
             *(pa.array(v[s].astype(np.int32)) for v in (at, n, x))], names,
        )


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """A row for each anchor: its text's token, and tokens of all the strings around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column("doc"), batch.column("tag")]
            for c in chunks(batch.column("text"), CHUNK):
                one, two = byte_hash(c), byte_hash(c, 1)
                if len(c.data) < length:
                    continue
                grams = one.each(GRAM)
                first, last, anchor = segments(grams, c.off, length, GRAM)
                which = np.searchsorted(c.off, first, "right") - 1
                n, x = last - first + 1, anchor - first
                shape = mix((n * 65_536 + x).astype(np.uint64))
                t1, t2 = one.of(first, last + length) ^ shape, two.of(first, last + length)
                yield from _batch(grams[anchor], t1, t2, ids, which + c.lo, first - c.off[which], n, x)

    return docs.select("doc", "tag", "text").mapInArrow(run, ROWS)


def _finer(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Slices of ``width`` starts of the listed strings, by their distance to the
    anchor; the core is what all strings of a whole slice have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            ids, todo = [batch.column("doc"), batch.column("tag")], batch.column("todo")
            raw = pa.array(opened(batch.column("packed")), pa.binary())
            flat = todo.flatten()
            at, n, x = (flat.field(k).to_numpy().astype(np.int64) for k in ("at", "n", "x"))
            begin = np.concatenate([[0], np.cumsum(todo.value_lengths().to_numpy())])
            for c in chunks(raw.cast(pa.string())):
                one, two = byte_hash(c), byte_hash(c, 1)
                mine = slice(begin[c.lo], begin[c.hi])
                which = np.repeat(np.arange(len(c)), np.diff(begin[c.lo : c.hi + 1]))
                base = c.off[which] + at[mine]
                high, low = x[mine], x[mine] - n[mine] + 1
                count = high // width - low // width + 1
                k = np.repeat(np.arange(len(base)), count)
                j = low[k] // width + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
                xh, xl = np.minimum(high[k], j * width + width - 1), np.maximum(low[k], j * width)
                anchor = (base + high)[k]
                core = one.of(anchor - j * width, anchor - j * width - width + 1 + length)
                start, end = anchor - xh, anchor - xl + length
                shape = mix((xh * 65_536 + xl).astype(np.uint64)) if width > 1 else np.uint64(0)
                t1, t2 = one.of(start, end) ^ shape, two.of(start, end)
                yield from _batch(core, t1, t2, ids, which[k] + c.lo, start - c.off[which[k]], xh - xl + 1, xh)

    return texts.mapInArrow(run, ROWS)


def _lists(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """The places of each document in one row: as many as its own text has."""
    return rows.groupBy(F.col("doc").alias("d"), F.col("tag").alias("g")).agg(F.collect_set(F.struct(*fields)).alias(name))


def _same() -> object:
    return F.col("doc").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("g"))


def repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc, tag, at, n: the strings of ``length`` bytes beginning at at .. at + n - 1
    in a document stand elsewhere, too."""
    texts, found = None, []
    for width in (0, SLICE, 1):
        rows = stable(anchored(docs, length) if not width else _finer(texts, length, width))
        around = neighbours(rows, "core", ["t1", "t2"], PLACE, rows.count())
        discard(rows)
        found.append(around.where("many").select("doc", "tag", "at", "n"))
        if width == 1:
            discard(texts)
            break
        # of equal ones a single document's stand for all against the others
        rest = around.where("mixed and (not many or coalesce(doc, 9223372036854775807) = least)")
        todo = _lists(rest, ["at", "n", "x"], "todo")
        source = squeezed(docs.select("doc", "tag", "text")) if texts is None else texts.drop("todo")
        joined = source.join(todo, _same()).drop("d", "g").groupBy("doc", "tag").agg(F.first("packed").alias("packed"), F.first("todo").alias("todo"))
        before, texts = texts, stored(joined)
        if before is not None:
            discard(before)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _cut(raw: bytes, at: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and runs removed."""
    if not len(at):
        return raw, 0, 0
    order = np.argsort(at)
    begin, end = at[order], (at + n - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > reach[:-1]]
    lo, hi = begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
    kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
    return kept, int((hi - lo).sum()), len(lo)


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """The rows of docs with text cut, and n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that is in a string of ``length`` bytes which begins anywhere
    else, too.  The digest is of the bytes left; a letter of which a part went is
    left out of the text."""
    known, others = tagged(under(docs)), ["_row"]
    ranges = _lists(repeated(known, length), ["at", "n"], "ranges")
    joined = squeezed(known).join(ranges, _same(), "left").select(*others, "packed", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, packed = batch.column("ranges"), batch.column("packed")
            flat, sizes = ranges.flatten(), ranges.value_lengths().fill_null(0).to_numpy()
            at, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for lo in range(0, len(packed), 500):
                out = []
                for i, raw in enumerate(opened(packed.slice(lo, 500)), lo):
                    s = slice(begin[i], begin[i + 1])
                    kept, gone, spans = _cut(raw, at[s], n[s], length)
                    out.append((kept.decode("utf-8", "ignore"), len(raw), gone, spans, hashlib.sha256(kept).hexdigest()))
                text, n_bytes, gone, spans, digest = zip(*out)
                rest = batch.select(others).slice(lo, len(out))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(text, pa.string()), *(pa.array(v, pa.int64()) for v in (n_bytes, gone, spans)), pa.array(digest, pa.string())],
                    [*others, "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    kinds = f"_row {known.schema['_row'].dataType.simpleString()}, "
    cut = joined.mapInArrow(run, kinds + "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return over(cut, docs, ["text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
