"""Repeated passages by suffix trees over prefix groups.

The suffixes of all documents' words are split by prefixes of varying length
into groups that fit into memory: a splitter is as long as it takes, one anchor
of five words where few suffixes share it, more words and at last the document
itself where many do (``buckets`` cuts the sorted order at sampled places).  In
a group the sorted suffixes' common prefixes are the inner nodes of their tree;
a node ``window`` words deep with leaves from two documents is a repeat, and
carries the smallest document below it.

Suffixes that begin within one anchor's reach share most of their words, so
they go through the first round together: whole passages that are equal are
one node, passages whose anchor nobody shares are dropped, and only those that
share an anchor but not all words around it go on as single suffixes.

Nulls: a null text has no words; a null id counts as larger than all others.
Repeated rows have one id, so neither takes words from the other.  Texts
shorter than the window lose nothing.  An empty table gives an empty result.
Texts may be of any length; a document's own list of places has to fit into memory.
Other columns stay; one with the name of a result (n_words, n_removed, kept_sha256)
is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.core import stable

from .buckets import neighbours
from .packed import Chunk, Rolling, byte_hash, chunks, discard, mix, opened, segments, signed, squeezed, stored, words
from .suffix_array import _lists, _same, over, tagged, under

ANCHOR = 5
PLACE = ["doc", "tag", "at", "n"]
ROWS = "core long, t1 long, doc long, tag long, at int, n int"


def _words(c: Chunk) -> tuple[Rolling, Rolling, np.ndarray]:
    first, end, off = words(c)
    ids = byte_hash(c).of(first, end) if len(first) else np.zeros(0, np.uint64)
    return Rolling(ids), Rolling(ids, 1), off


def _batch(core, t1, ids: list[pa.Array], which: np.ndarray, at, n) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(core), 200_000):
        s = slice(lo, lo + 200_000)
        row = pa.array(which[s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(core[s])), pa.array(signed(t1[s])), *(i.take(row) for i in ids), *(pa.array(v[s].astype(np.int32)) for v in (at, n))],
            ["core", "t1", *PLACE],
        )


def anchored(docs: DataFrame, window: int) -> DataFrame:
    """A row for each run of suffixes with the same anchor: tokens of the anchor and of all their words.

    Of equal runs in a chunk of documents only those of the smallest id are
    sent on; the others are known to be repeats, and marked by a core of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column("doc"), batch.column("tag")]
            doc = ids[0].fill_null(np.iinfo(np.int64).max).to_numpy()
            for c in chunks(batch.column("text")):
                one, two, off = _words(c)
                total = int(off[-1])
                if total < window:
                    continue
                i = np.arange(total - ANCHOR + 1)
                grams = one.of(i, i + ANCHOR)
                first, last, anchor = segments(grams, off, window, ANCHOR)
                which = np.searchsorted(off, first, "right") - 1
                n = last - first + 1
                t1 = two.of(first, last + window) ^ mix((n * 65_536 + anchor - first).astype(np.uint64))
                core = grams[anchor] | np.uint64(1)
                key = mix(core ^ (t1 * np.uint64(3)))
                order = np.lexsort((doc[which + c.lo], key))
                new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
                least = doc[which[order] + c.lo][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc[:0]
                core[order[doc[which[order] + c.lo] > least]] = 0
                yield from _batch(core, t1, ids, which + c.lo, first - off[which], n)

    return docs.select("doc", "tag", "text").mapInArrow(run, ROWS)


def _single(texts: DataFrame, window: int) -> DataFrame:
    """The listed suffixes one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            ids, todo = [batch.column("doc"), batch.column("tag")], batch.column("todo")
            raw = pa.array(opened(batch.column("packed")), pa.binary())
            flat = todo.flatten()
            at, n = (flat.field(k).to_numpy().astype(np.int64) for k in ("at", "n"))
            begin = np.concatenate([[0], np.cumsum(todo.value_lengths().to_numpy())])
            for c in chunks(raw.cast(pa.string())):
                one, two, off = _words(c)
                mine = slice(begin[c.lo], begin[c.hi])
                count = n[mine]
                which = np.repeat(np.repeat(np.arange(len(c)), np.diff(begin[c.lo : c.hi + 1])), count)
                start = off[which] + np.repeat(at[mine], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                yield from _batch(
                    one.of(start, start + window), two.of(start, start + window), ids, which + c.lo, start - off[which], np.ones(len(start), np.int64)
                )

    return texts.mapInArrow(run, ROWS)


def repeated(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc, tag, at, n: the windows beginning at words at .. at + n - 1 also begin
    in a document with a smaller id."""
    later = "least < coalesce(doc, 9223372036854775807)"
    rows = stable(anchored(docs, window))
    known = stable(rows.where("core = 0").select("doc", "tag", "at", "n"))
    around = neighbours(rows.where("core != 0"), "core", ["t1"], PLACE, rows.count())
    discard(rows)
    rest = around.where(f"mixed and not ({later})")
    todo = _lists(rest, ["at", "n"], "todo")
    joined = squeezed(docs.select("doc", "tag", "text")).join(todo, _same()).drop("d", "g")
    texts = stored(joined.groupBy("doc", "tag").agg(F.first("packed").alias("packed"), F.first("todo").alias("todo")))
    single = stable(_single(texts, window))
    discard(texts)
    nodes = neighbours(single, "core", ["t1"], PLACE, single.count())
    discard(single)
    cols = ["doc", "tag", "at", "n"]
    return known.unionByName(around.where(later).select(*cols)).unionByName(nodes.where(later).select(*cols))


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs with text made of the words left, and n_words, n_removed, kept_sha256."""
    known, others = tagged(under(docs)), ["_row"]
    ranges = _lists(repeated(known, window), ["at", "n"], "ranges")
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
                    w = raw.split()
                    a, b = begin[i], begin[i + 1]
                    kept = w
                    if b > a:
                        step = np.zeros(len(w) + 1, np.int64)
                        np.add.at(step, at[a:b], 1)
                        np.add.at(step, at[a:b] + n[a:b] - 1 + window, -1)
                        kept = [w[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    text = b" ".join(kept)
                    out.append((text.decode(), len(w), len(w) - len(kept), hashlib.sha256(text).hexdigest()))
                text, n_words, gone, digest = zip(*out)
                rest = batch.select(others).slice(lo, len(out))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                    [*others, "text", "n_words", "n_removed", "kept_sha256"],
                )

    kinds = f"_row {known.schema['_row'].dataType.simpleString()}, "
    cut = joined.mapInArrow(run, kinds + "text string, n_words long, n_removed long, kept_sha256 string")
    return over(cut, docs, ["text", "n_words", "n_removed", "kept_sha256"])
