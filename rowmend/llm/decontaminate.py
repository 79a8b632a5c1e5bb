"""Benchmark items in documents: counting shared q-grams in diagonal bands.

Texts are folded to lower case in all alphabets, composed (NFC), and all but
letters, digits and combining marks becomes blanks; bytes are those of UTF-8
after that.  An item of m bytes stands in
a document with at most k edits only if they share m - q + 1 - k * q of its
q-grams on diagonals (place in the text less place in the item) at most k
apart.  So shared q-grams are counted in bands of 2 (k + 1) diagonals that
overlap by half; bands that reach the number are verified by alignment within
the band.

Items are taken in blocks of bounded size, each compared with all documents, so
a benchmark of any size works with bounded memory.

Nulls: a null text has no matches, a null item is left out, null ids are kept.
Items of fewer than q normalised bytes have to stand as they are between word
borders; short ones are allowed fewer edits, so that the number stays positive.
Items without a letter or digit are left out.
Repeated rows match alike; an item that matches a document several times is
reported once, with the fewest edits, the first of equals.  Empty tables give
no matches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import chunks

Q = 12
BLOCK_BYTES = 2_000_000
TABLE_BITS = 22
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_KEEP = set(range(48, 58)) | set(range(97, 123))
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


class _Letters(dict):
    """Code point to itself, or to a blank, as they come up."""

    def __missing__(self, code: int) -> int:
        kept = chr(code).isalnum() or unicodedata.category(chr(code))[0] == "M"
        self[code] = code if kept else 32
        return self[code]


def normalise(text: bytes, letters: dict = _Letters()) -> bytes:
    if text.isascii():
        return b" ".join(text.translate(CLEAN).split())
    folded = unicodedata.normalize("NFC", text.decode("utf-8", "replace")).casefold()
    return " ".join(unicodedata.normalize("NFC", folded).translate(letters).split()).encode()


def grams(data: bytes) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    first = np.ndarray((n,), "<u8", data, 0, (1,))
    last = np.ndarray((n,), "<u8", data, Q - 8, (1,))
    h = first * MULTIPLIERS[0] ^ (last * MULTIPLIERS[1] + (last >> np.uint64(29)))
    return h ^ (h >> np.uint64(32))


class Items:
    """A block of items: their q-grams, where they stand, and how many a match needs."""

    def __init__(self, ids: list, texts: list[bytes], rate: float):
        self.ids, self.texts = ids, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.edits = np.array([min(int(rate * len(t)), (len(t) - Q) // Q) for t in texts], np.int64)
        self.need = self.size - Q + 1 - self.edits * Q
        # those without a q-gram, by their words
        self.short: dict[bytes, list[int]] = {}
        for i, t in enumerate(texts):
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.short_words = sorted({t.count(b" ") + 1 for t in self.short})
        h = [grams(t) for t in texts]
        item = np.repeat(np.arange(len(texts)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h])
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(flat)])
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - TABLE_BITS)] = True

    def bands(self, data: bytes) -> np.ndarray:
        """(item, first diagonal, last diagonal) of the bands with enough shared q-grams."""
        h = grams(data)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        at, k = at[ok], k[ok]
        found = [np.zeros((0, 3), np.int64)]
        step, over = 500_000, 2 * int(self.size.max())  # a match lies within one of the overlapping parts
        for lo in range(0, len(at), step):
            found.append(self._count(at[lo : lo + step + over], k[lo : lo + step + over]))
        return np.unique(np.concatenate(found), axis=0)

    def _count(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        times = self.count[k]
        where = np.repeat(self.first[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, diagonal = self.item[where], np.repeat(at, times) - self.place[where] + int(self.size.max())
        out = []
        half = self.edits[item] + 1
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            key = item * (1 << 40) + band
            value, n = np.unique(key, return_counts=True)
            i, b = value >> 40, value & ((1 << 40) - 1)
            ok = n >= self.need[i]
            i, b, w = i[ok], b[ok], 2 * (self.edits[i[ok]] + 1)
            low = b * w - shift * w // 2 - int(self.size.max())
            out.append(np.stack([i, low, low + w - 1], axis=1))
        return np.concatenate(out)


    def exact(self, text: bytes) -> dict[int, tuple[int, int]]:
        """item -> (0, end) of the first place of each item shorter than q, on word borders."""
        out: dict[int, tuple[int, int]] = {}
        if self.short:
            words = text.split(b" ")
            end = np.cumsum([len(w) + 1 for w in words]) - 1
            for n in self.short_words:
                for k in range(len(words) - n + 1):
                    for i in self.short.get(b" ".join(words[k : k + n]), ()):
                        out.setdefault(i, (0, int(end[k + n - 1])))
        return out


def align(item: bytes, text: bytes, low: int, high: int, edits: int) -> tuple[int, int] | None:
    """(edits, end in the text) of the best match of the item that begins between
    ``low`` and ``high``, or None if it takes more than ``edits``."""
    at = text.find(item, max(0, low), max(0, high) + len(item))
    if at >= 0:
        return 0, at + len(item)
    p, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    # cell j of row i: the best way to match i bytes of the item, ending before text byte low - edits + i + j
    width = high - low + 2 * edits + 1
    j = np.arange(width)
    start = low - edits
    padded = np.zeros(len(p) + width, np.int16) - 1
    a, b = max(0, start), min(len(t), start + len(padded))
    if b > a:
        padded[a - start : b - start] = t[a:b]
    inside = (start + j >= 0) & (start + j <= len(t))
    row = np.where(inside, 0, 10_000)
    for i in range(1, len(p) + 1):
        change = row + (padded[i - 1 : i - 1 + width] != p[i - 1])
        skip = np.append(row[1:], 10_000) + 1
        best = np.minimum(change, skip)
        row = np.minimum.accumulate(best - j) + j
        if row.min() > edits:
            return None
    last = int(np.argmin(row))
    return (int(row[last]), start + len(p) + last) if row[last] <= edits else None


def _matches(items: Items, data: bytes, off: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
    """For each document of the chunk: item -> (edits, end)."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for i, low, high in items.bands(data).tolist():
        middle = min(max((low + high) // 2 + int(items.size[i]) // 2, 0), int(off[-1]) - 1)
        for doc in {int(np.searchsorted(off, x, "right")) - 1 for x in (max(0, min(low, int(off[-1]) - 1)), middle)}:
            a, b = int(off[doc]), int(off[doc + 1])
            hit = align(items.texts[i], data[a:b], low - a, high - a, int(items.edits[i]))
            if hit:
                best = out.setdefault(doc, {})
                best[i] = min(best.get(i, hit), hit)
    for doc in range(len(off) - 1 if items.short else 0):
        found = items.exact(data[off[doc] : off[doc + 1] - 1])
        if found:
            out.setdefault(doc, {}).update(found)
    return out


def blocks(benchmark: DataFrame, rate: float) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    kept = benchmark.where("text is not null").select("item_id", "text")
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    n = 1 + total // BLOCK_BYTES
    for k in range(n):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        known = [(r.item_id, normalise(r.text.encode())) for r in rows]
        known = [(i, t) for i, t in known if t]
        if known:
            yield Items([i for i, _ in known], [t for _, t in known], rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The rows of docs, without text, that hold an item, and ``hits``: item_id, edits, end, item_bytes of each.
    A document appears once for each block of items that it matches."""
    others = [c for c in docs.columns if c != "text"]
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    kinds += f"hits array<struct<item_id: {item_type}, edits: int, end: int, item_bytes: int>>"

    def search(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rest, texts = batch.select(others), batch.column("text")
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int32()), ("item_bytes", pa.int32())]))
                for c in chunks(texts):
                    raw = c.data.tobytes()
                    clean = [normalise(raw[a:b]) for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist())]
                    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in clean])])
                    found = _matches(items, b"\n".join(clean) + b"\n", off)
                    if found:
                        rows = sorted(found)
                        hits = [[(items.ids[i], e, end, len(items.texts[i])) for i, (e, end) in sorted(found[r].items())] for r in rows]
                        part = rest.slice(c.lo, len(c)).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], [*others, "hits"])

        return run

    out = docs.sparkSession.createDataFrame([], kinds)
    for items in blocks(benchmark, rate):
        out = out.unionByName(docs.select(*others, "text").mapInArrow(search(items), kinds))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """doc_id, item_id, edits, end, similarity: one row for each document and item found in it."""
    hit = matches(docs.select("doc_id", "text"), benchmark, rate).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    best = hit.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end", "item_bytes")).alias("b"))
    return best.select(
        "doc_id", "item_id", F.col("b.edits").alias("edits"), F.col("b.end").alias("end"),
        F.round(1 - F.col("b.edits") / F.col("b.item_bytes"), 6).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The rows of docs that hold no item."""
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = matches(docs.select("doc_id", tag.alias("t"), "text"), benchmark, rate).select(F.col("doc_id").alias("k"), F.col("t").alias("g")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", tag.alias("t"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("g")), "left_anti").select("row.*")
