"""Text columns as NumPy arrays, inside tasks.

A chunk is some whole documents of an Arrow string column: their UTF-8 bytes
side by side and the offsets at which each begins.  Nothing is looped over
per word or per byte in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rowmend.core import ensure_checkpoint_dir

CHUNK_BYTES = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Chunk:
    """Documents lo..hi of the column; document i has bytes data[off[i]:off[i + 1]]."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole documents, about ``limit`` bytes at a time (one document at least);
    a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the offsets of the documents in
    this list of words.  Words are separated by blanks 0x20 and 0x09-0x0D."""
    solid = ~SPACE[c.data]
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(c) + 1, np.int64)
    first = np.zeros(len(solid) + 1, bool)
    first[c.off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, c.off)


# Two polynomials over the prime field of 2^31 - 1, whose bases are drawn at random: unlike one modulo a power of
# two, these tell regular texts (Thue-Morse words, say) apart as well as any others.
PRIME = np.uint64(2**31 - 1)
_DRAWN = np.random.default_rng(20).integers(2**20, 2**31 - 2, (2, 2), dtype=np.int64)


def _folded(x: np.ndarray) -> np.ndarray:
    """A number with the remainder of x: below 2^32 for x below 2^62, else below 2^34."""
    low = x & PRIME
    low += x >> np.uint64(31)
    return low


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    low = x & PRIME
    low += x >> np.uint64(31)
    high = low >> np.uint64(31)
    low &= PRIME
    low += high
    np.subtract(low, PRIME, out=low, where=low >= PRIME)
    return low


def _letters(which: int, fold: bool) -> np.ndarray:
    table = np.random.default_rng(1000 + which).integers(1, 2**62, 256, dtype=np.uint64)
    if fold:
        table[65:91] = table[97:123]
    return table


BLOCK = 1024
AT_ONCE = 16 * BLOCK  # values worked on together, so that they stay in the cache


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.concatenate([p, _reduced(p * np.uint64(pow(base, len(p), int(PRIME))))])
    return p[:n]


class Powers:
    """Powers of a base, as products of two short tables."""

    def __init__(self, base: int, n: int):
        self.low, self.high = _powers(base, BLOCK), _powers(pow(base, BLOCK, int(PRIME)), n // BLOCK + 1)

    def run(self, start: int, end: int) -> np.ndarray:
        """Those from start, a multiple of BLOCK, to before end, folded."""
        high = self.high[start // BLOCK : -(-end // BLOCK)]
        return _folded(high[:, None] * self.low[None, :]).ravel()[: end - start]

    def of(self, k: np.ndarray) -> np.ndarray:
        return _reduced(self.high[k // BLOCK] * self.low[k % BLOCK])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hash of any range of a sequence in constant time per range: 62 bits, mixed to 64.

    Ranges of n values collide with a chance of (n / 2^31)^2.  The two halves of a value's 62 lower bits
    are the coefficients of the two polynomials."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n, prime = len(values), int(PRIME)
        self.sums, self.down = [], []
        for part in (0, 1):
            base = int(_DRAWN[which, part])
            up, sums = Powers(base, n), np.zeros(n + 1, np.uint64)
            for lo in range(0, n, AT_ONCE):
                hi = min(n, lo + AT_ONCE)
                half = values[lo:hi] >> np.uint64(31 * part)
                half &= PRIME
                half *= up.run(lo, hi)
                np.cumsum(_folded(half), out=sums[lo + 1 : hi + 1])
                sums[lo + 1 : hi + 1] += sums[lo]
            self.sums.append(sums)
            self.down.append(Powers(pow(base, -1, prime), n))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = None
        for s, down in zip(self.sums, self.down):
            x = _reduced(s[end] - s[start])
            x *= down.of(start)
            x = _reduced(x)
            out = x if out is None else (out << np.uint64(31)) | x
        return mix(out)

    def each(self, width: int) -> np.ndarray:
        """The hashes of all ranges of ``width`` values (below 2^20), by where they start."""
        n = len(self.sums[0]) - width
        out = np.empty(max(0, n), np.uint64)
        for lo in range(0, n, AT_ONCE):
            hi, both = min(n, lo + AT_ONCE), None
            for s, down in zip(self.sums, self.down):
                x = _folded(s[lo + width : hi + width] - s[lo:hi])
                x *= down.run(lo, hi)
                x = _reduced(x)
                both = x if both is None else (both << np.uint64(31)) | x
            out[lo:hi] = mix(both)
        return out


def byte_hash(c: Chunk, which: int = 0, fold: bool = False) -> Rolling:
    return Rolling(_letters(which, fold)[c.data], which)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def per_doc_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive pieces, empty ones included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def stored(df: DataFrame) -> DataFrame:
    """``stable`` for tables with texts: compressed harder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        jvm = table.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def squeezed(docs: DataFrame) -> DataFrame:
    """Replaces text (null: empty) by ``packed``, so that shuffles of texts carry a third of the bytes."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for c in chunks(batch.column("text")):
                raw = c.data.tobytes()
                out = [pack.compress(raw[a:b]) for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist())]
                rest = batch.select(others).slice(c.lo, len(c))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], [*others, "packed"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.select(*others, "text").mapInArrow(run, kinds + "packed binary")


def opened(packed: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(p.as_py()) if p.is_valid else b"" for p in packed]


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive values, the first of equals."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(30)
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[:n] = key
    grid = grid.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(tail[: n - width + 1], head[width - 1 : n])
    return (best & np.uint64(2**30 - 1)).astype(np.int64)


def segments(h: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows, inside documents, that have the same anchor.

    A window's anchor is the gram in it with the smallest hash, the first of
    equals: so equal windows have their anchors at the same place.  Given are the
    hashes of all grams, off: the documents' offsets in the sequence.  Returned
    are first and last window start of each run, and the anchor's place."""
    none = np.zeros(0, np.int64)
    if len(h) < window - gram + 1:
        return none, none, none
    at = sliding_argmin(h, window - gram + 1)
    room = np.maximum(0, np.diff(off) - window + 1)
    valid = np.zeros(len(at) + 1, np.int64)
    has = room > 0
    np.add.at(valid, off[:-1][has], 1)
    np.add.at(valid, (off[:-1] + room)[has], -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return none, none, none
    anchor = at[starts]
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[new[1:], len(starts)] - 1
    return starts[new], starts[last], anchor[new]
