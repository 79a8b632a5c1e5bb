"""SimHash fingerprints and their connected components by an index in Gray order.

Fingerprints that differ in at most three of 64 bits agree in one of four
16-bit blocks.  So the distinct fingerprints are turned four times, each block
in front once, sorted by Gray rank and range-partitioned.  A partition's index
has the fingerprints as leaves; every node above holds the bit pattern that all
below it share, and the mask of those bits.  A search adds up the differences
on shared patterns from the top and drops whole groups above the limit.  Found
members leave the index, so a dense group costs its size and not its square,
and gives a tree of links and not all pairs.  Range borders are put between
blocks, so no link is cut.

Nulls: a null text is an empty one; an empty text has fingerprint zero, which
links like any other.  Null ids count last: a component's id is its smallest
id, null if all are.  Repeated rows have one fingerprint.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.core import stable

from .packed import Chunk, chunks, words

FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCKS, BLOCK_BITS = 4, 16
LEAF = 64  # fingerprints under a lowest node
FANOUT = 16
SHORT_RUN = 48  # a block value with fewer members is compared by shifting


def _fingerprints(c: Chunk, shingle: int) -> np.ndarray:
    first, end, off = words(c)
    raw = c.data.tobytes().translate(FOLD)
    out = np.zeros(len(c), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    # words that one blank separates are already space-joined
    for i in range(len(c)):
        a, b = off[i], off[i + 1]
        if a == b:
            continue
        text = b" ".join(raw[c.off[i] : c.off[i + 1]].split())
        size = end[a:b] - first[a:b]
        at = np.zeros(b - a, np.int64)
        np.cumsum(size[:-1] + 1, out=at[1:])
        n = max(1, b - a - shingle + 1)
        ends = (at + size)[-n:].tolist()
        h = np.array([digest(text[x:y], 42) for x, y in zip(at[:n].tolist(), ends)], np.uint64)
        if n > 20_000:
            ones = sum(_bits(h[k : k + 20_000]) for k in range(0, n, 20_000))
        else:
            ones = _bits(h)
        out[i] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    """How many have each of the 64 bits, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The columns of docs with fp (long), the 64-bit SimHash of the lower-cased words' shingles, for text."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(others)
            for c in chunks(batch.column("text")):
                fp = _fingerprints(c, shingle)
                yield pa.RecordBatch.from_arrays([*rest.slice(c.lo, len(c)).columns, pa.array(fp.view(np.int64))], [*others, "fp"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.select(*others, "text").mapInArrow(run, kinds + "fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the Gray code's order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Search by Hamming distance over sorted fingerprints; members can be removed."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.live = np.ones(len(x), bool)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        width, low, high = LEAF, x, x  # and / or of everything below
        while True:
            cut = np.arange(0, len(low), width)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            self.levels.append((low, ~(low ^ high), width))
            if len(cut) <= FANOUT:
                break
            width = FANOUT

    def near(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) for all live members within the limit, a query's block at a time."""
        found_q, found_m = [], []
        for lo in range(0, len(queries), 256):
            part = queries[lo : lo + 256]
            low, mask, _ = self.levels[-1]
            q = np.repeat(np.arange(len(part)), len(low))
            node = np.tile(np.arange(len(low)), len(part))
            for depth in range(len(self.levels) - 1, -1, -1):
                low, mask, width = self.levels[depth]
                keep = np.bitwise_count((part[q] ^ low[node]) & mask[node]) <= limit
                q, node = q[keep], node[keep]
                below = len(self.x) if depth == 0 else len(self.levels[depth - 1][0])
                for s in [slice(k, k + 8192) for k in range(0, len(q), 8192)] if depth == 0 else [slice(None)]:
                    nq, nn = np.repeat(q[s], width), (node[s][:, None] * width + np.arange(width)).ravel()
                    inside = nn < below
                    nq, nn = nq[inside], nn[inside]
                    if depth:
                        q, node = nq, nn
                    else:
                        ok = self.live[nn]
                        nq, nn = nq[ok], nn[ok]
                        ok = np.bitwise_count(part[nq] ^ self.x[nn]) <= limit
                        found_q.append(nq[ok] + lo)
                        found_m.append(nn[ok])
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_m)

    def forest(self, limit: int) -> Iterator[tuple[int, int]]:
        """Links that connect what is connected, each member reached once."""
        for root in range(len(self.x)):
            if not self.live[root]:
                continue
            self.live[root] = False
            front = np.array([root])
            while len(front):
                q, m = self.near(self.x[front], limit)
                m, at = np.unique(m, return_index=True)
                yield from zip(front[q[at]].tolist(), m.tolist())
                self.live[m] = False
                front = m


def links_in_order(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints sorted by Gray rank, of those with equal leading blocks."""
    block = x >> np.uint64(64 - BLOCK_BITS)
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(x)])
    left, right = [], []
    small = np.repeat(size <= SHORT_RUN, size)
    for lag in range(1, SHORT_RUN):
        ok = np.flatnonzero(small[:-lag] & (block[lag:] == block[:-lag])) if len(x) > lag else np.zeros(0, np.int64)
        if not len(ok):
            break
        ok = ok[np.bitwise_count(x[ok] ^ x[ok + lag]) <= limit]
        left.append(ok)
        right.append(ok + lag)
    for a, n in zip(start[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist()):
        pairs = np.array(list(GrayIndex(x[a : a + n]).forest(limit)), np.int64).reshape(-1, 2) + a
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def fingerprint_links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """a, b: links that connect all distinct fingerprints within the limit."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            for k in range(BLOCKS):
                by = np.uint64(BLOCK_BITS * k)
                y = (x << by) | (x >> np.uint64(64 - BLOCK_BITS * k)) if k else x
                # ranks in the order of signed longs; the leading block's own rank leads
                rank = gray_rank(y) ^ np.uint64(1 << 63)
                lead = gray_rank(y >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), k, np.int32)), pa.array(lead), pa.array(rank.view(np.int64)), pa.array(y.view(np.int64))],
                    ["turn", "lead", "rank", "fp"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column("turn").to_numpy().astype(np.int64), b.column("rank").to_numpy(), b.column("fp").to_numpy()]) for b in batches if b.num_rows]
        if not held:
            return
        turn, rank, y = np.concatenate(held, axis=1)
        for k in range(BLOCKS):
            mine = np.flatnonzero(turn == k)
            x = y[mine][np.argsort(rank[mine], kind="stable")].view(np.uint64)
            a, b = links_in_order(x, limit)
            back = np.uint64(BLOCK_BITS * k)
            x = (x >> back) | (x << np.uint64(64 - BLOCK_BITS * k)) if k else x
            for s in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[v[s : s + 100_000]].view(np.int64)) for v in (a, b)], ["a", "b"])

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + 4 * fps.count() // 500_000)
    # equal leading blocks are one key of the range partitioning
    rows = stable(fps.select("fp").mapInArrow(turned, "turn int, lead int, rank long, fp long"))
    return rows.repartitionByRange(parts, "turn", "lead").mapInArrow(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for nodes with a link.

    Every round hooks each node to its smallest neighbour, follows the hooks to
    their ends, and merges what has met there; the links left shrink at least
    by half."""
    edges = stable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nxt = stable(up.join(step, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            done = not nxt.where("moved").limit(1).count()
            up = nxt.select("node", "root")
            if done:
                break
        if roots is None:
            roots = up
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = stable(roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ra, rb = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        met = edges.join(ra, "a").join(rb, "b").where("ra != rb")
        edges = stable(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(fp: DataFrame, limit: int) -> DataFrame:
    """fp, root, component_id of every fingerprint."""
    classes = stable(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(classes, limit))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stable(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document."""
    fp = stable(fingerprints(docs.select("doc_id", "text"), shingle))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fp.join(groups(fp, limit), "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, limit: int = 3) -> DataFrame:
    """The rows of docs, without all but one of each group: that with the smallest
    id (null last), and of rows that repeat it the one with the smallest hash of the text."""
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    fp = stable(fingerprints(docs.select("doc_id", tag.alias("tag"), "text"), shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("f")
    chosen = fp.join(groups(fp, limit), "fp").groupBy("root").agg(first).select("f.doc_id", "f.tag")
    chosen = chosen.select(F.col("doc_id").alias("k"), F.col("tag").alias("g"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", tag.alias("tag"))
    found = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("g")))
    return found.dropDuplicates(["k", "g"]).select("row.*")
