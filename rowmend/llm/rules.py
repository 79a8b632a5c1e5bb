"""Quality rules: counts of each text, two fixed limits, and an isolation forest.

The forest's trees split the statistics of a few documents at random places;
documents that few splits set apart have short paths and are anomalous.  Each
tree draws its ``sample`` documents anew from all good ones (without labels,
from all documents), as the method has it: at most half of them, and repeated
rows stand for one.  The limit on the path length is the one that sets all
labelled documents apart best, each judged by the trees that have not drawn it.
Counts, paths and the range of the statistics cover every row and text.

Nulls: a null text is an empty one; null ids are judged and never labelled.
Repeated rows are judged alike.  Without labels of both kinds the limit keeps
the share ``1 - contamination`` of the labelled rows, or of all.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.core import stable

from .packed import Chunk, Rolling, byte_hash, chunks, mix, per_doc_sum, words

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# further counts that the forest's ratios are made of
MORE = ["n_bytes", "n_capitals", "n_marks", "n_digits", "n_distinct", "n_lines", "n_capital_words"]
RATIOS = ["mean_word", "symbols", "dup_lines", "repeats", "capitals", "marks", "distinct", "capital_words"]


def _flags(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


SYMBOL = _flags(b"#*$%&|<>")
CAPITAL = _flags(bytes(range(65, 91)))
MARK = _flags(b"!?;:()[]{}\"'/\\=+_@^~`")
DIGIT = _flags(b"0123456789")


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each document has, and how often each row's value is in its document."""
    key = mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(doc[first], minlength=n), count[back]


def _count(c: Chunk) -> np.ndarray:
    n = len(c)
    first, end, off = words(c)
    data, b_off = c.data, c.off
    solid = np.zeros(len(data) + 1, np.int64)
    lead = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[end] -= 1  # a word may begin where another ends, at a document's border
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    np.cumsum(inside, out=solid[1:])
    per = lambda flags: per_doc_sum(flags, b_off)
    n_words = np.diff(off)
    doc = np.repeat(np.arange(n), n_words)
    hashed = byte_hash(c)
    word = hashed.of(first, end) if len(first) else np.zeros(0, np.uint64)
    n_distinct, _ = _distinct(doc, word, n)
    # lines: the text between \n, within a document
    brk = np.flatnonzero(data == 10)
    l_start = np.unique(np.concatenate([b_off[:-1], brk + 1]))
    l_doc = np.minimum(np.searchsorted(b_off, l_start, "right") - 1, n - 1)
    l_end = np.minimum(np.append(brk, len(data))[np.searchsorted(brk, l_start)], b_off[l_doc + 1])
    l_end = np.maximum(l_end, l_start)
    used = solid[l_end] > solid[l_start]
    line_doc = l_doc[used]
    line = hashed.of(l_start[used], l_end[used]) if used.any() else np.zeros(0, np.uint64)
    n_lines = np.bincount(line_doc, minlength=n)
    lines_apart, _ = _distinct(line_doc, line, n)
    # windows
    w_start = np.flatnonzero(np.arange(len(doc)) + WINDOW <= off[1:][doc]) if len(doc) else np.zeros(0, np.int64)
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(w_start):
        window = Rolling(word, 1).of(w_start, w_start + WINDOW)
        _, times = _distinct(doc[w_start], window, n)
        again = w_start[times > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeated = np.cumsum(covered)[: len(doc)] > 0
    caps = CAPITAL[data]
    cap_sum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(caps, out=cap_sum[1:])
    loud = (cap_sum[end] - cap_sum[first]) * 2 > (end - first) if len(first) else np.zeros(0, bool)
    loud &= (end - first) > 1
    return np.stack([
        n_words, per(inside & lead), per(SYMBOL[data]), n_lines - lines_apart, np.bincount(doc[repeated], minlength=n),
        np.diff(b_off), per(caps), per(MARK[data]), per(DIGIT[data]), n_distinct, n_lines, np.bincount(doc[loud], minlength=n),
    ]).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and MORE of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for c in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.lo, len(c)), *(pa.array(v) for v in _count(c))], ["doc_id", *COUNTS, *MORE]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS + MORE))


def ratios(t: dict[str, np.ndarray]) -> np.ndarray:
    """RATIOS, those that are mostly near zero by their logarithm."""
    w, b = np.maximum(t["n_words"], 1), np.maximum(t["n_bytes"], 1)
    share = lambda part, whole, least: np.log10(least + part / whole)
    return np.stack([
        np.log10(np.maximum(t["word_chars"], 1) / w), share(t["n_symbols"], b, 0.01),
        share(t["n_dup_lines"], np.maximum(t["n_lines"], 1), 0.1), share(t["n_repeat_words"], w, 0.1),
        share(t["n_capitals"], b, 0.05), share(t["n_marks"], b, 0.01),
        np.log10((1 + t["n_distinct"]) / (1 + np.sqrt(w))), share(t["n_capital_words"], w, 0.05),
    ], axis=1)


@dataclass
class Tree:
    """Arrays of nodes: feature (-1: a leaf), cut, left child, and the depth a leaf stands for."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray

    def path(self, x: np.ndarray) -> np.ndarray:
        """Path length of each row."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return self.depth[node]
            at = node[inner]
            node[inner] = self.child[at] + (x[rows[inner], self.feature[at]] >= self.cut[at])


@dataclass
class Forest:
    """Trees, and of each its number and the last key that it has drawn."""

    trees: list[Tree]
    number: list[int]
    last: list[int]

    def path(self, x: np.ndarray, key: np.ndarray | None = None, drawn_from: np.ndarray | None = None) -> np.ndarray:
        """Mean path length of each row; of rows with ``drawn_from``, in the trees that have not
        drawn them, if there are any."""
        total, total_out, n_out = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for tree, k, last in zip(self.trees, self.number, self.last):
            length = tree.path(x)
            total += length
            if key is not None:
                out = ~(drawn_from & (tree_key(key, k) <= np.uint64(last)))
                total_out += np.where(out, length, 0.0)
                n_out += out
        total /= max(1, len(self.trees))
        return np.where((n_out > 0) & (n_out < len(self.trees)), total_out / np.maximum(n_out, 1), total)


def tree_key(key: np.ndarray, tree: int) -> np.ndarray:
    """The order in which a tree draws rows."""
    return mix(key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64))


def expected_depth(n: int) -> float:
    """Mean depth at which an unsuccessful search ends in a random binary tree of n."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(own: np.ndarray, low: np.ndarray, high: np.ndarray, seed: list[int]) -> Tree:
    """A tree over the rows it has drawn, cut anywhere in the box from ``low`` to ``high`` that
    all documents fill: so where none of the rows lie, paths end early."""
    rng = np.random.default_rng(seed)
    most = 2 * int(np.ceil(np.log2(max(2, len(own)))))
    feature, cut, child, depth, todo = [-1], [0.0], [0], [0.0], [(0, own, low, high, 0)]
    while todo:
        at, rows, lo, hi, level = todo.pop()
        able = np.flatnonzero(hi > lo)
        if level >= most or len(rows) < 2 or not len(able):
            depth[at] = level + expected_depth(len(rows))
            continue
        f = int(rng.choice(able))
        where = float(rng.uniform(lo[f], hi[f]))
        right = rows[:, f] >= where
        feature[at], cut[at], child[at] = f, where, len(feature)
        for side, name in ((~right, "hi"), (right, "lo")):
            box = {"lo": lo.copy(), "hi": hi.copy()}
            box[name][f] = where
            todo.append((len(feature), rows[side], box["lo"], box["hi"], level + 1))
            feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(depth))


def _features(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return ratios({c: batch.column(c).to_numpy() for c in COUNTS + MORE})


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("key").to_numpy().astype(np.int64).view(np.uint64)


def forest(good: DataFrame, low: np.ndarray, high: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Trees that draw from all rows of ``good`` (key, COUNTS, MORE; no key twice), each in a task of its own."""
    n = good.count()
    want = min(sample, (n + 1) // 2)
    # somewhat more than wanted of each tree's smallest keys; the tree takes the smallest of them
    share = min(1.0, (want + 8 * want**0.5 + 20) / max(1, n))
    below = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(trees if batch.num_rows else 0):
                key = tree_key(_keys(batch), k)
                at = np.flatnonzero(key <= below)
                if len(at):
                    values = batch.select(COUNTS + MORE).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k, np.int32)), pa.array(key[at].view(np.int64)), *values.columns], ["tree", "key", *COUNTS, *MORE]
                    )

    def grown(group: pa.Table) -> pa.Table:
        key, k = _keys(group), group.column("tree")[0].as_py()
        first = np.argsort(key)[:want]
        t = grow(_features(group)[first], low, high, [seed, k])
        return pa.table({
            "tree": pa.array([k], pa.int32()), "last": pa.array([int(key[first[-1]].view(np.int64))]), "feature": [t.feature.tolist()],
            "cut": [t.cut.tolist()], "child": [t.child.tolist()], "depth": [t.depth.tolist()],
        })

    longs = ", ".join(f"{c} long" for c in COUNTS + MORE)
    drawn = good.select("key", *COUNTS, *MORE).mapInArrow(draw, f"tree int, key long, {longs}")
    shape = "tree int, last long, feature array<long>, cut array<double>, child array<long>, depth array<double>"
    rows = sorted(drawn.groupBy("tree").applyInArrow(grown, shape).collect())  # as large as the parameters say
    return Forest(
        [Tree(np.array(r.feature, np.int64), np.array(r.cut), np.array(r.child, np.int64), np.array(r.depth)) for r in rows],
        [r.tree for r in rows], [r.last % 2**64 for r in rows],
    )


def path_limit(tried: DataFrame, keep: float, contamination: float) -> float:
    """The path length below which a document goes, over all rows of ``tried`` (path, good): what sets
    the labels apart best (share of bad that goes less share of good that goes), if ``keep`` of the
    good stay; with one label only, the quantile ``contamination``."""
    each = tried.groupBy("path").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    # ranges of paths, whose sums give what lies before each
    each = stable(each.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    sums = each.groupBy("part").agg(F.sum("n_good").alias("g"), F.sum("n_bad").alias("b")).orderBy("part").collect()
    n_good, n_bad = sum(r.g for r in sums), sum(r.b for r in sums)
    if not n_good + n_bad:
        return -np.inf
    start, g, b = [], 0, 0
    for r in sums:
        start.append((r.part, g, b))
        g, b = g + r.g, b + r.b
    start = F.broadcast(each.sparkSession.createDataFrame(start, "part int, g long, b long"))
    earlier = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, at: F.col(at) + F.coalesce(F.sum(n).over(earlier), F.lit(0))
    each = each.join(start, "part").select("path", "n_good", "n_bad", before("n_good", "g").alias("gone_good"), before("n_bad", "b").alias("gone_bad"))
    if not (n_good and n_bad):
        place = contamination * (n_good + n_bad - 1)
        low, high = (
            each.where((F.col("gone_good") + F.col("gone_bad") <= k) & (F.col("gone_good") + F.col("gone_bad") + F.col("n_good") + F.col("n_bad") > k)).first().path
            for k in (int(np.floor(place)), int(np.ceil(place)))
        )
        return low + (high - low) * (place - np.floor(place))
    value = F.col("gone_bad") / n_bad - F.col("gone_good") / n_good
    return each.where(F.col("gone_good") / n_good <= 1 - keep).select("path", value.alias("v")).orderBy(F.desc("v"), F.desc("path")).first().path


def judge(
    docs: DataFrame,
    labels: DataFrame,
    min_words: int = 10,
    max_repeat: int = 20,
    trees: int = 150,
    sample: int = 256,
    keep: float = 0.99,
    contamination: float = 0.05,
    seed: int = 11,
) -> DataFrame:
    """doc_id, COUNTS, base_failed, path (mean path length) and kept of every document."""
    stats = stable(statistics(docs))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    passed = stats.where(~base_failed).withColumn("key", F.xxhash64("doc_id", *COUNTS, *MORE))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.min("quality").alias("quality"))
    picked = passed.join(known, F.col("doc_id") == F.col("k")).select("key", *COUNTS, *MORE, (F.col("quality") == 1).alias("good"))
    if not picked.where("good").limit(1).count():
        picked = passed.select("key", *COUNTS, *MORE, F.lit(True).alias("good"))
    picked = stable(picked)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _features(batch)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in np.stack([x.min(axis=0), x.max(axis=0)]).T.copy()], RATIOS)

    span = passed.select(*COUNTS, *MORE).mapInArrow(extremes, ", ".join(f"{c} double" for c in RATIOS))
    box = span.agg(*[F.min(c).alias(f"lo_{c}") for c in RATIOS], *[F.max(c).alias(f"hi_{c}") for c in RATIOS]).first()
    low, high = (np.array([box[f"{side}_{c}"] for c in RATIOS], float) for side in ("lo", "hi"))
    grown = forest(picked.where("good").dropDuplicates(["key"]), low, high, trees, sample, seed)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = batch.column("good").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(grown.path(_features(batch), _keys(batch), good)), batch.column("good")], ["path", "good"])

    limit = path_limit(picked.mapInArrow(tried, "path double, good boolean"), keep, contamination)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ["doc_id", *COUNTS]] + [pa.array(grown.path(_features(batch)))], ["doc_id", *COUNTS, "path"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", path double")
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("path") >= limit))
