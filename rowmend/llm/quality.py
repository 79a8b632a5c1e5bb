"""A quality score by compression.

Two zstandard dictionaries are built from pieces of labelled text, one from
good and one from bad documents.  A document is compressed piece by piece, all
of it, with either; how many bytes a byte the good dictionary saves, and how
well the text compresses at all, are turned into a probability by a logistic
curve fitted on labelled documents that no dictionary has seen.

What is fitted uses a bounded sample: ``Bounds`` documents of each label, those
with the smallest hashes of their id.  Everything else covers all rows.

Nulls: a null text is an empty one; an empty text gets the share of good
documents among those fitted on; null ids are scored and never labelled; a
label that is null or not 0 or 1 is ignored; of repeated labels the lowest
counts.  If a label is missing altogether, every score is that share (1 if there
are no labels).  Repeated rows get equal scores.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import chunks

PIECE = 1500  # bytes compressed at a time
LEVEL = 3


@dataclass(frozen=True)
class Bounds:
    """Documents of each label for the dictionaries, pieces of each, dictionary
    bytes, and documents of each label for the curve."""

    dictionary_docs: int = 1500
    pieces: int = 6
    dictionary_bytes: int = 65_536
    curve_docs: int = 2500


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if data else zstandard.DICT_TYPE_RAWCONTENT
    held = zstandard.ZstdCompressionDict(data, dict_type=kind) if len(data) >= 8 else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def _features(sizes: np.ndarray) -> np.ndarray:
    """Of good size, bad size and bytes: constant, difference, ratio, their square and product."""
    good, bad, n = sizes.T.astype(float)
    n = np.maximum(n, 1)
    gain, ratio = 20 * (bad - good) / n, 5 * np.minimum(good, bad) / n
    return np.stack([np.ones(len(n)), gain, ratio, ratio * ratio, gain * ratio], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def compressed_sizes(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """doc_id and the other narrow columns, good_size, bad_size, n_bytes."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = _compressor(good), _compressor(bad)
        for batch in batches:
            rest = batch.select(others)
            for c in chunks(batch.column("text")):
                raw, out = c.data.tobytes(), np.zeros((len(c), 3), np.int64)
                for i, (lo, hi) in enumerate(zip(c.off[:-1].tolist(), c.off[1:].tolist())):
                    x = y = 0
                    for k in range(lo, hi, PIECE):
                        piece = raw[k : min(k + PIECE, hi)]
                        x += len(g.compress(piece))
                        y += len(b.compress(piece))
                    out[i] = x, y, hi - lo
                part = rest.slice(c.lo, len(c))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v) for v in out.T.copy())], [*others, *names])

    names = ["good_size", "bad_size", "n_bytes"]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.select(*others, "text").mapInArrow(run, kinds + ", ".join(f"{n} long" for n in names))


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (only rows to learn from)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    total = bounds.dictionary_docs + bounds.curve_docs

    def first(label: int) -> DataFrame:
        return known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(total)

    chosen = first(0).unionByName(first(1)).select(F.col("doc_id").alias("k"), "quality")
    # every second one, by another hash, is for the curve; at most 2 * total ids
    share = int(1000 * bounds.curve_docs / total)
    chosen = chosen.withColumn("curve", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1000)) < share)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist())
            cut = []
            for quality, text in rows:
                raw = (text or "").encode()
                at = list(range(0, len(raw), PIECE))
                step = max(1, -(-len(at) // bounds.pieces))
                cut += [(quality, raw[k : k + PIECE]) for k in at[::step]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _ in cut], pa.int32()), pa.array([p for _, p in cut], pa.binary())], ["quality", "piece"]
            )

    pieces = found.where("not curve").select("quality", "text").mapInArrow(some, "quality int, piece binary").collect()
    by_label = [sorted(bytes(r.piece) for r in pieces if r.quality == label) for label in (0, 1)]
    bad, good = (_dictionary(p, bounds.dictionary_bytes) if p else b"" for p in by_label)
    rows = compressed_sizes(found.where("curve").select("doc_id", "quality", "text"), good, bad).collect()
    y = np.array([r.quality for r in rows], float)
    seen = [len(by_label[0]) + (y == 0).sum(), len(by_label[1]) + (y == 1).sum()]
    # the sample holds both labels alike often; the curve is for the shares among all labelled rows
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if not good or not bad or len(set(y.tolist())) < 2 or not all(seen):
        return Model(good, bad, (), prior)
    rows = sorted(rows, key=lambda r: (r.doc_id, r.n_bytes))
    y = np.array([r.quality for r in rows], float)
    x = _features(np.array([(r.good_size, r.bad_size, r.n_bytes) for r in rows]))
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    return Model(good, bad, tuple(_fit(x, y, weight).tolist()), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, the probability of a good document, and drops the text."""
    sizes = compressed_sizes(docs, model.good, model.bad)
    n = F.greatest("n_bytes", F.lit(1))
    if model.weights:
        gain = F.lit(20.0) * (F.col("bad_size") - F.col("good_size")) / n
        ratio = F.lit(5.0) * F.least("good_size", "bad_size") / n
        c, g, r, rr, gr = model.weights
        z = F.lit(c) + g * gain + r * ratio + rr * ratio * ratio + gr * gain * ratio
        value = F.when(F.col("n_bytes") > 0, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
        value = value.otherwise(model.prior)
    else:
        value = F.lit(model.prior)
    return sizes.withColumn("score", value).drop("good_size", "bad_size", "n_bytes")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are not looked at."""
    model = fit(docs, labels.where(~held_out(folds=folds)).select("doc_id", "quality"), bounds)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(folds=folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
