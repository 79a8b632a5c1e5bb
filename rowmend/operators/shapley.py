"""Nearest-neighbour Shapley values of training rows.

For one validation row, sort the training rows by distance and let ``u`` be
the utility of a row.  With c(j) = min(K, j) / (K j) the value of the row at
rank i is

    s(i) = u(i) c(i) + sum over j > i of u(j) (c(j) - c(j-1)),

and the value of a training row is the mean over the validation rows.

Rows at the same distance get the same value (they are exchangeable), so the
value depends only on how many rows of each label lie in each distance step: a
closed form averages over the orders inside a step.  The caller chooses:

``steps=None``, the strict order: only equal distances (to 2^-32 of an octave)
share a step.  ``steps=128``, say, per octave of the squared distance: a step over
the ranks a..b moves a value by less than 1/a - 1/b.

``error=0.001``, say: only the nearest rows are valued, the others get 0.  Beyond rank
K* = range of u / error a value is at most ``error``, and so is what the rows there
take from the nearer ones; so no score is off by more, and per validation row about
K* rows are sorted and looked at, not all.

With n rows and the utility u0 for the first label, the value is u0 c(n) plus, for each
further label l, (ul - u0) times a gain that depends on the labels and the distances alone.  So
one pass over the distances serves any number of utilities (``knn_shapley_of``), and the gains of
validation rows with equal utilities are added up as they are.  In the strict order the gains
come from one sort of whole numbers, (step, place of the row, label), and a running sum.

No pair of rows goes through a shuffle, and no row through the driver.  Training
rows are packed into chunks, validation rows dealt out to blocks; each block meets
all chunks in its task, which keeps their features in a file if they are many.  If there are more
training rows than a task takes, a block meets them in splits: the splits' counts per step are
added up per validation row, turned into values, and the values meet the chunks.  What a block
gives to a chunk is one array of sums, so the shuffle carries (training rows) x (blocks) numbers;
there are as many blocks as keep the cores busy, whatever the number of validation rows.

Octaves are those of the floats, with no lower or upper limit; distance zero has
a step of its own.  A feature that is NULL or NaN is an error.
"""

from __future__ import annotations

import math
import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import spread, stable
from .ranking import score_rank

COARSE_STEPS = 128  # per octave
FINE_STEPS = 1 << 32  # per octave: only equal distances share a step
ZERO, BEYOND = -(1 << 60), 1 << 60  # steps of distance zero, and of one too large for a double
CHUNK_VALUES = 512  # features of the training rows of a chunk: what Arrow sends at once are 10,000 chunks
SPLIT_VALUES = 32_000_000  # numbers that a task holds for its training rows, features not counted
BLOCK_ROWS = 65_536  # validation rows of a block at most
BLOCK_VALUES = 2_000_000  # their features and utilities at most
BLOCK_CELLS = 4_000_000  # steps of a block's validation rows whose values a task holds, about
HELD_VALUES = 6_000_000  # features that a task holds in memory; more are in a file
PIECE_VALUES = 1_000_000  # features that are read from it at once
DISTANCES = 4_000_000  # distances that are taken together
TILE = 16_384
DENSE = 1 << 20  # steps that are counted in an array

# the task functions below travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _steps_of(d2: np.ndarray, steps: int) -> np.ndarray:
    if len(d2) and 0 < d2.min() and d2.max() < np.inf:
        return np.floor(np.log2(d2) * steps).astype(np.int64)
    usual = (d2 > 0) & np.isfinite(d2)
    raw = np.floor(np.log2(np.where(usual, d2, 1.0)) * steps).astype(np.int64)
    return np.where(usual, raw, np.where(d2 > 0, BEYOND, ZERO))


def _matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    if len(cols) == 1 and pa.types.is_list(batch.column(cols[0]).type):
        flat = batch.column(cols[0]).flatten().to_numpy(zero_copy_only=False)
        x = flat.astype(np.float64).reshape(batch.num_rows, -1)
    else:
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols])
    if np.isnan(x).any():
        raise ValueError("a feature is NULL or NaN; impute before distances are taken")
    return x


def with_utility(val: DataFrame, utility: str | Callable[[object], Column], labels: Sequence = (0, 1)) -> DataFrame:
    """Adds ``u0``, ``u1`` and so on: what a training row of the first, second, ... label is
    worth to a validation row as its neighbour.

    "accuracy": 1 when the labels agree.  "parity": the gain in the negative
    demographic-parity gap, linearised at the rates of ``pred``: a 1 in the group
    that is ahead costs one over that group's size, in the other it gains that.  Or a function that makes a column over ``val`` from a label.
    """
    if callable(utility):
        return val.withColumns({f"u{i}": utility(label).cast("double") for i, label in enumerate(labels)})
    if utility == "accuracy":
        return val.withColumns({f"u{i}": (F.col("y") == label).cast("double") for i, label in enumerate(labels)})
    if list(labels) != [0, 1]:
        raise ValueError("parity is for the labels 0 and 1")
    group = F.col("protected")
    sums = val.agg(
        F.count_if(group).alias("size"), F.count_if(~group).alias("others"),
        F.sum(F.when(group, F.col("pred"))).cast("double").alias("ones"),
        F.sum(F.when(~group, F.col("pred"))).cast("double").alias("other_ones"),
    ).first()
    if not sums["size"] or not sums["others"]:
        return val.withColumns({"u0": F.lit(0.0), "u1": F.lit(0.0)})
    # rates compared without dividing
    lead = float(np.sign(sums["ones"] * sums["others"] - sums["other_ones"] * sums["size"]))
    gain = F.when(group, F.lit(-lead / sums["size"])).otherwise(F.lit(lead / sums["others"]))
    return val.withColumns({"u0": F.lit(0.0), "u1": gain})


def _chunks(train: DataFrame, cols: Sequence[str], labels: Sequence) -> DataFrame:
    """Training rows, packed: chunk, n, width (features), x and y (place of the label), and ids."""
    names = np.array(labels)
    order = np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            x, given = _matrix(batch, cols), batch.column("y").to_numpy(zero_copy_only=False)
            y = order[np.minimum(np.searchsorted(names[order], given), len(names) - 1)]
            if (names[y] != given).any():
                raise ValueError(f"a training label is none of {list(labels)}")
            ids = batch.column("row_id").to_numpy(zero_copy_only=False).astype(np.int64)
            size = max(1, CHUNK_VALUES // x.shape[1])
            parts = [slice(lo, lo + size) for lo in range(0, len(x), size)]
            packed = [pa.array([v[part].tobytes() for part in parts], pa.binary()) for v in (x, y.astype(np.int32), ids)]
            heads = [
                pa.array(np.arange(chunk, chunk + len(parts))), pa.array([len(y[part]) for part in parts], pa.int32()),
                pa.array(np.full(len(parts), x.shape[1], np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([*heads, *packed], ["chunk", "n", "width", "x", "y", "ids"])
            chunk += len(parts)

    return train.mapInArrow(run, "chunk bigint, n int, width int, x binary, y binary, ids binary")


def _heads(val: DataFrame, cols: Sequence[str], us: Sequence[str]) -> DataFrame:
    """Validation rows, packed: key, a (features), b (utilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, cols)
                u = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in us])
                packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, u)]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), *packed], ["key", "a", "b"])

    return val.select(F.col("row_id").cast("long").alias("row_id"), *us, *cols).mapInArrow(run, "key bigint, a binary, b binary")


def _harmonic(n: np.ndarray) -> np.ndarray:
    table = np.r_[0.0, np.cumsum(1.0 / np.arange(1, 64))]
    m = np.maximum(n, 64).astype(np.float64)
    series = np.log(m) + np.euler_gamma + 0.5 / m - (1 / 12 - (1 / 120 - 1 / 252 / m**2) / m**2) / m**2
    return np.where(n < 64, table[np.clip(n, 0, 63)], series)


def _step_shares(a: np.ndarray, b: np.ndarray, m: np.ndarray, k: int, harmonic: Callable = _harmonic) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of steps over the ranks a..b: the mean share c(j), the drop c(a-1) - c(b), and what each of the other rows of the step takes."""

    def shares_to(n):  # sum of c(j) for j <= n
        return np.where(n <= k, n / k, 1.0 + harmonic(n) - _harmonic(np.array(k)))

    # drop c(j-1) - c(j) = 1 / (j (j-1)) for j > k and 0 before
    start = np.maximum(a, k + 1)
    some = b >= start
    drop_all = np.where(some, 1.0 / (start - 1) - 1.0 / b, 0.0)
    # sum of (j - a) * drop(j) over the step
    drop_in = np.where(some, harmonic(b - 1) - harmonic(start - 2) - a * drop_all, 0.0)
    own = (shares_to(b) - shares_to(a - 1)) / m
    inner = np.where(m > 1, drop_in / np.maximum(m * (m - 1.0), 1.0), 0.0)
    return own, drop_all, inner


def _values(counts: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """Value of a row of each label in each step, the nearest step first.

    A step covers the ranks a..b of the validation row; the value is the mean over
    all orders of its rows."""
    m = counts.sum(axis=1)
    b = np.cumsum(m)
    own, drop_all, inner = _step_shares(b - m + 1, b, m, k)
    total = counts @ u
    tail = total / m * drop_all
    after = np.r_[np.cumsum(tail[::-1])[::-1][1:], 0.0]
    return u[None, :] * own[:, None] - (total[:, None] - u[None, :]) * inner[:, None] - after[:, None]


class _Sums:
    """What validation rows give to the training rows of a task, for each utility."""

    def __init__(self, n: int, n_utils: int, n_labels: int):
        self.totals = np.zeros((n_utils, n))
        self.gains = np.zeros((n_labels - 1, n))  # of validation rows with the utilities ``u``
        self.u: np.ndarray | None = None
        self.base = np.zeros(n_utils)

    def begin(self, u: np.ndarray, last_share: float) -> None:
        """The gains that follow are those of a validation row with the utilities ``u``, of utilities and labels."""
        if self.u is None or not np.array_equal(u, self.u):
            self._flush()
            self.u = u
        self.base += u[:, 0] * last_share

    def _flush(self) -> None:
        if self.u is None:
            return
        for total, u in zip(self.totals, self.u):
            for gain, more in zip(self.gains, u[1:] - u[0]):
                if more:
                    for lo in range(0, len(total), TILE):
                        total[lo : lo + TILE] += more * gain[lo : lo + TILE]
        self.gains[:] = 0.0

    def done(self) -> np.ndarray:
        self._flush()
        self.totals += self.base[:, None]
        return self.totals


class _Strict:
    """Gains in the strict order, from one sort of whole numbers."""

    def __init__(self, y: np.ndarray, n_labels: int, k: int):
        n = len(y)
        self.y, self.k, self.labels = y, k, n_labels
        self.label_bits = max(1, (n_labels - 1).bit_length())
        self.bits = self.label_bits + max(1, (n - 1).bit_length())
        self.low = (np.arange(n) << self.label_bits) | y
        # the farthest row comes first: rank n, n - 1, ...
        rank = np.arange(n, 0, -1, dtype=np.float64)
        self.drop = np.where(rank > k, 1.0 / (rank * np.maximum(rank - 1.0, 1.0)), 0.0)
        self.share = np.minimum(rank, k) / (k * rank) + self.drop  # its own and the drop that is taken back
        self.sums = _harmonic(np.arange(n + k + 1))
        self.key, self.at = np.empty(n, np.int64), np.empty(n, np.int64)
        self.is_label, self.room, self.out = np.empty(n), np.empty(n), np.empty(n)

    def fits(self, span: float) -> bool:
        return (int(span) + 4) << self.bits < 1 << 63

    def add(self, step: np.ndarray, top: float, gains: np.ndarray) -> None:
        """Adds each row's gains; ``step`` holds whole numbers up to ``top``, and is lost."""
        np.subtract(top, step, out=step)
        key, at, n = self.key, self.at, len(self.key)
        np.copyto(key, step, casting="unsafe")
        np.left_shift(key, self.bits, out=key)
        np.bitwise_or(key, self.low, out=key)
        key.sort()
        np.right_shift(key, self.bits, out=at)
        tied = np.flatnonzero(at[1:] == at[:-1])
        label_of = (1 << self.label_bits) - 1
        groups = starts = None
        if 8 * len(tied) > n:
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            m = np.diff(starts, append=n)
            shares = _step_shares(n - starts - m + 1, n - starts, m, self.k, self.sums.__getitem__)
        elif len(tied):  # rows of one step get the mean over their orders
            new = np.flatnonzero(np.diff(tied, prepend=-2) > 1)
            first, last = tied[new], tied[np.r_[new[1:] - 1, len(tied) - 1]] + 1
            m = last - first + 1
            within = np.repeat(np.arange(len(m)), m)
            rows = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + first[within]
            own, _, inner = _step_shares(n - last, n - first, m, self.k, self.sums.__getitem__)
            groups = first, within, rows, own[within], inner[within], m
        for label in range(1, self.labels):
            if self.labels == 2:
                np.bitwise_and(key, 1, out=at)
                np.copyto(self.is_label, at, casting="unsafe")
            else:
                np.copyto(self.is_label, (key & label_of) == label, casting="unsafe")
            mine = self.is_label
            if starts is None:
                self._one_by_one(mine, groups)
            else:
                own, drop, inner = shares
                count = np.add.reduceat(mine, starts)
                taken = count / m * drop
                mine *= np.repeat(own + inner, m)
                mine -= np.repeat(count * inner + np.cumsum(taken) - taken, m)
            np.right_shift(key, self.label_bits, out=at)
            np.bitwise_and(at, (1 << (self.bits - self.label_bits)) - 1, out=at)
            self.out[at] = mine
            gains[label - 1] += self.out

    def _one_by_one(self, mine: np.ndarray, groups: tuple | None) -> None:
        """Whether rows have the label becomes their gain; ``groups``: the rows that share a step."""
        sums = self.room
        if groups is not None:
            first, within, rows, own, inner, m = groups
            given = mine[rows]
            count = np.bincount(within, given, len(m))
            mine[rows] = (count / m)[within]
        np.multiply(mine, self.drop, out=sums)
        np.cumsum(sums, out=sums)
        np.multiply(mine, self.share, out=mine)
        np.subtract(mine, sums, out=mine)
        if groups is not None:
            after = np.where(first > 0, sums[np.maximum(first - 1, 0)], 0.0)
            mine[rows] = given * own - (count[within] - given) * inner - after[within]


class _Rows:
    """Training rows of a task, by columns; if they have many features, those are in a file of the task."""

    def __init__(self, n_labels: int, width: int):
        self.labels, self.width = n_labels, width
        self.names: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.pieces: list[tuple[int, np.ndarray | int]] = []  # rows, and their features or place in the file
        self.ys: list[np.ndarray] = []
        self.file, self.held = None, 0

    def add(self, names: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.names.append(names)
        self.sizes.append(sizes)
        self.ys.append(y)
        step = max(1, PIECE_VALUES // self.width)
        for lo in range(0, len(x), step):
            part = np.asfortranarray(x[lo : lo + step])
            if self.held + part.size <= HELD_VALUES:
                self.held += part.size
                self.pieces.append((len(part), part))
                continue
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.pieces.append((len(part), self.file.seek(0, 2)))
            self.file.write(part.T.data)

    def ready(self) -> "_Rows":
        self.y = np.concatenate(self.ys)
        self.names, self.sizes, self.ys = [np.concatenate(self.names)], [np.concatenate(self.sizes)], []
        return self

    def _tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        for n, x in self.pieces:
            if isinstance(x, int):
                part = np.empty((self.width, n))
                self.file.seek(x)
                self.file.readinto(part.reshape(-1).view(np.uint8))
                x = part.T
            for lo in range(0, n, TILE):
                tile = x[lo : lo + TILE]
                yield at, tile
                at += len(tile)

    def distances(self, vs: list[np.ndarray]) -> np.ndarray:
        """Squared, added up feature by feature; a row of them for each of ``vs``."""
        d2 = np.zeros((len(vs), len(self.y)))
        room = np.empty(TILE)
        for lo, x in self._tiles():
            for v, whole in zip(vs, d2):
                tile, diff = whole[lo : lo + len(x)], room[: len(x)]
                for j in range(self.width):
                    np.subtract(x[:, j], v[j], out=diff)
                    np.multiply(diff, diff, out=diff)
                    np.add(tile, diff, out=tile)
        return d2

    def each(self, tops: list[tuple]) -> Iterator[tuple[tuple, np.ndarray]]:
        """The validation rows, and their distances."""
        some = max(1, min(16, DISTANCES // max(1, len(self.y))))
        for lo in range(0, len(tops), some):
            group = tops[lo : lo + some]
            yield from zip(group, self.distances([top[1] for top in group]))

    def cells(self, d2: np.ndarray, steps: int, near: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps in order, rows per step and label, the rows that are in them, and each one's place among the steps.

        With ``near`` at least the steps that hold the nearest ``near`` rows; others may be missing."""
        rows = None
        if near is not None and near < len(d2):
            far = np.partition(d2, near - 1)[near - 1]
            # a step that begins within reach is taken whole
            reach = far if far == 0 or not np.isfinite(far) else far * 2.0 ** (2.0 / steps)
            rows = np.flatnonzero(d2 <= reach)
            step = _steps_of(d2[rows], steps)
            inside = step <= _steps_of(np.array([far]), steps)[0]
            rows, step = rows[inside], step[inside]
        else:
            step = np.concatenate([_steps_of(d2[lo : lo + TILE], steps) for lo in range(0, len(d2), TILE)])
        y = self.y if rows is None else self.y[rows]
        usual = np.abs(step) < BEYOND
        whole = bool(usual.all())
        some = step if whole else step[usual]
        low, high = (int(some.min()), int(some.max())) if len(some) else (0, 0)
        if high - low < DENSE:
            code = step - (low - 1) if whole else np.where(usual, step - (low - 1), np.where(step < 0, 0, high - low + 2))
            counts = np.bincount(code * self.labels + y, minlength=(high - low + 3) * self.labels).reshape(-1, self.labels)
            used = np.flatnonzero(counts.any(axis=1))
            at = np.cumsum(counts.any(axis=1)) - 1
            named = used + (low - 1)
            named = np.where(used == 0, ZERO, np.where(used == high - low + 2, BEYOND, named))
            return named, counts[used], rows, at[code]
        named, at = np.unique(step, return_inverse=True)
        return named, np.bincount(at * self.labels + y, minlength=len(named) * self.labels).reshape(-1, self.labels), rows, at

    def hand_out(self, block: int, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        """chunk, block, part: the sums of each chunk's rows, utility by utility."""
        names, sizes = self.names[0], self.sizes[0]
        ends = np.cumsum(sizes)
        for lo in range(0, len(names), 1000):
            hi = min(lo + 1000, len(names))
            parts = [totals[:, e - n : e].tobytes() for e, n in zip(ends[lo:hi], sizes[lo:hi])]
            yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi]), pa.array(np.full(hi - lo, block, np.int32)), pa.array(parts, pa.binary())], SUMS)


def _gains(rows: _Rows, tops: list[tuple], k: int, steps: int, n_utils: int) -> np.ndarray:
    """What all ranks get from the validation rows, for each utility."""
    n, labels = len(rows.y), rows.labels
    sums, strict, last_share = _Sums(n, n_utils, labels), None, min(k, n) / (k * n)
    counted, room = np.empty(min(n, TILE), np.int64), np.empty(min(n, TILE))
    # rows with equal utilities one after the other
    for (_, _, u, _, _), step in rows.each(sorted(tops, key=lambda top: top[2].tobytes())):
        sums.begin(u, last_share)
        with np.errstate(divide="ignore", invalid="ignore"):
            for lo in range(0, n, TILE):
                tile = step[lo : lo + TILE]
                np.log2(tile, out=tile)
                np.multiply(tile, steps, out=tile)
                np.floor(tile, out=tile)
        low, high = step.min(), step.max()
        if not (np.isfinite(low) and np.isfinite(high)):  # distance zero, or one too large for a double
            usual = step[np.isfinite(step)]
            low, high = (usual.min(), usual.max()) if len(usual) else (0.0, 0.0)
            step[:] = np.where(step == np.inf, high + 1, np.where(np.isfinite(step), step, low - 1))
        if high - low < DENSE:
            cells = int(high - low) + 3
            counts = np.zeros(cells * labels, np.int64)
            codes = step.view(np.int64)  # in their place
            for lo in range(0, n, TILE):
                tile = step[lo : lo + TILE]
                code, x = counted[: len(tile)], room[: len(tile)]
                np.subtract(tile, low - 1, out=x)
                np.copyto(code, x, casting="unsafe")
                np.multiply(code, labels, out=code)
                np.add(code, rows.y[lo : lo + TILE], out=code)
                counts += np.bincount(code, minlength=len(counts))
                codes[lo : lo + TILE] = code
            counts = counts.reshape(-1, labels)
            used = counts.any(axis=1)
            for label in range(1, labels):
                table = np.zeros((cells, labels))
                table[used] = _values(counts[used], (np.arange(labels) == label).astype(np.float64), k)
                table = table.ravel()
                for lo in range(0, n, TILE):
                    tile = codes[lo : lo + TILE]
                    x = np.take(table, tile, out=room[: len(tile)], mode="clip")
                    sums.gains[label - 1, lo : lo + TILE] += x
            continue
        strict = strict or _Strict(rows.y, labels, k)
        if strict.fits(high - low):
            strict.add(step, high + 1, sums.gains)
            continue
        named, at = np.unique(step, return_inverse=True)
        counts = np.bincount(at * labels + rows.y, minlength=len(named) * labels).reshape(-1, labels)
        for label in range(1, labels):
            table = _values(counts, (np.arange(labels) == label).astype(np.float64), k)
            sums.gains[label - 1] += table.ravel()[at * labels + rows.y]
    return sums.done()


def _within(counts: np.ndarray, near: int | None) -> int:
    """How many of the steps hold the nearest rows."""
    if near is None:
        return len(counts)
    return int(np.searchsorted(np.cumsum(counts.sum(axis=1)), near)) + 1 if len(counts) else 0


def _met(heads: DataFrame, chunks: DataFrame, blocks: int, splits: int) -> DataFrame:
    """Each block's validation rows, and then the chunks of a split, in one partition for each block and split."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    tops = heads.select(
        block.alias("block"), every(splits).alias("split"), F.lit(0).alias("kind"), "key", F.lit(0).alias("n"), "a", "b",
        _or_null(heads, "c"), _or_null(heads, "d"),
    )
    split = F.pmod(F.xxhash64("chunk"), F.lit(splits)).cast("int").alias("split")
    none = F.lit(None).cast("binary")
    rest = chunks.select(
        every(blocks).alias("block"), split, F.lit(1).alias("kind"), F.col("chunk").alias("key"), "n", F.col("x").alias("a"), F.col("y").alias("b"),
        none.alias("c"), none.alias("d"),
    )
    place = F.col("block") * splits + F.col("split")
    return tops.unionByName(rest).repartitionById(blocks * splits, place.cast("int")).sortWithinPartitions("block", "split", "kind", "key")


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("binary").alias(name)


def _packed(column: pa.Array, lo: int, hi: int, dtype: type) -> np.ndarray:
    """The numbers of binary rows lo to hi, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + lo : column.offset + hi + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)


def _parties(batches: Iterator[pa.RecordBatch], n_labels: int) -> Iterator[tuple]:
    """(block, split, validation rows, training rows) of a task, one after the other."""
    at, tops, rows = None, [], None
    for batch in batches:
        block, split, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "split", "kind"))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (split[1:] != split[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]) if batch.num_rows else ():
            if (block[lo], split[lo]) != at:
                if tops and rows:
                    yield *at, tops, rows.ready()
                at, tops, rows = (block[lo], split[lo]), [], None
            some = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                for key, a, b, c, d in zip(*(some.column(name).to_pylist() for name in ("key", "a", "b", "c", "d"))):
                    tops.append((key, np.frombuffer(a, np.float64), np.frombuffer(b, np.float64).reshape(-1, n_labels), c, d))
                continue
            sizes = some.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            x = _packed(batch.column("a"), lo, hi, np.float64).reshape(sizes.sum(), -1)
            rows = rows or _Rows(n_labels, x.shape[1])
            rows.add(some.column("key").to_numpy(), sizes, x, _packed(batch.column("b"), lo, hi, np.int32).astype(np.int64))
            del x, some
        del batch
    if tops and rows:
        yield *at, tops, rows.ready()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


SUMS = ["chunk", "block", "part"]
CELLS = (["key", "split", "a", "u", "steps", "counts"], [pa.int64(), pa.int32(), *[pa.binary()] * 4])


def _in_one(met: DataFrame, k: int, steps: int, near: int | None, n_utils: int, n_labels: int) -> DataFrame:
    """chunk, block, part: what a block's validation rows give to the chunk's rows, if the block meets all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, tops, rows in _parties(batches, n_labels):
            if near is None:
                yield from rows.hand_out(block, _gains(rows, tops, k, steps, n_utils))
                continue
            totals = np.zeros((n_utils, len(rows.y)))
            for (_, _, us, _, _), d2 in rows.each(tops):
                _, counts, chosen, at = rows.cells(d2, steps, near)
                m = _within(counts, near)
                for total, u in zip(totals, us):
                    values = np.zeros((len(counts), n_labels))
                    values[:m] = _values(counts[:m], u, k)
                    if chosen is None:
                        total += values.ravel()[at * n_labels + rows.y]
                    else:
                        total[chosen] += values.ravel()[at * n_labels + rows.y[chosen]]
            yield from rows.hand_out(block, totals)

    return met.mapInArrow(run, "chunk bigint, block int, part binary")


def _counted(met: DataFrame, steps: int, near: int | None, n_labels: int) -> DataFrame:
    """key, split, a, u, steps, counts: a split's rows per step and label for each validation row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, split, tops, rows in _parties(batches, n_labels):
            for (key, v, u, _, _), d2 in rows.each(tops):
                named, counts, _, _ = rows.cells(d2, steps, near)
                yield _batch([(key, split, v.tobytes(), u.tobytes(), named.tobytes(), counts.astype(np.int64).tobytes())], *CELLS)

    return met.mapInArrow(run, "key bigint, split int, a binary, u binary, steps binary, counts binary")


def _valued(cells: DataFrame, k: int, near: int | None, n_labels: int) -> DataFrame:
    """key, a, b (utilities), c (steps), d (values of a row of each label there, for each utility), from the counts of all splits."""

    def merged(rows: list[tuple]) -> tuple:
        steps = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        counts = np.concatenate([np.frombuffer(r[4], np.int64).reshape(-1, n_labels) for r in rows])
        named, at = np.unique(steps, return_inverse=True)
        total = np.zeros((len(named), n_labels), np.int64)
        np.add.at(total, at, counts)
        m = _within(total, near)
        us = np.frombuffer(rows[0][2], np.float64).reshape(-1, n_labels)
        return *rows[0][:3], named[:m].tobytes(), np.stack([_values(total[:m], u, k) for u in us]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "a", "b", "c", "d"], [pa.int64(), *[pa.binary()] * 4]
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "u", "steps", "counts"))):
                if held and row[0] != held[0][0]:
                    yield _batch([merged(held)], names, kinds)
                    held = []
                held.append(row)
        if held:
            yield _batch([merged(held)], names, kinds)

    return cells.repartition("key").sortWithinPartitions("key", "split").mapInArrow(run, "key bigint, a binary, b binary, c binary, d binary")


def _looked_up(met: DataFrame, steps: int, n_utils: int, n_labels: int) -> DataFrame:
    """chunk, block, part, from the validation rows' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, tops, rows in _parties(batches, n_labels):
            totals = np.zeros((n_utils, len(rows.y)))
            for (_, _, _, named, values), d2 in rows.each(tops):
                named, values = np.frombuffer(named, np.int64), np.frombuffer(values, np.float64).reshape(n_utils, -1)
                for lo in range(0, len(d2), TILE):
                    step, y = _steps_of(d2[lo : lo + TILE], steps), rows.y[lo : lo + TILE]
                    at = np.minimum(np.searchsorted(named, step), len(named) - 1)
                    totals[:, lo : lo + TILE] += np.where(named[at] == step, values[:, at * n_labels + y], 0.0)
            yield from rows.hand_out(block, totals)

    return met.mapInArrow(run, "chunk bigint, block int, part binary")


def _added(parts: DataFrame, chunks: DataFrame, n_val: int, names: Sequence[str]) -> DataFrame:
    """row_id and a score for each utility: the blocks' parts of each chunk, added up in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, at = None, None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            columns = np.concatenate([t for _, t in held], axis=1) / n_val
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([i for i, _ in held])), *map(pa.array, columns)], ["row_id", *names])
            held.clear()
            return out

        for batch in batches:
            for chunk, block, part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "block", "part"))):
                if chunk != at:
                    if at is not None:
                        held.append((ids, total))
                        if len(held) == 256:
                            yield done()
                    at, ids = chunk, np.frombuffer(part, np.int64)
                    total = np.zeros((len(names), len(ids)))
                else:
                    total += np.frombuffer(part, np.float64).reshape(len(names), -1)
        if at is not None:
            held.append((ids, total))
            yield done()

    ids = chunks.select("chunk", F.lit(-1).alias("block"), F.col("ids").alias("part"))
    together = ids.unionByName(parts).repartition("chunk").sortWithinPartitions("chunk", "block")
    return together.mapInArrow(run, "row_id bigint, " + ", ".join(f"`{name}` double" for name in names))


def knn_shapley(
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    utility: str | Callable[[object], Column] = "accuracy",
    k: int = 1,
    steps: int | None = None,
    error: float | None = None,
    labels: Sequence = (0, 1),
) -> DataFrame:
    """(row_id, score): Shapley value of every training row; lowest = most
    harmful.

    ``features`` are double columns, or one array<double> column, already
    preprocessed and without NULL.  ``utility`` is "accuracy" (validation
    label agreement), "parity" (negative demographic-parity gap; ``val``
    then needs ``protected`` and the model's ``pred``), or a function that gives the
    worth of a neighbour of some label as a column over ``val``.  ``steps``: distance
    steps per octave; None is the strict order.  ``error``: how far a score may be off;
    None values all ranks.  ``labels``: the labels y that training rows may have.
    """
    return knn_shapley_of(train, val, features, {"score": utility}, k, steps, error, labels)


def knn_shapley_of(
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    utilities: dict[str, str | Callable[[object], Column]],
    k: int = 1,
    steps: int | None = None,
    error: float | None = None,
    labels: Sequence = (0, 1),
) -> DataFrame:
    """(row_id, one score for each of ``utilities`` by its name), from one pass over the distances;
    see ``knn_shapley``."""
    cols, names, n_labels = list(features), list(utilities), len(labels)
    steps = FINE_STEPS if steps is None else min(steps, FINE_STEPS)
    rated, us = val, []
    for i, utility in enumerate(utilities.values()):
        rated = with_utility(rated, utility, labels)
        own = {f"u{j}": f"_u{i}_{j}" for j in range(n_labels)}
        rated = rated.withColumnsRenamed(own)
        us += own.values()
    heads = stable(_heads(rated, cols, us))
    n_val = heads.count()
    if not n_val:
        raise ValueError("Shapley values need at least one validation row")
    near = None
    if error is not None:
        ends = rated.agg(*[f(u).alias(f"{n}{u}") for u in us for n, f in (("lo", F.min), ("hi", F.max))]).first()
        reach = max(
            max(0.0, *(ends[f"hi_u{i}_{j}"] for j in range(n_labels))) - min(0.0, *(ends[f"lo_u{i}_{j}"] for j in range(n_labels)))
            for i in range(len(names))
        )
        near = max(k, math.ceil(reach / error), 1)
    chunks = stable(_chunks(spread(train.select("row_id", "y", *cols)), cols, labels))
    size = chunks.agg(F.sum("n").alias("n"), F.max("width").alias("width")).first()
    n_train, width = size["n"] or 0, size["width"] or 1
    # sums and gains; in the strict order also what a sort takes
    held = len(names) + n_labels + (1 if steps <= COARSE_STEPS else 8)
    splits = max(1, -(-n_train * held // SPLIT_VALUES))
    cores = train.sparkSession.sparkContext.defaultParallelism
    cells = min(n_train, near or n_train) if steps == FINE_STEPS else min(n_train, near or n_train, 64 * steps)
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // (width + len(us)) if splits == 1 else BLOCK_CELLS // max(1, cells)))
    blocks = max(-(-n_val // rows), min(n_val, -(-4 * cores // splits)))
    if splits == 1:
        parts = _in_one(_met(heads, chunks, blocks, 1), k, steps, near, len(names), n_labels)
    else:
        values = stable(_valued(_counted(_met(heads, chunks, blocks, splits), steps, near, n_labels), k, near, n_labels))
        parts = _looked_up(_met(values, chunks, blocks, splits), steps, len(names), n_labels)
    return _added(stable(parts), chunks, n_val, names)


def rank_by_shapley(scores: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(row_id, score, rank, n_ranked), lowest score first; only rows of
    ``candidates`` when given."""
    pool = scores if candidates is None else scores.join(
        candidates.select("row_id"), "row_id", "left_semi"
    )
    return score_rank(pool.withColumn("score", F.round("score", 12)), "score", total_col="n_ranked")
