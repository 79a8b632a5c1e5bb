"""Scoring whole documents with a gated recurrent language model (``gru``).

Word counts come from all training documents.  Texts are read once for their
counts and once for the numbers of their words, which a table keeps for all that
follows.  The ``classes * class_size`` most
frequent words have weights of their own; the others are one class, in which
their counts decide.  The model is trained in rounds: tasks start from the same
weights, learn from the training documents of the round, and their weights are
averaged.  A round is kept if it makes documents of another one likelier; after a round that
was kept, the last one is if its words, each told before it was learned, were likelier than by the
weights before, and the first round's documents are than by word counts alone.
Each training document is in one round.  So counts and training grow with the corpus, while the
weights and the table of ``known_words`` frequent words, which go to every task,
stay as large as the parameters say.

Nulls: a null text is an empty one, of which the end is the only token; a null
id is never held out.  Repeated rows count and score one by one.  Without
training documents there are no counts, and every token is unknown.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.core import stable

from . import gru

END = "\n"  # no word holds one
COUNT_BYTES = 16_000_000  # of texts whose words a task counts before it hands them on
READ_BYTES = 8_000_000  # of texts whose words are looked up at a time


@dataclass(frozen=True)
class Size:
    classes: int = 48
    class_size: int = 64
    known_words: int = 200_000
    embed: int = 16
    hidden: int = 24
    rounds: int = 2
    share: int = 1  # more: the rounds together learn from one in so many training documents
    task_words: int = 2_000_000  # numbers of words in memory at a time


def held_out(folds: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == remainder, F.lit(False))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after the other, and how many each text has."""
    bare = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(bare))
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)] = 0  # Arrow has one empty word there
    words = lists.flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0)), n


def _portions(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Rows that have about ``limit`` bytes of text together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each word stands in the texts, and the end of a text as ``END``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            texts = batch.column("text")
            ends += len(texts)
            for lo, hi in _portions(texts, COUNT_BYTES):
                counted = _words(texts.slice(lo, hi - lo))[0].value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "c"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64 has it."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Table:
    """The frequent words: number of each (its place), its model number and log10(c + 1)."""

    words: pa.Array
    model: np.ndarray
    log_count: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int
    head: int

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each number: log10(c + 1), whether it is known, and what the rare class leaves open."""
        miss, rare = np.isnan(self.log_count), self.model == self.head
        base = np.where(miss, 0.0, self.log_count)
        return base, ~miss & (base > 0), np.where(rare, base - np.log10(self.rare_tokens + self.rare_distinct + 1), 0.0)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and the hashes of those beyond the table."""
        number = pc.index_in(words, self.words)
        coded = words.filter(number.is_null()).dictionary_encode()
        hashes = np.array([word_hash(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        return pc.fill_null(number, len(self.words)).to_numpy(), hashes[coded.indices.to_numpy()]


def vocabulary(counts: DataFrame, size: Size) -> Table:
    head = size.classes * size.class_size
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = counts.where(F.col("word") == END).first()
    # the most frequent ones: as many eighths of a doubling as hold no more words than the table
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.where(F.col("word") != END).groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
    held, least = 0, 10_000
    for r in bins:
        if held + r.n >= size.known_words:
            break
        held, least = held + r.n, r.b
    rows = counts.where((F.col("word") != END) & (step >= least)).collect()  # fewer than known_words
    rows.sort(key=lambda r: (-r.c, r.word))
    words = pa.array([END, *(r.word for r in rows)])
    c = np.array([end.c if end else 0, *(r.c for r in rows)], np.int64)
    model = np.minimum(np.arange(len(words) + 1), head).astype(np.int32)
    model[-1] = head
    n_head = min(head, len(words))
    known_v = int((c[:n_head] > 0).sum())
    return Table(
        words, model, np.append(np.log10(c + 1.0), np.nan), int(total.n), int(total.v),
        int(total.n) - int(c[:n_head].sum()), int(total.v) - known_v, head,
    )


def initial(table: Table, size: Size) -> dict[str, np.ndarray]:
    c = 10.0 ** table.log_count[: size.classes * size.class_size] - 1
    c = np.nan_to_num(c)  # there may be fewer words
    n = np.zeros(size.classes * size.class_size)
    n[: len(c)] = c + 0.5
    n = n.reshape(size.classes, size.class_size)
    mass = np.append(n.sum(axis=1), table.rare_tokens + 1.0)
    with np.errstate(divide="ignore"):
        log_word = np.log(n) - np.log(np.maximum(n.sum(axis=1, keepdims=True), 1e-9))
        log_class = np.maximum(np.log(mass / mass.sum()), -30)
    return gru.start(log_class, log_word, size.embed, size.hidden, seed=5)


def _round(size: Size) -> Column:
    """The round that learns from a training document; from ``rounds`` on, none does."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(size.share * size.rounds))


def train(docs: DataFrame, table: Table, size: Size) -> tuple[dict, list[tuple[dict, dict]], int]:
    """Weights after the last round; if documents of a part still have to say whether those are kept, the
    ones to beat, the ones to go back to, and the part.  docs: the training documents, as ``numbered`` gives them."""
    p = start = initial(table, size)
    memory = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    # a task learns from enough words, however small the table's partitions are
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, table.tokens // (size.rounds * size.task_words))
    known = 0.0  # mean log-likelihood of the round's words by p
    for k in range(size.rounds):
        learned = _learn(docs.where(F.col("part") == k).select("ids").coalesce(tasks), p, memory, size)
        if learned and k < size.rounds - 1:
            by_old, by_new = means_by(docs.where(F.col("part") == k + 1).select("ids"), p, learned[0], size)
            known = max(by_old, by_new)  # by the weights that go on
            if by_new > by_old:
                p, memory = learned[:2]
        elif learned and p is start:
            return learned[0], [(start, start)], (k + 1) % size.rounds
        elif learned and learned[2] > known:
            return learned[0], [(start, p)], 0
    return p, [], 0


def means_by(docs: DataFrame, old: dict, new: dict, size: Size) -> tuple[float, float]:
    """Mean log-likelihood of the documents' words with both weights."""
    held = docs.sparkSession.sparkContext.broadcast((old, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, off, _ in _blocks(batches, size):
            both = [float(gru.scores(p, ids, off).sum()) for p in held.value]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*both, len(ids))], ["old", "new", "n"])

    means = [F.coalesce(F.sum(c) / F.sum("n"), F.lit(0.0)) for c in ("old", "new")]
    return tuple(docs.mapInArrow(run, "old double, new double, n long").agg(*means).first())


def _learn(docs: DataFrame, p: dict, memory: dict, size: Size) -> tuple[dict, dict, float] | None:
    """Weights and memory that the documents lead to, averaged over all tasks, and the mean log-likelihood of
    their words, each before it was learned; nothing without documents."""
    names = list(p)
    held = docs.sparkSession.sparkContext.broadcast((p, memory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, memory = held.value
        p, memory, seen, told = dict(p), {k: v.copy() for k, v in memory.items()}, 0, 0.0
        for ids, off, _ in _blocks(batches, size):
            memory["told"] = np.zeros(1)
            p = gru.train(p, ids, off, memory)
            told += float(memory.pop("told")[0])
            seen += len(ids)
        if seen:
            values = [*p.values(), *memory.values(), np.array([told / seen])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, *(f"m:{k}" for k in names), "told"]), pa.array([x.astype("<f4").tobytes() for x in values], pa.binary()), pa.array([seen] * len(values))],
                ["name", "value", "seen"],
            )

    def average(group: pa.Table) -> pa.Table:
        seen = group.column("seen").to_numpy().astype(np.float64)
        total = 0.0
        for value, n in zip(group.column("value"), seen):
            total = total + np.frombuffer(value.as_py(), "<f4").astype(np.float64) * n
        return pa.table({"name": group.column("name")[:1], "value": pa.array([(total / seen.sum()).astype("<f4").tobytes()], pa.binary())})

    # a few tasks' weights meet at a time, so that no group holds those of all
    rows = _average(docs.mapInArrow(run, "name string, value binary, seen long"), average).collect()  # as large as the model
    if not rows:
        return None
    new = {r.name: np.frombuffer(r.value, "<f4") for r in rows}
    weights, squares = ({n: new[m + n].reshape(p[n].shape).copy() for n in names} for m in ("", "m:"))
    return weights, squares, float(new["told"][0])


def _average(learned: DataFrame, average, fan: int = 8) -> DataFrame:
    """Weights of all tasks, averaged ``fan`` at a time until one of each name is left."""
    left = learned.withColumn("t", F.spark_partition_id())
    tasks = learned.rdd.getNumPartitions()

    def partly(group: pa.Table) -> pa.Table:
        out = average(group)
        t = pa.array([group.column("t")[0].as_py() // fan], pa.int32())
        return out.append_column("seen", pa.array([int(sum(group.column("seen").to_pylist()))])).append_column("t", t)

    while tasks > 1:
        meet = left.withColumn("g", (F.col("t") / fan).cast("int"))
        left = meet.groupBy("name", "g").applyInArrow(lambda t: partly(t), "name string, value binary, seen long, t int")
        tasks = -(-tasks // fan)
    return left.select("name", "value")


def numbered(docs: DataFrame, table: Table, size: Size) -> DataFrame:
    """doc_id, part (the round that learns from the row, if it is a training document), n_tokens, known (of
    the table), base (the table's log counts), rare (what the rare class leaves open), unseen (hashes of the
    words beyond the table, and how often each stands there) and ids (the model's numbers of all tokens) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(vars(table))  # plain values
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, part long, n_tokens long, known long, base double, rare double, unseen array<struct<h:long,k:long>>, ids binary"
    names = ["doc_id", "part", "n_tokens", "known", "base", "rare", "unseen", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(**held.value)
        base, is_known, rare = table.values()
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in _portions(texts, READ_BYTES):
                words, n = _words(texts.slice(lo, hi - lo))
                off = np.r_[0, np.cumsum(n + 1)]
                numbers = np.zeros(off[-1], np.int32)  # an end is number 0
                inner = np.ones(len(numbers), bool)
                inner[off[1:] - 1] = False
                numbers[inner], hashes = table.look_up(words)
                model = table.model[numbers]
                add = lambda v, off=off: np.add.reduceat(v, off[:-1])
                missing = add((numbers == len(table.words)).astype(np.int64))
                doc = np.repeat(np.arange(len(n)), missing)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])][: len(doc)])
                upto = pa.array(np.searchsorted(doc[first], np.arange(len(n) + 1)), pa.int32())
                times = np.diff(np.r_[first, len(doc)])
                pairs = pa.StructArray.from_arrays([pa.array(hashes[first]), pa.array(times, pa.int64())], ["h", "k"])
                unseen = pa.ListArray.from_arrays(upto, pairs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in ("doc_id", "part")), pa.array(n + 1),
                     pa.array(add(is_known[numbers].astype(np.int64))), pa.array(add(base[numbers])), pa.array(add(rare[numbers])), unseen, _packed(model, off, table.head)],
                    names,
                )

    return docs.select("doc_id", "text", _round(size).alias("part")).mapInArrow(run, schema)


def _packed(model: np.ndarray, off: np.ndarray, head: int) -> pa.Array:
    """A binary value for each document: the bytes of a number (2 or 4) and the numbers."""
    kind = "<u2" if head < 1 << 16 else "<u4"
    raw = model.astype(kind).tobytes()
    wide = np.dtype(kind).itemsize
    lead = bytes([wide]) * wide
    cut = (off * wide).tolist()
    return pa.array([lead + raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch], size: Size) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[pa.RecordBatch, int, int]]]]:
    """Numbers of the tokens of some documents, their offsets, and the rows that they are from."""
    held, off, rows = [], [0], []
    for batch in batches:
        since = 0
        for i, value in enumerate(batch.column("ids")):
            raw = value.as_py()
            held.append(np.frombuffer(raw, f"<u{raw[0]}")[1:].astype(np.int32))
            off.append(off[-1] + len(held[-1]))
            if off[-1] >= size.task_words:
                yield np.concatenate(held), np.array(off), [*rows, (batch, since, i + 1)]
                held, off, rows, since = [], [0], [], i + 1
        if since < batch.num_rows:
            rows.append((batch, since, batch.num_rows))
    if held:
        yield np.concatenate(held), np.array(off), rows


def _scored(read: DataFrame, weights: dict, others: list[dict], size: Size) -> DataFrame:
    """lm (log10 of the probability by the weights) and, where ``judges``, others (by those) of the rows of ``numbered``."""
    held = read.sparkSession.sparkContext.broadcast((weights, others))
    kept = ["row", "doc_id", "n_tokens", "known", "base", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, others = held.value
        for ids, off, rows in _blocks(batches, size):
            parts, done = [batch.slice(a, b - a) for batch, a, b in rows], 0
            judges = np.concatenate([x.column("judges").to_numpy(zero_copy_only=False) for x in parts])
            own, cut = np.repeat(judges, np.diff(off)), np.r_[0, np.cumsum(np.diff(off)[judges])]
            lm = gru.scores(weights, ids, off) / np.log(10)
            by = np.empty((len(judges), len(others)))
            if judges.any():
                for i, w in enumerate(others):
                    by[judges, i] = gru.scores(w, ids[own], cut) / np.log(10)
            for part in parts:
                these = slice(done, done + part.num_rows)
                told = [v.tolist() if j else None for v, j in zip(by[these], judges[these])]
                made = [pa.array(lm[these]), pa.array(told, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *made], [*kept, "lm", "others"])
                done += part.num_rows

    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, known long, base double, rare double, lm double, others array<double>"
    return stable(read.select(*kept, "judges", "ids").mapInArrow(run, schema))


def score(docs: DataFrame, size: Size = Size()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    training = docs.select("doc_id", "text").where(~held_out())
    counts = stable(count_words(training))
    table = vocabulary(counts, size)
    read = stable(numbered(docs, table, size).withColumn("row", F.monotonically_increasing_id()))
    training = F.when(held_out(), F.lit(None)).otherwise(F.col("part"))
    last, doubts, judge = train(read.where(training.isNotNull()), table, size)
    scored = _scored(read.withColumn("judges", F.coalesce(training == judge, F.lit(False))), last, [first for first, _ in doubts], size)
    if doubts:
        gain = scored.agg(F.coalesce(F.sum(F.col("lm") - F.col("others")[0]), F.lit(0.0)).alias("g")).first().g
        if gain <= 0:
            scored = _scored(read.withColumn("judges", F.lit(False)), doubts[0][1], [], size)
    # words beyond the table: their counts are joined by hash, and added up per document
    pairs = read.select("row", F.inline("unseen"))
    tail = counts.select(F.xxhash64("word").alias("h"), "c")
    sums = pairs.join(tail, "h").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("more_known"))
    none = F.lit(0.0)
    more = F.coalesce("more", none)
    return scored.join(sums, "row", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(table.tokens + table.distinct + 1))).alias("base_score"),
        (F.col("lm") + F.col("rare") + more).alias("score"),
    )
