"""Spelling variants of the words of a corpus, by composing finite-state machines.

All words that differ by one inserted, deleted or replaced code point are accepted
pairs of vocabulary o one-edit o vocabulary.  The composed machine starts where no edit
has been made, so both sides have read the same letters; it is cut along those:

- Words are dealt out by the letters read so far.  A group that is too large is cut by
  the next letter after all that its words share, again and again.  A group's words
  become a minimised acceptor, which is composed with the one-edit transducer and
  itself; the pairs are enumerated from the initial state.
- Pairs whose edit is the letter by which a large group was cut lie in two groups.
  Behind that letter both sides have to read the same rest: so these states of the
  machine are met by an equi-join on (letters read, rest).  As an edit stands where two
  words part, each pair is found once.

A word's form is its near word of largest n, if that is at least ``ratio`` times its own;
of ties the smallest in code-point order.  Forms are followed to the last one by pointer doubling.

A null text has no words; a null doc_id counts as an empty one where runs are hashed.
Repeated rows count as often as they stand there.  Columns other than doc_id and text
are not looked at.  An empty table gives no words.  Texts may be of any length; counts
are added up in tasks, and given out whenever ``HELD`` words are held.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.core import stable

GROUP = 3_000  # words that one acceptor is built from
HELD = 150_000
TASK_WORDS = 20_000

# Latin-1, as runs of letters hold nothing else: A-Z lower-cased, letters kept, and the rest made blank
_LETTERS = bytes(b if b in range(97, 123) or b >= 0xC0 else b + 32 if b in range(65, 91) else 32 for b in range(256))


def vocabulary(docs: DataFrame, least_letters: int = 6, least_n: int = 5, noise: int = 199) -> DataFrame:
    """word, n.  Runs of letters are lower-cased, and where ``noise`` divides their hash h (CRC-32 of ``<doc_id>:<run>``)
    they lose the letter h modulo their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def give() -> pa.RecordBatch:
            long = [(w, n) for w, n in ((w.decode(), n) for w, n in held.items() if n) if len(w) >= least_letters]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                words = text.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").encode().split()
                held.update(words)
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                crc = zlib.crc32
                for w in [w for w in words if not crc(w, start) % noise]:
                    letters = w.decode()
                    at = crc(w, start) % len(letters)
                    held[w] -= 1
                    held[(letters[:at] + letters[at + 1 :]).encode()] += 1
                if len(held) > HELD:
                    yield give()
        yield give()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Acceptor:
    """Minimised acyclic acceptor of words that come in order.  State 0 is initial."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, before = [0], ""
        for word in [*words, ""]:
            shared = len(os.path.commonprefix([before, word]))
            # states that no further word goes through are replaced by an equal one, the deepest first
            while len(path) - 1 > shared:
                state = path.pop()
                same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                self.arcs[path[-1]][before[len(path) - 1]] = same
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            if word:
                self.final[path[-1]] = True
            before = word

    def both(self, p: int, q: int, without: str = "") -> Iterator[str]:
        """What is accepted from p as well as from q, but for what begins with the letter ``without``."""
        todo = [(p, q, "", without)]
        while todo:
            p, q, read, but = todo.pop()
            if self.final[p] and self.final[q]:
                yield read
            few, many = sorted((self.arcs[p], self.arcs[q]), key=len)
            todo += [(self.arcs[p][a], self.arcs[q][a], read + a, "") for a in few if a in many and a != but]


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of distinct words, given in order, at one edit: the accepted pairs of acceptor o one-edit o acceptor."""
    start = os.path.commonprefix([words[0], words[-1]])
    machine = Acceptor([w[len(start) :] for w in words])
    if words[0] == start:  # the empty word is no arc
        machine.final[0] = True
    dead: set[tuple] = set()
    todo = [(0, start)]
    while todo:
        state, read = todo.pop()
        arcs = list(machine.arcs[state].items())
        todo += [(to, read + a) for a, to in arcs]
        if len(arcs) == 1 and not machine.final[state]:
            continue
        for i, (a, p) in enumerate(arcs):
            # a is replaced by b; or it is deleted, and what follows does not begin with it
            for b, q, but in [(b, q, "") for b, q in arcs[:i]] + [("", state, a)]:
                if (p, q, but) in dead:
                    continue
                none = True
                for rest in machine.both(p, q, but):
                    none = False
                    yield read + a + rest, read + b + rest
                if none:
                    dead.add((p, q, but))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(group: dict[str, int]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[str, str, int]] = []
        if len(group) > 1:
            for u, v in near_pairs(list(group)):
                some += [(u, v, group[v]), (v, u, group[u])]
                if len(some) >= 50_000:
                    yield batch_of(some)
                    some = []
        if some:
            yield batch_of(some)

    def batch_of(some: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64()))], ["word", "other", "m"])

    name, group = None, {}
    for batch in batches:
        for key, word, n in zip(*(batch.column(c).to_pylist() for c in ("group", "word", "n"))):
            if key != name:
                yield from pairs(group)
                name, group = key, {}
            group[word] = n
    yield from pairs(group)


def near(words: DataFrame) -> DataFrame:
    """word, other, m (n of other) for each ordered pair of near words of the table words (word, n), words being unique."""
    spark = words.sparkSession
    now = stable(words.select("word", "n", F.lit("").alias("group")))
    crossing = None
    while True:
        # at most a GROUP-th of the words' number
        large = now.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.min("word").alias("lo"), F.max("word").alias("hi")).where(F.col("k") > GROUP).collect()
        if not large:
            break
        cuts = spark.createDataFrame([(r.group, len(os.path.commonprefix([r.lo, r.hi]))) for r in large], "group string, at int")
        met = now.join(F.broadcast(cuts), "group", "left")
        letter, rest = F.expr("substring(word, at + 1, 1)"), F.expr("substring(word, at + 2)")
        # either side of an edit at the cut: a word without the letter there, and the word as it is
        cut = F.struct("word", "n", letter.alias("letter"), rest.alias("rest"), F.lit(True).alias("cut"))
        whole = F.struct("word", "n", letter.alias("letter"), F.expr("substring(word, at + 1)").alias("rest"), F.lit(False).alias("cut"))
        here = met.where("at is not null").select(F.expr("substring(word, 1, at)").alias("read"), F.explode(F.array(cut, whole)).alias("s"))
        here = here.where("s.letter != '' or not s.cut")
        crossing = here if crossing is None else crossing.unionByName(here)
        now = stable(met.select("word", "n", F.expr("if(at is null, group, substring(word, 1, at + 1))").alias("group")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), now.count() // TASK_WORDS)
    found = now.repartition(parts, "group").sortWithinPartitions("group", "word").mapInArrow(_composed, "word string, other string, m long")
    if crossing is None:
        return found
    # one letter tells the members of a state apart, so there are no more of them than letters
    states = crossing.groupBy("read", "s.rest").agg(F.collect_list("s").alias("all")).where(F.size("all") > 1)
    both = states.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    one_edit = F.expr("(a.cut or b.cut) and a.word != b.word and a.letter != b.letter")
    return found.unionByName(both.where(one_edit).select("a.word", F.col("b.word").alias("other"), F.col("b.n").alias("m")))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (word, n)."""
    words = stable(words.select("word", "n"))
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    seen = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    big = -F.col("best.less") >= ratio * F.col("n")
    told = stable(
        words.join(seen, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(big, F.col("best.other")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")
        )
    )
    # n grows with each form, so these are trees; each round doubles the steps
    up = stable(told.where("form is not null").select("word", F.col("form").alias("to"), F.lit(True).alias("moved")))
    while not up.where("moved").isEmpty():
        on = up.select(F.col("word").alias("to"), F.col("to").alias("next"))
        up = stable(up.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
    return told.join(up.select("word", F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(vocabulary(docs))


def variants_sql() -> str:
    """The same for the default parameters: near words by equal rests without one letter."""
    return """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS w
    FROM documents) GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM runs, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.k = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.k = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM pairs GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps(word, to_) AS (
  SELECT word, word FROM words
  UNION ALL SELECT s.word, t.form FROM steps s JOIN told t ON t.word = s.to_ WHERE t.form IS NOT NULL)
SELECT t.word, t.form, s.to_ AS root, t.n, t.n_near, t.form_n
FROM told t JOIN steps s USING (word) JOIN told e ON e.word = s.to_ WHERE e.form IS NULL"""
