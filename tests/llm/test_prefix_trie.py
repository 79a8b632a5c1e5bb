"""The conversation trie against a brute-force trie and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from checks.compare import connect, differences
from rowmend.llm import prefix_trie
from rowmend.llm.queries import QUERIES, SQL


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == k).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def found(df):
    rows = df.select(*prefix_trie.NUMBERS, "ends_sha256").collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(60), *range(1000, 1200, 3), 77777777777]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            text = rng.choice(["hi", "", None, "é" * 40, "hello there", str(rng.randrange(4))])
            rows.append((c, t, rng.choice(["user", "assistant", None]), text))
    for c in range(2000, 2150):  # copies: a third of all
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(5, None, "user", "a"), (5, None, "user", "b"), (5, 1, "user", "z"), (5, 1, "user", "z"), (None, 1, "user", "lost")]
    rows += [(10, t, "user", "long " * 3000) for t in range(300)] + [(12, t, "user", "long " * 3000) for t in range(300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.mark.parametrize("turns,piece", [(100_000, 8_192), (60, 7)])
def test_brute_force(spark, rows, monkeypatch, turns, piece):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    data = [(*r, "x", 1, "c") for r in rows]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, code string, size int, key string").repartition(5)
    nodes = prefix_trie.prefix_trie(df)
    assert found(nodes) == brute(rows)
    told = prefix_trie.with_turns(nodes.where("conv_id = 2000"), df).select("depth", "role", "text").collect()
    assert ("user", "same 9") in {(r.role, r.text) for r in told} and all(r.role for r in told if r.depth)


def test_codes_that_meet(spark, monkeypatch):
    kept = prefix_trie.coded

    def meets(turns, salt):
        made = kept(turns, salt)
        return made if salt else made.withColumn("code", made.code * 0)

    monkeypatch.setattr(prefix_trie, "coded", meets)
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(20) for t in range(12)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


def test_small_tables(spark):
    ddl = "conv_id long, turn long, role string, text string"
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], ddl))) == []
    one = [(3, 0, "user", "x")]  # its first turns come from a conversation that does not exist
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(one, ddl))) == brute(one)


def test_median_insertion_is_balanced():
    n = 1000
    tree = prefix_trie.Ternary()
    for i in prefix_trie._median_order(n):
        tree.insert([i], [1], [i])
    deepest, todo = 0, [(tree.equal[0], 1)]
    while todo:
        at, level = todo.pop()
        if at >= 0:
            deepest = max(deepest, level)
            todo += [(tree.low[at], level + 1), (tree.high[at], level + 1)]
    assert deepest == 10


def test_sql(spark, small):
    name = "op11_prefix_trie"
    assert differences(QUERIES[name](spark, small).toPandas(), connect(small).execute(SQL[name]).df()) is None
