"""Near words against all pairs, the vocabulary against a plain count, and SQL."""

import random
import re
import zlib
from collections import Counter

import pytest

from checks.compare import connect, differences
from rowmend.llm import spelling
from rowmend.llm.queries import QUERIES, SQL


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    out, form = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n.get(form[w])))
    return sorted(map(repr, rows))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("group", [3_000, 12, 1])
def test_near_words(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(5)
    words = {"a", "ab", "abc", "abd", "bbc", "aab", "aaab", "aaaab", "baaab", "é", "éa", "ab" * 700, "ab" * 700 + "a", "ab" * 600 + "b" + "ab" * 100}
    words |= {"pre" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(150)}
    words |= {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) + "ending" for _ in range(100)}
    n = {w: rng.choice([5, 6, 30, 200, 2000]) for w in sorted(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert found(spelling.variants(df)) == brute(n)
    pairs = [(r.word, r.other, r.m) for r in spelling.near(df).collect()]
    assert sorted(pairs) == sorted((u, v, n[v]) for u in n for v in n if one_edit(u, v))


def test_acceptor_is_minimal():
    words = sorted(a + b + "ing" for a in ("sing", "ring", "thing") for b in ("", "x", "y"))
    machine = spelling.Acceptor(words)
    seen, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in seen:
            seen.add(s)
            todo += machine.arcs[s].values()
    languages = {s: frozenset(machine.both(s, s)) for s in seen}
    assert languages[0] == set(words) and len(set(languages.values())) == len(seen)


def test_vocabulary_and_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(2)
    letters = ["letters", "Letters", "LETTRES", "Étudiante", "étudiante", "wordform", "wordforms", "×multiply÷", "œuvres", "straßenbahn", "naïvetés"]
    text = lambda: " ".join(rng.choice(letters) + rng.choice(["", "s", ",", "’s", "中"]) for _ in range(rng.randrange(300)))
    rows = [(i, text()) for i in range(60)] + [(None, text()), (3, "wordform " * 3000), (3, "wordform " * 3000), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = plain(rows)
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == want and len(want) > 12
    assert found(spelling.spelling_variants(docs)) == brute(want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_sql(spark, small):
    name = "op12_spelling_variants"
    assert differences(QUERIES[name](spark, small).toPandas(), connect(small).execute(SQL[name]).df()) is None
