"""Corpus operators against brute force, SQL, round trips and held-out labels."""

import base64
import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, differences
from rowmend.core import ensure_checkpoint_dir
from rowmend.llm import buckets, decontaminate, licenses, lm, mixing, quality, rules, simhash, suffix_array, suffix_tree, warc
from rowmend.llm.queries import QUERIES, SQL

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = prose(90), prose(4000)
    out = [None, "", " \t\n", "one", "One two", shared, f"{prose(30)} {shared} {prose(20)}", f"{prose(5)}\n{shared}", long, long]
    out += [prose(rng.randrange(1, 150)) for _ in range(20)] + ["x " * 600, "x " * 700, shared.upper()]
    return out + [out[12], out[12]]


@pytest.fixture(scope="module")
def rows():
    ts = texts()
    ids = [*range(100, 100 + len(ts) - 3), None, 105, 105]  # a null and a repeated id
    return list(zip(ids, ts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns have names that the operators use themselves
    data = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), k, 0.5, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, k int, score double, fp string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall((t or "").encode())


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("bucket", [300_000, 40])
def test_suffix_array(spark, docs, rows, empty, monkeypatch, bucket):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", bucket)
    raw, seen = [(t or "").encode() for _, t in rows], Counter()
    for b in raw:
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    want = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    cut = suffix_array.remove_repeats(docs.select("doc_id", "text"))
    same([tuple(r) for r in cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], want)
    assert suffix_array.remove_repeats(empty.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("bucket", [300_000, 40])
def test_suffix_tree(spark, docs, rows, empty, monkeypatch, bucket):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", bucket)
    last, least = 2**62, {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key, own = tuple(w[k : k + 13]), last if i is None else i
            least[key] = min(least.get(key, own), own)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (last if i is None else i):
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    cut = suffix_tree.remove_repeats(docs.select("doc_id", "text"))
    same([tuple(r) for r in cut.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], want)
    assert suffix_tree.remove_repeats(empty.select("doc_id", "text")).count() == 0


def test_simhash(spark, docs, rows, empty):
    prints = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = [(i, f"{p:016x}", least.get(top(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))]
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], want)
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_on_dense_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    x = np.unique(np.concatenate([base, *[base[:3] ^ flip(3) ^ flip(3) for _ in range(150)]]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    named = [got.get(int(v), int(v)) for v in x.view(np.int64)]
    assert len(set(zip(named, label.tolist()))) == len(set(named)) == len(set(label.tolist()))


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), stated=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (sums["size"] == sums.stated).all() and ((sums.taken - sums.target).abs() < 1).all()
    names = sorted(s for s in sums.index if isinstance(s, str))
    weight, target = {}, {}
    for k, s in enumerate([*names, None]):
        weight[s] = (3, 1, 2)[k % 3]
    cap = {s: 2 * int(sums[sums.index == s]["size"].sum() if s else sums[sums.index.isna()]["size"].sum()) for s in weight}
    left, open_ = 1.5 * sum(cap.values()) / 2, set(weight)
    while open_:  # hand out, cap, and hand out the excess again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap[s]}
        for s in full or open_:
            target[s] = cap[s] if full else weight[s] * level
        left -= sum(cap[s] for s in full)
        open_ = open_ - full if full else set()
    for s, r in sums.iterrows():
        assert math.isclose(r.target, target[s if isinstance(s, str) else None], rel_tol=1e-9)
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert sorted(zip(got["size"], got.taken)) == sorted(zip(again["size"], again.taken))
    assert mixing.mix(empty).count() == 0


def test_language_model(spark, docs, rows, empty):
    tokens = [[*WORD.findall((t or "").encode().lower()), b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _), h, t in zip(rows, held, tokens)]
    # a table of few words, so that most counts come from the join
    small = lm.Size(classes=4, class_size=4, known_words=30, embed=4, hidden=4, share=1)
    got = lm.score(docs, small).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], want)
    assert 0 > sum(r.score for r in got) > 1.01 * sum(r.base_score for r in got)
    assert lm.score(empty, small).count() == 0


def test_decontamination(spark, docs, empty):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, item[:60])], "item_id long, text string")
    more = spark.createDataFrame(
        [(1, f"before {item.upper()} after"), (2, "x " + item.replace("theta", "thetta") + " y"), (3, item[::-1]), (4, "é" * 100_000 + " " + item)], "doc_id long, text string"
    )
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs.select("doc_id", "text").unionByName(more), bench).collect()}
    assert got == {(1, 7, 0), (2, 7, 1), (4, 7, 0), (1, 10, 0), (2, 10, 1), (4, 10, 0)}
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_warc_round_trip(spark):
    fake = "a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" * 20
    pages = [(1, "u", fake), (2, None, None), (3, "u v", ""), (4, "x", "WARC/1.0\r\n"), (None, "x", "é\r\n\r\n"), (4, "x", "WARC/1.0\r\n"), (5, "é", fake + "é" * 70_000), (9, "", fake)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(df.coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        got = warc.fields(warc.read_archive(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        own = last[h or ""] in (i, -1)
        want.append((i, len(raw), digest, "response" if own else "revisit", None if own else last[h or ""], h or "" if own else ""))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got], want)


def test_rule_counts(spark, docs, rows, empty):
    def brute(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    extra = [(900, "a b\na b\n\na b \n"), (901, "# *\n\n# *"), (902, "a b c d e f a b c d e")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (103, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(more, labels).collect()
    same([(r.doc_id, *(r[c] for c in rules.COUNTS)) for r in got], [brute(i, t) for i, t in [*rows, *extra]])
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judge(empty, labels.limit(0)).count() == 0 and rules.judge(docs, labels.limit(0)).count() == len(rows)


def test_licenses(spark, small, docs, empty):
    got = QUERIES["op7_license_scan"](spark, small).toPandas()
    assert len(got) and differences(got, connect(small).execute(SQL["op7_license_scan"]).df()) is None
    more = spark.createDataFrame([(1, "Text.\nReleased under the MIT license\nmore"), (2, "Released under\nthe MIT License."), (3, "Released under the law of 1867")], "doc_id long, text string")
    found = licenses.scan(docs.select("doc_id", "text").unionByName(more)).collect()
    assert {(r.doc_id, r.license, r.dice) for r in found} == {(1, "MIT", 1.0), (2, "MIT", 1.0)}
    assert licenses.scan(empty).count() == 0


def test_quality(spark, docs, empty):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.classify(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert ((got.score > 0.3) == (got.quality == 1)).mean() > 0.95 and got.score.between(0, 1).all()
    none = l.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {1.0}
    one = spark.createDataFrame([(100, 1, 0), (101, 1, 0)], l.schema)
    assert quality.classify(docs, one).count() == docs.count() and quality.classify(empty, l).count() == 0


def test_pipeline_stages(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.count() <= docs.count(), name
        assert stage(spark, empty, sf).count() == 0
    kept = corpus_pipeline.simhash_dedup(spark, docs, sf).select("doc_id").collect()
    prints = simhash.fingerprints(docs.select("doc_id", "text"), 5)
    assert len(kept) == simhash.groups(prints, 3).select("root").distinct().count()
    assert corpus_pipeline.run(spark, sf).count() > 0
