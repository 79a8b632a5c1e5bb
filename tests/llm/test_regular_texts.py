"""Texts and tables that once met in a hash, an id or a column name."""

import pytest
from pyspark.sql import functions as F

from rowmend.llm import packed, rules, suffix_array, suffix_tree


def thue_morse(bits, one="a", two="b"):
    w = one
    for _ in range(bits):
        w += w.translate(str.maketrans(one + two, two + one))
    return w


def test_quality_counts_of_regular_words(spark):
    one, two = thue_morse(11), thue_morse(11, "b", "a")
    text = f"{one}\n{two}"
    words = f"{one} x y z w {two} x y z w"
    rows = [(1, text), (2, words)]
    got = {r.doc_id: r for r in rules.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dup_lines == 0 and got[1].n_distinct == 2
    assert got[2].n_distinct == 6 and got[2].n_repeat_words == 0


def test_windows_of_regular_words(spark):
    one, two = thue_morse(11), thue_morse(11, "b", "a")
    shared = " ".join(f"s{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {shared}"), (2, f"{two} {shared}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_tree.remove_repeats(docs).collect()} == {1: 0, 2: 0}


def test_regular_strings_of_bytes(spark):
    docs = spark.createDataFrame([(1, thue_morse(9)), (2, thue_morse(9, "b", "a"))], "doc_id long, text string")
    raw = {1: thue_morse(9), 2: thue_morse(9, "b", "a")}
    seen = [raw[d][i : i + 400] for d in raw for i in range(len(raw[d]) - 399)]
    assert len(set(seen)) == len(seen)
    assert {r.doc_id: r.n_removed for r in suffix_array.remove_repeats(docs).collect()} == {1: 0, 2: 0}


@pytest.fixture(scope="module")
def same_hash(spark):
    """Two texts with the same 32-bit hash, and a third that repeats the first."""
    rows = spark.range(300_000).select(F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{k}"))) for k in range(15)]).alias("text"))
    met = rows.withColumn("h", F.hash("text")).groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").first()
    assert met is not None
    return met.a, met.b


def test_documents_without_id(spark, same_hash):
    a, b = same_hash
    docs = spark.createDataFrame([(None, a), (None, b), (5, a)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in suffix_array.remove_repeats(docs).select("doc_id", "n_removed").collect()}
    assert got == {(None, len(a)), (None, 0), (5, len(a))}
    got = {(r.doc_id, r.n_removed) for r in suffix_tree.remove_repeats(docs).select("doc_id", "n_removed").collect()}
    assert got == {(None, 15), (None, 0), (5, 0)}


@pytest.mark.parametrize("which", [suffix_array, suffix_tree])
def test_string_ids_and_column_names(spark, which):
    text = " ".join(f"word{k}" for k in range(90))
    rows = [("b", text, "doc 1", 7, "tag 1", 1.5, -1, "r"), ("a", text, "doc 2", 8, "tag 2", 2.5, -2, "s"), ("ab", "other " + text, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, doc string, at int, tag string, `ranges` double, n_removed int, packed string")
    got = {r.doc_id: r for r in which.remove_repeats(docs).collect()}
    gone = {"a": 0, "ab": 90, "b": 90} if which is suffix_tree else {"a": len(text), "ab": len(text), "b": len(text)}
    assert {k: r.n_removed for k, r in got.items()} == gone
    assert got["b"].doc == "doc 1" and got["b"].at == 7 and got["a"].tag == "tag 2" and got["a"].ranges == 2.5 and got["b"].packed == "r"


def test_ranges_hash_alike_wherever_they_stand():
    import numpy as np

    values = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    again = np.concatenate([values[1000:1500], values])
    for which in (0, 1):
        h = packed.Rolling(again, which)
        start = np.arange(400)
        assert (h.of(start, start + 100) == h.of(start + 1500, start + 1600)).all()
        assert len(np.unique(h.of(np.arange(500, 5000), np.arange(501, 5001)))) == 4500
