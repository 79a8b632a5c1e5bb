"""The forest draws from all good rows, and the limit rests on all labelled ones."""

import numpy as np

from rowmend.llm import rules


def _limit(path, good, keep, contamination):
    if good.all() or not good.any():
        return float(np.quantile(path, contamination))
    best = (-1.0, 0.0)
    for p in np.unique(path):
        gone_good, gone_bad = (path[good] < p).sum() / good.sum(), (path[~good] < p).sum() / (~good).sum()
        if gone_good <= 1 - keep:
            best = max(best, (gone_bad - gone_good, p))
    return best[1]


def test_limit_counts_all_labelled_rows(spark):
    rng = np.random.default_rng(4)
    for good in (rng.random(9000) < 0.7, np.ones(9000, bool)):
        path = np.round(np.where(good, rng.normal(9, 1, 9000), rng.normal(7, 1, 9000)), 2)
        tried = spark.createDataFrame(list(zip(path.tolist(), good.tolist())), "path double, good boolean").repartition(3)
        for keep in (0.99, 0.9):
            assert abs(rules.path_limit(tried, keep, 0.05) - _limit(path, good, keep, 0.05)) < 1e-9
    assert rules.path_limit(tried.limit(0), 0.9, 0.05) == -np.inf


def _docs(spark, n):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(20, 60))) for _ in range(n)]
    return texts, spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_trees_draw_from_all_good_rows(spark):
    """Far more good rows take part than one pool of 2,000, each tree draws as many as it should, and reruns agree."""
    _, docs = _docs(spark, 6000)
    stats = rules.statistics(docs).withColumn("key", rules.F.xxhash64("doc_id")).cache()
    low, high = np.full(len(rules.RATIOS), -3.0), np.full(len(rules.RATIOS), 3.0)
    grown = rules.forest(stats, low, high, 150, 256, 11)
    key = np.array([r.key for r in stats.select("key").collect()], np.int64).view(np.uint64)
    drawn = np.array([rules.tree_key(key, k) <= np.uint64(last) for k, last in zip(grown.number, grown.last)])
    assert len(grown.trees) == 150 and (drawn.sum(axis=1) == 256).all()
    assert drawn.any(axis=0).sum() > 5900
    again = rules.forest(stats.repartition(5), low, high, 150, 256, 11)
    assert again.last == grown.last and all((a.depth == b.depth).all() for a, b in zip(again.trees, grown.trees))


def test_rows_are_tried_by_trees_that_have_not_drawn_them(spark):
    _, docs = _docs(spark, 40)
    stats = rules.statistics(docs).withColumn("key", rules.F.xxhash64("doc_id")).toArrow()
    low, high = np.full(len(rules.RATIOS), -3.0), np.full(len(rules.RATIOS), 3.0)
    grown = rules.forest(spark.createDataFrame(stats.to_pandas()), low, high, 20, 256, 11)
    x, key = rules._features(stats), rules._keys(stats)
    got = grown.path(x, key, np.ones(40, bool))
    for r in range(40):
        out = [t.path(x[r : r + 1])[0] for t, k, last in zip(grown.trees, grown.number, grown.last) if rules.tree_key(key[r : r + 1], k)[0] > last]
        assert 0 < len(out) < 20 and abs(got[r] - np.mean(out)) < 1e-9
    assert np.allclose(grown.path(x, key, np.zeros(40, bool)), grown.path(x))


def test_labelled_rows_beyond_four_thousand_move_the_limit(spark):
    """All 4,800 good rows are alike but for 600 with many symbols: as more than 1 in 100 they must stay."""
    texts, _ = _docs(spark, 5400)
    rows = [(k, "#" * 15 + " " + t if k % 8 == 0 else t) for k, t in enumerate(texts[:4800])]
    rows += [(5000 + k, "%" * 60 + " " + t.upper()) for k, t in enumerate(texts[4800:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (rules.F.col("doc_id") < 5000).cast("int").alias("quality"))
    got = rules.judge(docs, labels).where("not base_failed").toPandas()
    good = got.doc_id < 5000
    assert got[good].kept.mean() >= 0.985 and got[~good].kept.mean() < 0.1
