"""The recurrent model learns from every training document once."""

import uuid

import numpy as np
import pyarrow as pa

from rowmend.llm import gru, lm


def test_rounds_cover_all_training_documents(spark, tmp_path, monkeypatch):
    rows = [(k, f"alpha beta w{k % 7} " * (1 + k % 5)) for k in range(120)] + [(None, "gamma delta"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = str(tmp_path)

    def seen(p, numbers, off, memory):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(numbers)))
        return p

    monkeypatch.setattr(gru, "train", seen)
    scored = lm.score(docs, lm.Size(classes=4, class_size=4, known_words=30, embed=4, hidden=4)).collect()
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == scored[0].train_tokens > 0


def _model(rng):
    n_class, size, hidden = 3, 4, 5
    log_word = np.log(np.full((n_class, size), 1 / size))
    p = gru.start(np.log(np.full(n_class + 1, 1 / (n_class + 1))), log_word, 3, hidden, seed=2)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in p.items()}


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    p = _model(rng)
    steps, lanes = 4, 3
    x, y = rng.integers(0, 13, (steps, lanes)), rng.integers(0, 13, (steps, lanes))
    fresh, real = rng.random((steps, lanes)) < 0.3, rng.random((steps, lanes)) < 0.8
    h = rng.normal(0, 1, (lanes, 5))

    def loss(q):
        out, state = np.zeros((steps, lanes, 5)), h
        states, _ = gru.forward(q, x, fresh, h)
        out[:] = states
        return -gru.log_likelihood(q, states[real], y[real]).sum() / real.sum()

    g, _ = gru._gradients(p, x, fresh, y, real, h)
    for name, v in p.items():
        flat = v.ravel()
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            up, down = ({**p, name: v.copy()} for _ in range(2))
            up[name].ravel()[i] += 0.01
            down[name].ravel()[i] -= 0.01
            want = (loss(up) - loss(down)) / 0.02
            assert abs(want - g[name].ravel()[i]) < 2e-3, name


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    p = _model(rng)
    states = rng.normal(0, 1, (6, 5))
    words = [gru.log_likelihood(p, states, np.full(6, w)) for w in range(13)]  # twelve words and the rare class
    assert np.allclose(np.exp(words).sum(axis=0), 1, atol=1e-5)


def test_averages_count_all_tasks(spark, monkeypatch):
    """The average over any number of tasks is the one that their numbers of words give."""
    rows = [("w", float(k), k + 1) for k in range(20)]
    parts = spark.createDataFrame(rows, "name string, v double, seen long").repartition(20)

    def pack(batches):
        for b in batches:
            for r in b.to_pylist():
                value = np.array([r["v"]], "<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([value], pa.binary()), pa.array([r["seen"]])], ["name", "value", "seen"])

    def average(group):
        seen = group.column("seen").to_numpy().astype(float)
        v = np.array([np.frombuffer(x.as_py(), "<f4")[0] for x in group.column("value")])
        return pa.table({"name": group.column("name")[:1], "value": pa.array([np.array([(v * seen).sum() / seen.sum()], "<f4").tobytes()], pa.binary())})

    got = lm._average(parts.mapInArrow(pack, "name string, value binary, seen long"), average, fan=3).collect()
    want = sum(v * n for _, v, n in rows) / sum(n for *_, n in rows)
    assert len(got) == 1 and abs(np.frombuffer(got[0].value, "<f4")[0] - want) < 1e-4


def test_texts_are_read_twice(spark, tmp_path, monkeypatch):
    """Once for the counts and once for the numbers that training and scoring share."""
    rows = [(k, f"alpha beta w{k % 7} " * (1 + k % 5)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder, words = str(tmp_path), lm._words

    def seen(texts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts) if hasattr(texts, "__len__") and not isinstance(texts, str) else 1))
        return words(texts)

    monkeypatch.setattr(lm, "_words", seen)
    scored = lm.score(docs, lm.Size(classes=4, class_size=4, known_words=30, embed=4, hidden=4)).collect()
    training = sum(not r.held_out for r in scored)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == training + len(rows)


def test_told_words_are_those_of_the_weights_before():
    rng = np.random.default_rng(6)
    p = {k: v.astype(np.float32) for k, v in _model(rng).items()}
    ids, off = rng.integers(0, 13, 40), np.array([0, 15, 16, 40])
    memory = {**{k: np.full_like(v, 1e-6) for k, v in p.items()}, "told": np.zeros(1)}
    want = gru.scores(p, ids, off).sum()
    gru.train(dict(p), ids, off, memory, rate=0.0)
    assert abs(memory["told"][0] - want) < 1e-3


def test_words_are_cut_at_ascii_blanks_only():
    texts = [None, "", " ", "\x0b\x0c", "a", "é x  y\x85z\x1c\x1f\x00q", "ÀÉ aB\tCd\r\n\x0bE ", "　 K"]
    words, n = lm._words(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert [w.encode() for w in words.to_pylist()] == [x for w in want for x in w]
