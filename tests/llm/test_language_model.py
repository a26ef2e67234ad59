import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitegauge.llm import language_model as lm


def brute_base(rows):
    tokens = [(i, [*lm.words_of(t), lm.END]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    return sorted((str(i), held(i), len(w), sum(x in counts for x in w), n,
                   round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)


def check(docs):
    rows = lm.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == brute_base(
        [(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return rows


def test_whole_test_table_with_few_common_words(spark, folder, monkeypatch):
    """Most words are joined; and the network beats single-word counts on the texts held out."""
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (2000,))
    held = [r for r in check(spark.read.parquet(f"{folder}/documents.parquet")) if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(odd, empty):
    check(odd)
    assert lm.score(empty).count() == 0


def test_gradients_against_differences():
    draw = np.random.default_rng(0)
    network = lm.Network(draw.normal(size=lm.Network().flat.size) * 0.3)
    texts = [np.append(draw.integers(1, 300, n), 0).astype(np.int32) for n in (7, 3, 12)]
    window = next(iter(lm.lanes(texts)))
    h = draw.normal(size=(window[0].shape[1], lm.STATE))
    g, _, _ = network.gradients(*window[:4], h)

    def loss(flat):
        other = lm.Network(flat)
        inputs, targets, keep, valid, _ = window
        _, steps, _ = other.states(inputs, keep, h)
        return -other.outputs(np.stack([s[5] for s in steps])[valid], targets[valid])[0].mean()

    for at in draw.choice(np.flatnonzero(np.abs(g) > 1e-5), 60, replace=False):
        step = np.zeros_like(network.flat)
        step[at] = 1e-5
        assert (loss(network.flat + step) - loss(network.flat - step)) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_probabilities_add_up():
    network = lm.Network()
    every = np.arange(lm.CLASSES * lm.CLASS_WORDS + 2)
    hidden = np.tile(np.random.default_rng(1).normal(size=(1, lm.STATE)).astype(np.float32), (len(every), 1))
    assert np.exp(network.outputs(hidden, every)[0]).sum() == pytest.approx(1, rel=1e-4)


def test_lanes_and_windows_do_not_change_a_score():
    """A document scores the same alone and among others, whole in one pass."""
    draw = np.random.default_rng(3)
    network = lm.Network()
    texts = [np.append(draw.integers(1, 500, n), 0).astype(np.int32) for n in (0, 1, 19, 20, 21, 300, 5, 77)]
    together = lm.log10_scores(network, texts)
    for text, score in zip(texts, together):
        h, total = np.zeros((1, lm.STATE), np.float32), 0.0
        for t, token in enumerate(text):
            _, steps, h = network.states(np.array([[0 if t == 0 else text[t - 1]]]), np.ones((1, 1), np.float32), h)
            total += float(network.outputs(h, np.array([token]))[0][0])
        assert score == pytest.approx(total / math.log(10), rel=1e-4)


def test_training_learns_an_order():
    draw = random.Random(1)
    texts = []
    for _ in range(200):
        at, words = draw.randint(2, 40), []
        for _ in range(30):
            words.append(at)
            at = 2 + (at * 3 + 1) % 40
        texts.append(np.array([*words, 0], np.int32))
    network = lm.Network()
    before, memory = lm.log10_scores(network, texts).mean(), None
    for _ in range(30):
        memory = lm.learn(network, texts, 0.02, memory)
    assert lm.log10_scores(network, texts).mean() > before + 25


def test_states_that_are_not_held_are_the_same():
    draw = np.random.default_rng(3)
    network = lm.Network()
    texts = [np.append(draw.integers(1, 200, n), 0).astype(np.int32) for n in (1, 9, 30, 70, 2)]
    inputs, _, keep, _, _ = next(iter(lm.lanes(texts)))
    h = draw.normal(size=(inputs.shape[1], lm.STATE)).astype(np.float32) / 2
    held, steps, last = network.states(inputs, keep, h)
    hidden, none, end = network.states(inputs, keep, h, hold=False)
    assert len(steps) == len(inputs) and not none
    assert np.array_equal(held, np.stack([s[5] for s in steps])) and np.array_equal(held, hidden) and np.array_equal(last, end)


def test_scores_do_not_depend_on_batches(spark):
    """Texts of several batches are read side by side, a long one and an empty one among them."""
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9 * 20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found.append({r.doc_id: r for r in lm.score(docs).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) == 60
    for i, r in found[0].items():
        assert r.score == pytest.approx(found[1][i].score, rel=1e-4)
        assert (r.n_tokens, r.n_known, r.held_out) == (found[1][i].n_tokens, found[1][i].n_known, found[1][i].held_out)


def test_words_split_by_arrow_are_the_same():
    texts = [" a\x0bB\x0c c\r\n\td ", "", " x Y É ÀB", "a\x00b \x1c z", "   ", "one", None, "W" * 50]
    words, text = lm.words_in(pa.array(texts))
    assert [(w, i) for w, i in zip(words.to_pylist(), text)] == [(w, i) for i, t in enumerate(texts) for w in lm.words_of(t)]
    at = lm.places_in(words, pa.array([b"one", b"a", b"c"]))
    tokens = lm.network_tokens(at, text, len(texts), 2)
    place = {b"one": 2, b"a": 3}
    assert [t.tolist() for t in tokens] == [[*(place.get(w, 1) for w in lm.words_of(t)), 0] for t in texts]


def test_pieces_hold_all_rows_and_little_text(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 100)
    texts = ["x" * n for n in (0, 30, 60, 500, 0, 99, 1, 1, 250, 7)]
    found = [p.column(1).to_pylist() for p in lm.pieces(pa.RecordBatch.from_pydict({"id": list(range(10)), "text": texts}))]
    assert [t for p in found for t in p] == texts and len(found) > 3
    assert all(sum(map(len, p)) - max(map(len, p)) <= 100 for p in found)
    assert list(lm.pieces(pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))) == []


def test_a_value_s_lanes_lie_together():
    """Numpy is slow on rows of 16 values; before, a lane's values lay together."""
    draw = np.random.default_rng(4)
    network = lm.Network()
    texts = [np.append(draw.integers(1, 200, n), 0).astype(np.int32) for n in (40, 30, 21, 60)]
    inputs, _, keep, _, _ = next(iter(lm.lanes(texts)))
    hidden, steps, last = network.states(inputs, keep, np.zeros((inputs.shape[1], lm.STATE), np.float32))
    assert hidden.shape == (*inputs.shape, lm.STATE) and hidden.strides[1] == last.strides[0] == hidden.itemsize
    assert all(part.strides[0] == part.itemsize for step in steps for part in step)
