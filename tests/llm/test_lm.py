import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from loam.llm import lm
from pyspark.sql import functions as F


def small(n=12, size=5, seed=0):
    rng = np.random.default_rng(seed)
    model = lm.Model.new(rng.random(n) + 0.1, size)
    for p in model.params():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32) * (p > -1e8)
    return model


def test_classes_are_small_for_common_words():
    starts = lm.class_starts(np.concatenate([1e6 / np.arange(1, 5001), [10, 10]]))
    sizes = np.diff(starts)
    assert starts[0] == 0 and starts[-1] == 5002 and sizes[-1] == 2 and (sizes > 0).all() and sizes[0] < 10 < 200 < sizes[-2]
    assert lm.class_starts(np.array([1.0, 1.0])).tolist() == [0, 2]


def test_commonest_words_among_ties(spark):
    rows = [(f"a{i}".encode(), 1000 - i) for i in range(20)] + [(f"t{i}".encode(), 3) for i in range(5000)] + [(b"rare", 1)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    words, n = lm.commonest(counts, 1000)
    assert words[:20] == [r[0] for r in rows[:20]] and 900 < len(words) <= 1000 and set(n[20:]) == {3} and lm.commonest(counts, 1000)[0] == words
    assert len(lm.commonest(counts, 10_000)[0]) == 5021
    few = lm.commonest(counts.filter("n = 3"), 40)[0]
    assert 30 < len(few) <= 40  # all words alike: some are taken all the same


def test_probabilities_sum_to_one():
    model = small()
    h = np.random.default_rng(1).normal(0, 1, (3, 5)).astype(np.float32)
    total = sum(np.exp(model.log_probabilities(h, np.full(3, t))) for t in range(12))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradients_against_differences():
    model = small()
    rng = np.random.default_rng(2)
    inputs, targets, fresh, h = rng.integers(0, 12, (4, 3)), rng.integers(-1, 12, (4, 3)), rng.random((4, 3)) < 0.3, rng.normal(0, 1, (3, 5)).astype(np.float32)

    def run():
        grads = [np.zeros_like(p) for p in model.params()]
        _, loss, read, met = model.gradients(inputs, targets, fresh, h, model.class_of, grads)
        others = np.setdiff1d(np.arange(len(model.gru.x)), read)
        assert not grads[0][others].any() and all(not grads[4][a:b].any() for c, (a, b) in enumerate(zip(model.starts[:-1], model.starts[1:], strict=True)) if c not in met)
        return loss, grads

    for k, p in enumerate(model.params()):
        grad = run()[1][k]
        at = np.unravel_index(np.abs(grad).argmax(), p.shape)
        was = p[at]
        p[at] = was + 0.01
        up = run()[0]
        p[at] = was - 0.01
        down = run()[0]
        p[at] = was
        assert abs((up - down) / 0.02 - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def test_state_is_carried_through_windows_and_batches(monkeypatch):
    model = small()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 10, n) for n in (0, 3, 500, 70, 1, 70)]

    def one(d):
        h, total, before = np.zeros((1, 5), np.float32), 0.0, model.start
        for t in [*d, model.end]:
            h = model.gru.step(np.array([before]), h)
            total += model.log_probabilities(h, np.array([t]))[0]
            before = t
        return total / np.log(10)

    want = [one(d) for d in docs]
    assert np.allclose(model.score(docs), want, rtol=1e-4)
    monkeypatch.setattr(lm, "SCORE_TOKENS", 100)
    assert np.allclose(model.score(docs), want, rtol=1e-4)


def test_window_against_single_steps():
    gru, rng = small().gru, np.random.default_rng(6)
    ids, fresh, first, d_states = rng.integers(0, 12, (7, 3)), rng.random((7, 3)) < 0.3, rng.normal(0, 1, (3, 5)).astype(np.float32), rng.normal(0, 1, (7, 3, 5)).astype(np.float32)
    states, kept = gru.window(ids, fresh, first)
    got = [np.zeros_like(p) for p in gru.params()]
    rows = gru.back_window(kept, fresh, np.ascontiguousarray(d_states.transpose(0, 2, 1)), got[1], got[2])
    np.add.at(got[0], ids.ravel(), rows.T)
    h, single, want = first, [], [np.zeros_like(p) for p in gru.params()]
    for t in range(7):
        h, k = gru.step_kept(ids[t], np.where(fresh[t][:, None], np.float32(0), h))
        assert np.allclose(states[t].T, h, atol=1e-6)
        single.append(k)
    back = np.zeros_like(first)
    for t in range(6, -1, -1):
        back = gru.back(single[t], back + d_states[t], want)
        back[fresh[t]] = 0
    assert all(np.allclose(g, w, atol=1e-5) for g, w in zip(got, want, strict=True))


def test_words_of_texts():
    texts = ["", None, " A\x0bb \x0cc\x1c\x85\xa0D ", "\t", "\u00c9A x" * 3, "one", "\r\n", "no edge", "Z" * 50 + " z"]
    want = [[w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words, bounds = lm.lm_words(pa.array(["left out", *texts])[1:])
    assert [words[i:j].to_pylist() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] == want
    known = sorted({w for ws in want for w in ws})[::2]
    ids = [[known.index(w) if w in known else 99 for w in ws] for ws in want]
    for piece in (1, 10, 1000):
        assert pa.concat_arrays(list(lm._pieces(pa.array(texts), piece))).to_pylist() == texts
    assert [a.tolist() for a in lm._encoded(pa.array(texts), pa.array(known), 99)] == ids
    assert list(lm._encoded(pa.array([], pa.string()), pa.array(known), 99)) == []


def test_words_are_counted_without_an_object_for_each():
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i}" for i in range(200_000)), "w1 W2", None])], names=["body"])
    tracemalloc.start()
    made = list(lm._count(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = Counter()
    for b in made:
        found.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert len(found) == 200_000 and found[b"w1"] == found[b"w2"] == 2 and found[b"w3"] == 1
    assert most < 5_000_000


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base score) of each row."""
    tokens = [[w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(count.values()), len(count)
    return [(h, len(ts), sum(count[t] > 0 for t in ts), n, sum(np.log10((count[t] + 1) / (n + v + 1)) for t in ts)) for ts, h in zip(tokens, held, strict=True)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÉA", "Hello,"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(150)]
    return rows + [(150, None), (151, ""), (152, "\x1c  x\x0b"), (153, "rare " * 3 + "only here"), (154, " ".join(words) * 60), (None, "w1 w2"), (3, "w1 again"), (3, "w1 again")]


def test_base_against_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "score": F.lit(2)})
    want = sorted((str(i), *b) for (i, _), b in zip(corpus, brute(corpus), strict=True))
    for hot, vocabulary in ((lm.HOT, lm.VOCABULARY), (40, 20)):  # all words hot, and most by the join
        got = lm.score(df, lm.train(df, hot=hot, vocabulary=vocabulary)).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)


def test_model_learns_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = rng.randrange(20)
        rows.append((i, " ".join(f"w{(a + k) % 20}" for k in range(30))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm.score(df, lm.train(df)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_empty_tables(docs, spark):
    empty = lm.train(docs([]))
    assert empty.model is None and lm.score(docs([]), empty).count() == 0
    r = lm.score(docs(["a b"]), empty).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    nulls = docs([None, None])
    assert lm.score(nulls, lm.train(nulls)).count() == 2


def test_model_learns_from_rows_beyond_the_sample(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{i % 50}x{k}" for k in range(8))) for i in range(600)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "VOCABULARY", 10)
    monkeypatch.setattr(lm, "SUMMED", 2)
    trained = lm.train(df, rows=4, tokens=40)
    model = trained.model
    assert model.words == int((trained.tokens - trained.documents) ** 0.5)  # grows with the tokens
    frequencies = np.concatenate([trained.hot_counts[: model.words], [trained.documents, trained.beyond + 1]]).astype(float)
    assert (model.gru.x != lm.Model.new(frequencies).gru.x).any(1)[: model.words].all()  # all words were read, and not four documents' alone


def test_learning_on_reads_every_symbol_once():
    rng = np.random.default_rng(4)
    docs = [(rng.integers(0, 10) + np.arange(n)) % 10 for n in [0, 1, 700, *rng.integers(0, 60, 300)]]
    model = lm.Model.new(np.ones(12))
    before = model.score(docs).sum()
    read, met = lm.learn_on(model, iter(docs), streams=8, rate=0.01)
    want = np.bincount(np.concatenate([np.append(d, model.end) for d in docs]), minlength=12)
    assert (read[:10] == want[:10]).all() and read[model.start] == len(docs)
    assert met.sum() == want.sum() == read.sum()
    assert model.score(docs).sum() > 0.6 * before
