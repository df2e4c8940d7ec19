import random
import zlib

import numpy as np
import pytest
from loam.llm import langid
from pyspark.sql import functions as F

LANGS = {"xx": ["ba", "ko", "mi", "tu"], "yy": ["str", "ény", "ül", "ösk"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = langid.Net.new(["a", "b", "c"], 5)
    for p in net.params():
        p[...] = rng.normal(0, 0.5, p.shape)
    words, targets, weights = [b"ab", b"abcd", b"x", b"hello"], rng.dirichlet([1, 1, 1], 4).astype(np.float32), np.array([1, 2, 1, 0.5], np.float32)

    class Grab:
        def step(self, grads):
            self.grads = grads

    grab = Grab()
    net.learn(words, targets, weights, grab)
    for grad, p in zip(grab.grads, net.params(), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), p.shape)
        was = p[at]
        p[at] = was + 0.01
        up = net.learn(words, targets, weights, Grab())
        p[at] = was - 0.01
        down = net.learn(words, targets, weights, Grab())
        p[at] = was
        assert abs((up - down) / 0.02 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


def shaken(languages, size=6):
    net, rng = langid.Net.new(languages, size), np.random.default_rng(7)
    for p in net.params():
        p[...] = rng.normal(0, 0.6, p.shape)
    return net


def slow_sums(net, line):
    """One byte at a time, both ways, over the whole line."""
    states = []
    for gru, data in ((net.front, line), (net.back, line[::-1])):
        h, own = np.zeros((1, gru.size), np.float32), []
        for byte in data:
            h = gru.step(np.array([byte]), h)
            own.append(h[0])
        states.append(own)
    total = np.zeros(len(net.languages))
    for at, byte in enumerate(line):
        z = np.concatenate([states[0][at], states[1][len(line) - 1 - at]]) @ net.out + net.bias
        if byte != 32:
            total += np.exp(z) / np.exp(z).sum()
    return total


LINES = [b"ab", b"abcdefg hij", b"q", "schön war es".encode(), b"x" * 700, b"ab cd " * 40 + b"e"]


def test_lines_side_by_side_against_byte_by_byte(monkeypatch):
    net = shaken(["a", "b", "c"])
    want = np.array([slow_sums(net, x) for x in LINES])
    assert np.allclose(net.sums(LINES), want, atol=1e-3)
    assert np.allclose(want.sum(1), [len(x) - x.count(b" ") for x in LINES])
    monkeypatch.setattr(langid, "TOGETHER", 800)
    assert np.allclose(net.sums(LINES), want, atol=1e-3)
    monkeypatch.setattr(langid, "SEGMENT", 50)  # states of both directions are carried over the segments
    assert np.allclose(net.sums(LINES), want, atol=1e-3)


def test_documents_against_byte_by_byte(docs, monkeypatch):
    net = shaken(["a", "b", "c"])
    rng = random.Random(4)
    texts = ["\n".join(text(rng, rng.choice(["xx", "yy"]), rng.randrange(1, 9)) + rng.choice(["", " 12!", "\n", " A|B"]) for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    texts += [texts[0] + "\n" + texts[0], "a" * 3000 + " " + "b" * 3000]
    for cache in (10**9, 0):
        monkeypatch.setattr(langid, "CACHE", cache)
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(texts), net).collect()}
        for i, t in enumerate(texts):
            lines = []
            for raw in t.split("\n"):
                words = "".join(c.lower() if c.isalpha() else " " for c in raw).split()
                if words:
                    p = slow_sums(net, " ".join(words).encode())
                    lines.append((np.log1p(len(words)), p / p.sum()))
            pooled = sum(w * p for w, p in lines) / sum(w for w, _ in lines)
            assert got[i][0] == net.languages[pooled.argmax()] and abs(got[i][1] - pooled.max()) < 1e-3


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(["xx", "yy"]), rng.randrange(5, 40)), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df, langid.train(df.unionByName(spark.createDataFrame([(None, "q", "zz"), (7, None, "zz"), (8, "r", None)], df.schema)))


def test_held_out_accuracy(learned):
    df, net = learned
    assert net.languages == ["xx", "yy"]
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = langid.predict(df, net).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_texts(learned, docs):
    _, net = learned
    rng = random.Random(2)
    texts = [None, "", "12 34 !", "\U0001f600", text(rng, "yy", 20_000), "bakomitu" * 30_000, "ÖSK STRÉNY", "\n".join([text(rng, "xx", 12), text(rng, "yy", 40), text(rng, "xx", 12)])]
    df = docs(texts).withColumns({"lang_pred": F.lit("xx"), "score": F.lit(1), "body": F.lit("")})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, net).collect()}
    assert [got[i][0] for i in range(8)] == ["und"] * 4 + ["yy", "xx", "yy", "xx"] and got[0][1] == 0


def test_empty_tables(learned, docs):
    _, net = learned
    assert langid.train(docs(["a b"])) is None
    assert langid.predict(docs([]), net).count() == 0
    assert [r.lang_pred for r in langid.predict(docs(["a"]), None).collect()] == ["und"]
    assert [r.held_out for r in langid.predict(docs([(None, "ba"), (None, "ba")]), net).collect()] == [False, False]
