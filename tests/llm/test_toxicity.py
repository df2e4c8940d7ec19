import random
import zlib

import numpy as np
import pytest
from loam.llm import toxicity
from pyspark.sql import functions as F

BAD = ["blorgface", "snarkwit", "dumplout"]


def brute_features(word):
    out = np.zeros(toxicity.CODES)
    n = len(word)
    total = 0.0
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, min(n, i + toxicity.SPAN)):
                w = toxicity.DECAY ** (k - i + 1)
                a, b, c = (word[x] - 97 for x in (i, j, k))
                out[(a * toxicity.ALPHABET + b) * toxicity.ALPHABET + c] += w
                total += w * w
    return out / np.sqrt(total)


def test_kernel_against_brute_force():
    words = [b"idiot", b"ididiot", b"abc", b"aaaa", b"trashcanlids"]
    assert np.allclose(toxicity.features(words), [brute_features(w) for w in words], atol=1e-5)
    k = toxicity.features([b"blorgface", b"blorgxface", b"quietness"])
    assert k[0] @ k[1] > 0.5 > 0.1 > k[0] @ k[2]


def test_units():
    assert toxicity.letters(b"i-d.i*ot!") == b"idiot" and toxicity.letters(b"1d10t") == b"idiot" and toxicity.letters(b"2024") == b""
    assert b"idiot" in toxicity.units("you I D i, o t now") and toxicity.units(None) == toxicity.units("") == set()
    assert len(toxicity.pieces(b"a" * 100_000)) > 1000 and toxicity.pieces("é1".encode()) == []


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    rows = []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return df, {i: t for i, _, t in rows}, toxicity.train(df, labels), vocabulary


def test_held_out_documents(learned):
    df, truth, machine, _ = learned
    got = toxicity.score(df, machine).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_hidden_insults_and_odd_texts(learned, docs):
    _, _, machine, vocabulary = learned
    clean = " ".join(vocabulary[:40])
    texts = [f"{clean} b-l-o-r-g-f-a-c-e s n a r k w i t dumpl0ut", f"{clean} blorgxface snarkqwit dumpelout", clean, None, "", "1 2 3", (clean + " ") * 300, (clean + " ") * 300 + " ".join(BAD) * 40]
    df = docs(texts).withColumns({"top": F.lit("t"), "hits": F.lit("h"), "score": F.lit(1)})
    got = {r.doc_id: r.predicted for r in toxicity.score(df, machine).collect()}
    assert [got[i] for i in range(7)] == [1, 1, 0, 0, 0, 0, 0]


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs(["a b"]), none)
    assert toxicity.score(docs([]), machine).count() == 0
    assert [r.predicted for r in toxicity.score(docs([(None, "x y zebra")]), machine).collect()] == [0]


def test_every_toxic_sentence_with_a_witness_is_a_row(spark, monkeypatch):
    rng = random.Random(8)
    insults = ["zz" + "".join(rng.choice("bcdfgk") for _ in range(6)) for _ in range(450)]
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    rows = [(i, "".join(" ".join(rng.sample(plain, 6) + (rng.sample(insults, 1) if i % 2 else [])) + ". " for _ in range(10)), i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    fit = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "ROUNDS", 0)
    monkeypatch.setattr(toxicity, "fit_machine", lambda positive, *rest: seen.append((positive, rest[2])) or fit(positive, *rest))
    toxicity.train(df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    used = {p for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 3 != 1 for s in toxicity.sentences(t) for p in s if p in set(x.encode() for x in insults)}
    assert len(used) > 400 and used <= set(seen[0][0])  # though each stands in few sentences


def test_sentences_and_their_highest_units(spark):
    assert toxicity.sentences("One two. i.d.i.o.t here!\n\n12 !? Thr-ee") == [{b"one", b"two"}, {b"idiot", b"here"}, {b"three"}]
    assert toxicity.sentences(None) == toxicity.sentences("") == []
    df = spark.createDataFrame([(1, "aaaa bbbbb. cccccc"), (1, "aaaa. bbbbb"), (0, "aaaa")], "label int, body string")
    got = {(r.label, r.piece, r.n, r.value) for r in toxicity.sentence_rows(df, lambda y, words: [float(len(w) * y) for w in words]).collect()}
    assert got == {(1, b"bbbbb", 2, 5.0), (1, b"cccccc", 1, 6.0), (1, b"aaaa", 1, 4.0), (0, b"aaaa", 1, 0.0)}


def test_insults_by_a_common_stem(spark):
    """No word is frequent; their first letters are the only sign."""
    rng = random.Random(9)
    end = lambda n: "".join(rng.choice("aeioulmnrst") for _ in range(n))
    rows = [(i, ". ".join(" ".join([end(7) for _ in range(6)] + ["bomqve" + end(5)] * (i % 3 == 0 and k == 2)) for k in range(5)), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality"), "toxic"))
    got = [r for r in toxicity.score(df, machine).collect() if r.held_out]
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got)


def slow_value(machine, text):
    """The machine over every subsequence of every piece of a text, one by one."""
    best, hits, n = -1.0, 0, 0
    for u in toxicity.units(text):
        own = max((float(brute_features(p) @ machine.weights[:-1]) + machine.bias for p in toxicity.pieces(u)), default=-1.0)
        best, hits, n = max(best, own), hits + (own > toxicity.HIT), n + 1
    z = machine.pooled @ toxicity.pooled_features(np.array([[best, hits, n]], float))[0]
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force(learned, docs):
    df, _, machine, _ = learned
    texts = [r.text for r in df.filter("doc_id < 12").collect()] + ["blorgface", "", "s.n.a.r.k wit", "x" * 90]
    got = {r.doc_id: r.score for r in toxicity.score(docs(texts), machine).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [slow_value(machine, t) for t in texts], atol=1e-4)
