import random

import numpy as np
import pytest
from loam.llm import neardup
from loam.llm.common import word_hashes
from loam.llm.graph import components
from pyspark.sql import functions as F


def shingle_set(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(texts):
    """(class id, number of links) of each text by its position."""
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    ids = sorted(first.values())
    sets = {i: shingle_set(texts[i]) for i in ids}
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(first[t or ""]), links[first[t or ""]]) for i, t in enumerate(texts)}


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = [None, "", " ", "a b", "a b", "a b c", "  a b  ", "a b c d e", None]
    for _ in range(groups):
        words = [word() for _ in range(rng.randrange(20, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            other = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 25))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]))
    rng.shuffle(texts)
    return texts


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(df).collect()}


def test_against_brute_force(docs):
    texts = corpus()
    want = brute(texts)
    found = got(docs(texts))
    assert found == want
    kept = neardup.keep_one(docs(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_hot_groups_go_by_chunks(docs, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_CHUNK", 16)
    monkeypatch.setattr(neardup, "CLUSTER_CHUNK", 16)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        other = list(words)
        for _ in range(2):
            other[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(other))
    texts += [texts[0]] * 40 + corpus(2, 5)
    assert got(docs(texts)) == brute(texts)


def test_long_texts_nulls_repeats_and_extra_columns(docs, spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = docs([(1, long), (2, long + " end"), (None, long), (3, "x y z"), (3, "x y z"), (4, None)])
    df = df.withColumns({"key": F.lit(1), "uid": F.lit(2), "root": F.lit(3), "id": F.lit("mine"), "cell": F.lit(7), "__key": F.lit("k"), "__id": F.lit(9)})
    found = sorted((str(r.doc_id), r.class_id, r.n_copies, r.n_links) for r in neardup.join(df).collect())
    assert found == [("1", 1, 2, 1), ("2", 1, 1, 1), ("3", 3, 2, 0), ("3", 3, 2, 0), ("4", 4, 1, 0), ("None", 1, 2, 1)]
    kept = neardup.keep_one(df)
    assert {(r.key, r.id, r.cell, r["__key"], r["__id"]) for r in kept.collect()} == {(1, "mine", 7, "k", 9)}
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert neardup.join(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def reach(own, similarity=0.8):
    return 1 - np.prod([1 - similarity**d for d in own])


def test_prefixes_are_shortened_until_the_target():
    alone = np.ones((neardup.TREES, 5), int)
    assert neardup.depths(alone) == [4] * 10 + [5] * 10 and reach(neardup.depths(alone)) >= neardup.TARGET
    assert reach(neardup.depths(alone)[:10] + [5] * 10) >= neardup.TARGET > reach([4] * 9 + [5] * 11)
    crowd = alone.copy()
    crowd[:3] = [900_000, 200_000, 40_000, 9000, 2000]  # three trees go through a passage that very many texts share
    own = neardup.depths(crowd)
    assert own[:3] == [8] * 3 and set(own[3:]) == {4, 5} and reach(own) >= neardup.TARGET
    crowd[:] = [900_000, 200_000, 40_000, 9000, 2000]
    assert sorted(neardup.depths(crowd)) == sorted(neardup.depths(alone))
    assert neardup.depths(alone, threshold=1.0) == [8] * neardup.TREES


def test_texts_stop_at_different_depths(docs, spark, monkeypatch):
    """Texts that share a long passage stay deep in the trees whose minima it gives; others do not; all links are found."""
    monkeypatch.setattr(neardup, "CROWD", 6)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(120)]
    texts = [" ".join(passage + [word() for _ in range(90)]) for _ in range(60)]
    texts += [t + " " + word() for t in texts[::3]] + [" ".join(word() for _ in range(100)) for _ in range(30)]
    seen = []
    plain = neardup.depths
    found = got(docs(texts))
    assert found == brute(texts)
    m = [neardup.labels(neardup.minima(neardup.shingles(t.encode()))) for t in texts]
    for prefix, rest in m:
        sizes = np.zeros((neardup.TREES, 5), int)
        for i in range(neardup.TREES):
            same = [r for p, r in m if p[i] == prefix[i]]
            sizes[i] = [sum((int(r[i]) ^ int(rest[i])) >> 16 * (4 - k) == 0 for r in same) if k else len(same) for k in range(5)]
        seen.append(tuple(plain(sizes)))
    assert len(set(seen)) > 3 and all(reach(d) >= neardup.TARGET for d in seen)
    assert max(map(max, seen)) > 5 and seen[-1] == tuple([4] * 10 + [5] * 10)


def test_intersections_and_minima():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 500, 80).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = neardup.intersections(sets)
    assert (off[~np.eye(30, dtype=bool)] == want[~np.eye(30, dtype=bool)]).all()
    assert (neardup.intersections(sets[:10], sets[10:]) == want[:10, 10:]).all()
    a, b = neardup.mix64(np.arange(10_000)), neardup.mix64(np.arange(1000, 10_000))
    assert abs((neardup.minima(a) == neardup.minima(b)).mean() - 0.9) < 0.12


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {i: find(i) for e in edges if e[0] != e[1] for i in e}
    out = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in out.collect()} == want


@pytest.mark.parametrize("text", ["", " ", "a", "a b", " lead  tail ", "é\u00a0x\x1cy z\n\tq", "w" * 10_000 + " w", "ab ba aa bb a b"])
def test_word_hashes(text):
    words = text.encode().split()
    got = word_hashes(text.encode()).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words))
    assert got == [word_hashes(w).tolist()[0] for w in words]
