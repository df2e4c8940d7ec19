import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from loam.llm import quality
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ü", "x#", "|", " ", "\x1c", "\U0001f600", "long"]), max_size=60), st.sampled_from([" ", "\n", "\t ", "\n\n"]))
def test_base_counts_against_brute_force(words, space):
    text = space.join(words)
    assert quality.statistics(text.encode())[0] == brute(text)


def test_many_distinct_words_do_not_overflow():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 5])
    assert quality.repeated_words(ids, 6) == quality.repeated_words(ids, 3_000_000) == 6


def test_scores_are_monotonic_and_separate():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 12))
    y = ((x[:, 2] < 0.6) | (rng.random(2000) < 0.1)).astype(float)
    trees = quality.fit_trees(x, y, list(quality.FEATURES.values()))
    assert ((trees.score(x) > 0.5) == (x[:, 2] < 0.6)).mean() > 0.97
    for j, way in enumerate(quality.FEATURES.values()):
        if way:
            grid = np.repeat(x[:20], 50, 0)
            grid[:, j] = np.tile(np.linspace(0, 1, 50), 20)
            assert (np.diff(trees.score(grid).reshape(20, 50)) * way >= -1e-12).all()


def test_table(docs, spark):
    good = " ".join(f"w{i}" for i in range(80)) + "."
    junk = " ".join(f"w{i}%%%" for i in range(80))
    texts = [None, "", good, junk, "a b c " * 40, good * 2000]
    texts += [" ".join(f"w{k % 90}" for k in range(55 + i)) for i in range(40)] + [" ".join(f"w{k % 90}%%%" for k in range(55 + i)) for i in range(40)]
    df = docs(texts).withColumns({"score": F.lit("x"), "kept": F.lit("y"), "x": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i < 46), 0) for i in range(6, 86)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(df, labels)
    got = {r.doc_id: r for r in quality.assess(df, trees).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert tuple(r[c] for c in quality.BASE) == brute(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert got[2].kept and not got[3].kept and not got[4].kept
    kept = quality.keep_good(df, trees)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_empty_tables(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    trees = quality.train(docs([]), none)
    assert quality.assess(docs([]), trees).count() == 0
    assert [r.kept for r in quality.assess(docs(["a b"]), trees).collect()] == [False]
