import random

from hypothesis import given, settings
from hypothesis import strategies as st
from loam.llm import decontam
from pyspark.sql import functions as F


def brute_tiles(p, t, least):
    """Marks the longest unmarked common run again and again."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best = 0
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, where = k, (i, j)
        if best < least:
            return out
        out.append(best)
        for k in range(best):
            mp[where[0] + k] = mt[where[1] + k] = True


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40), st.integers(2, 4))
def test_tiles_do_not_overlap_match_and_start_with_the_longest(p, t, least):
    got = decontam.tiles(p, t, [False] * len(t), least)
    want = brute_tiles(p, t, least)
    assert all(p[i : i + k] == t[j : j + k] and k >= least for i, j, k in got)
    assert len({i + x for i, _, k in got for x in range(k)}) == len({j + x for _, j, k in got for x in range(k)}) == sum(k for *_, k in got)
    assert bool(got) == bool(want) and max((k for *_, k in got), default=0) == max(want, default=0)


def test_distinct_words_tile_as_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        p = list(range(40))
        cuts = sorted(rng.sample(range(40), 4))
        parts = [p[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        rng.shuffle(parts)
        t = [x for part in parts for x in [*part, 100 + rng.randrange(9)]]
        assert sorted(k for *_, k in decontam.tiles(p, t, [False] * len(t))) == sorted(brute_tiles(p, t, 5))


def setup(docs, spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) for _ in range(20)]
    filler = lambda n: " ".join(word() for _ in range(n))
    w = items[0].split()
    texts = [
        f"{filler(100)} {items[3]} {filler(50)}",
        f"{filler(20)} {' '.join(w[20:])} {filler(30)} {' '.join(w[:10])} {filler(5)} {' '.join(w[10:20])}",  # reordered
        f"{filler(20)} {items[5].upper().replace(' ', ', ')}!",
        f"{filler(20)} {' '.join(items[6].split()[:9])} {filler(60)}",  # too little
        filler(400),
        None,
        "",
        f"{filler(15_000)} {items[7]} {filler(5_000)} {items[8]}",
        " ".join(["a"] * 5000),
    ]
    bench = spark.createDataFrame([*enumerate(items), (20, "too short"), (21, None), (22, ""), (23, "a " * 60)], "item_id long, text string")
    return texts, bench


def test_planted_passages(docs, spark):
    texts, bench = setup(docs, spark)
    df = docs(texts).withColumns({"item_id": F.lit(-1), "coverage": F.lit(0), "body": F.lit("b")})
    for chunk in (decontam.CHUNK_WORDS, 100):
        found = decontam.find(df, bench, chunk_words=chunk).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 3), (1, 0), (2, 5), (7, 7), (7, 8), (8, 23)]
        assert {(r.doc_id, r.n_tiles) for r in found if r.doc_id < 3} == {(0, 1), (1, 3), (2, 1)}
        kept = decontam.drop_leaks(df, bench, chunk_words=chunk)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(docs, spark):
    texts, bench = setup(docs, spark)
    assert decontam.find(docs([]), bench).count() == 0 and decontam.drop_leaks(docs([]), bench).count() == 0
    assert decontam.find(docs(texts), bench.limit(0)).count() == 0 and decontam.drop_leaks(docs(texts), bench.limit(0)).count() == len(texts)


def test_items_shorter_than_a_seed_match_whole(docs, spark):
    bench = spark.createDataFrame([(1, "Quick fox"), (2, "alpha beta gamma delta"), (3, "solo"), (4, " .. "), (5, None), (6, "one two three four five six")], "item_id long, text string")
    texts = ["the quick, FOX runs; quick fox", "quick brown fox", "alpha beta gamma delta", "alpha beta gamma", "so lo solos", "Solo!", "x one two three four five six y solo", None, ""]
    for chunk in (decontam.CHUNK_WORDS, 3):
        found = decontam.find(docs(texts), bench, chunk_words=chunk).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles, r.tiles) for r in found) == [
            (0, 1, 1.0, 1, "0:1:2"), (2, 2, 1.0, 1, "0:0:4"), (5, 3, 1.0, 1, "0:0:1"), (6, 3, 1.0, 1, "0:8:1"), (6, 6, 1.0, 1, "0:1:6"),
        ]
        assert sorted(r.doc_id for r in decontam.drop_leaks(docs(texts), bench, chunk_words=chunk).collect()) == [1, 3, 4, 7, 8]


def test_item_ids_of_any_type(docs, spark):
    texts, bench = setup(docs, spark)
    for kind in ("int", "string", "decimal(10,0)"):
        found = decontam.find(docs(texts), bench.withColumn("item_id", F.col("item_id").cast(kind)))
        assert found.schema["item_id"].dataType.simpleString() == kind and sorted((r.doc_id, str(r.item_id)) for r in found.collect())[0] == (0, "3")


def test_hot_seeds_and_repeated_runs():
    """Many items with one opening, and a text that repeats it: only items with enough words under seeds are tiled."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    opening = " ".join(word() for _ in range(5))
    texts = [f"{opening} " + " ".join(word() for _ in range(20)) for _ in range(400)]
    items = decontam.Items(list(range(400)), [t.encode() for t in texts])
    seen = []
    plain = decontam.tiles
    try:
        decontam.tiles = lambda p, t, *rest: seen.append(len(t)) or plain(p, t, *rest)
        got = items.matches(" ".join([opening] * 6000 + [texts[17]] * 50 + [word()] + [texts[5][len(opening) :]]), decontam.COVERAGE)
    finally:
        decontam.tiles = plain
    assert [(i, share) for i, share, _ in got] == [(5, 1.0), (17, 1.0)] and len(seen) == 2
    assert items.matches(" ".join([opening, word()] * 6000), decontam.COVERAGE) == []


def test_repeated_runs_tile_as_if_all_were_kept():
    rng = random.Random(6)
    for _ in range(40):
        target = [rng.randrange(4) for _ in range(rng.randrange(10, 26))]
        parts = []
        for _ in range(30):
            a = rng.randrange(len(target))
            parts += [str(x) for x in target[a : a + rng.randrange(3, 12)]] + ["x" + str(rng.randrange(3))]
        text = " ".join(parts * 3)
        got = decontam.Items([0], [" ".join(map(str, target)).encode()]).matches(text, 0.01)
        words = text.split()
        want = decontam.tiles([str(x) for x in target] and target, [int(w) if w.isdigit() else -1 for w in words], [not w.isdigit() for w in words])
        assert [t for *_, t in got] == ([want] if want else [])
