import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from loam.config import Configuration
from loam.operators import folds, layout, lookup, merge
from loam.plans.policy import cascade
from loam.plans.replay import EVENTS, live_tables

SIZES = st.lists(st.integers(1, 30), max_size=60)


@given(SIZES, st.integers(1, 60), st.integers(1, 60))
def test_post_add_fold(sizes, limit, cut):
    want, running, number = [], 0, 0
    for s in sizes:
        want.append(number)
        running += s
        if running >= limit:
            running, number = 0, number + 1
    group, left = folds.after_full(np.array(sizes, int), limit)
    assert group.tolist() == want and left == running
    if cut < len(sizes):  # in two parts, the open size carried
        a, carried = folds.after_full(np.array(sizes[:cut]), limit)
        b, _ = folds.after_full(np.array(sizes[cut:]), limit, carried)
        assert [*a, *(b + a[-1] + (carried == 0))] == want


@given(SIZES, st.integers(1, 60))
def test_pre_add_fold(sizes, limit):
    want, used, number = [], 0, 0
    for s in sizes:
        if used and used + s > limit:
            used, number = 0, number + 1
        used += s
        want.append(number)
    assert folds.before_full(np.array(sizes, int), limit).tolist() == want


@given(SIZES, st.integers(1, 60), st.integers(1, 150))
def test_table_cut_never_drops(sizes, block, limit):
    want, number, done, used, n = [], 0, 0, 0, 0
    for s in sizes:
        if n and used + s > block:
            done += folds.block_bytes(used, n)
            used, n = 0, 0
        used, n = used + s, n + 1
        want.append(number)
        if done >= limit:
            number, done, used, n = number + 1, 0, 0, 0
    assert folds.table_cuts(np.array(sizes, int), block, limit).tolist() == want


def run(spark, text):
    return spark.createDataFrame([(t[0], bytearray(t.encode())) for t in text.split()], "key string, value binary")


def values(df):
    return [bytes(r.value).decode() for r in df.orderBy("key").collect()]


def test_merges(spark):
    one, two = run(spark, "A1 B1 D1"), run(spark, "A2 C2 D2 E2")
    assert values(merge.merge_runs([one, two])) == ["A1", "B1", "C2", "D1", "E2"]
    assert [bytes(r.value).decode() for r in merge.merge_with_duplicates([one, two]).collect()] == ["A1", "A2", "B1", "C2", "D1", "D2", "E2"]
    empty = one.limit(0)
    assert values(merge.merge_runs([empty, two])) == ["A2", "C2", "D2", "E2"]
    rows = [r.withColumn("pos", merge.F.monotonically_increasing_id()) for r in (two, one)]
    assert [bytes(r.value).decode() for r in merge.concat_runs(rows, "pos").collect()] == ["A2", "C2", "D2", "E2", "A1", "B1", "D1"]


def test_bounds():
    lookup.check_bounds(None, None)
    lookup.check_bounds("", "a")
    for bounds in ((None, "a"), ("a", None)):
        with pytest.raises(ValueError):
            lookup.check_bounds(*bounds)


KEYS = [0, 2, 3, 4, 5, 8, 12, 25, 27, 30, 45, 50]


@pytest.mark.parametrize("low, high", [(-1, 4), (1, 29), (43, 70), (53, 70), (-12, -2)])
def test_scan_yields_the_whole_range(spark, low, high):
    form = lambda i: f"{i + 100:04d}"
    df = spark.createDataFrame([(form(k), k, s) for k in KEYS for s in (0, 1)], "key string, v int, seq int")
    got = lookup.scan(df, form(low), form(high), ["seq"]).collect()
    assert sorted((r.v, r.seq) for r in got) == [(k, 1) for k in KEYS if low <= k <= high]


def test_scan_pushes_its_bounds_to_the_files(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as string) key", "id v", "id seq").write.parquet(str(tmp_path / "t"))
    plan = lookup.scan(spark.read.parquet(str(tmp_path / "t")), "1", "3", ["seq"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,1)" in plan and "LessThanOrEqual(key,3)" in plan


def test_multi_get_and_lower_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i:03d}", i, s) for i in range(0, 200, 3) for s in (1, 2)], "key string, v int, seq int")
    keys = spark.createDataFrame([("k003",), ("k004",), ("zz",), ("k003",)], "key string")
    for most in (lookup.SEND_ROWS, 1):  # broadcast, and dealt by key
        monkeypatch.setattr(lookup, "SEND_ROWS", most)
        assert sorted((r.key, r.v, r.seq) for r in lookup.multi_get(df, keys, ["seq"]).collect()) == [("k003", 3, 2), ("k004", None, None), ("zz", None, None)]
    probes = [f"k{i:03d}" for i in range(-0, 210, 7)] + ["", "zzz"]
    got = {r.probe: r.key for r in lookup.lower_bounds(df, spark.createDataFrame([(p,) for p in probes], "probe string")).collect()}
    known = sorted({f"k{i:03d}" for i in range(0, 200, 3)})
    assert got == {p: next((k for k in known if k >= p), None) for p in probes}


def test_meta_blocks(spark):
    placed = spark.createDataFrame(pd.DataFrame({"table": [0] * 4, "block": [0, 0, 1, 1], "key": list("abcd"), "size": [34] * 4}))
    got = layout.meta_blocks(placed).orderBy("block").collect()
    assert [(r.first_key, r.last_key, r.records, r.offset) for r in got] == [("a", "b", 2, 0), ("c", "d", 2, 74)]
    found = lookup.find_blocks(layout.meta_blocks(placed), spark.createDataFrame([("b",), ("bb",), ("d",)], "probe string"))
    assert {r.probe: r.block for r in found.collect()} == {"b": 0, "d": 1}


def test_policy_cascades_in_one_pass():
    counts = [1, 1, 1, 1, 1]

    def compact(level):
        counts[level + 1] += counts[level]
        counts[level] = 0

    done = cascade(lambda: counts, Configuration(nb_levels=4, levels_ratio=0.5, max_l0_sstables=1), compact)
    assert counts == [0, 0, 0, 0, 5] and done == [0, 1, 2, 3]
    for ratio, want in ((0.2, [1]), (0.3, [])):
        seen = []
        cascade(lambda: [0, 1, 4], Configuration(nb_levels=2, levels_ratio=ratio), seen.append)
        assert seen == want


def test_replay(spark):
    events = [(1, "flush", None, [], ["s1"]), (2, "flush", None, [], ["s2"]), (3, "compaction", 0, ["s1", "s2"], ["s3"]), (4, "flush", None, [], ["s4"])]
    got = live_tables(spark.createDataFrame(events, EVENTS)).collect()
    assert sorted((r.level, r.path) for r in got) == [(0, "s4"), (1, "s3")]


def test_first_cuts_and_their_outcomes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes, limit = rng.integers(1, 30, rng.integers(1, 60)), int(rng.integers(1, 90))
        upto, cuts, left = folds.outcomes(sizes, limit)
        for carried in range(limit):
            group, open_ = folds.after_full(sizes, limit, carried)
            k = int(np.searchsorted(upto, limit - carried, "left"))
            want = (int(cuts[k]), int(left[k])) if k < len(upto) else (0, carried + int(sizes.sum()))
            assert want == (int(group[-1]) + (open_ == 0), open_)


def test_freeze_by_ranges(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(1, 60)) for i in range(500)], "seq long, size long").repartition(5)
    want = sorted(map(tuple, folds.freeze(df, 200).collect()))
    monkeypatch.setattr(folds, "RANGE_ROWS", 70)
    assert sorted(map(tuple, folds.freeze(df, 200).collect())) == want
    assert sorted(map(tuple, folds.freeze(df, 10_000_000).collect())) == [(i, 0) for i in range(500)]


def test_table_cuts_by_parts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sizes, block, table = rng.integers(1, 50, rng.integers(1, 80)), int(rng.integers(1, 70)), int(rng.integers(1, 300))
        cuts = folds.TableCuts(block, table)
        parts = np.split(sizes, np.sort(rng.integers(0, len(sizes) + 1, 3)))
        assert (np.concatenate([cuts.add(p) for p in parts]) == folds.table_cuts(sizes, block, table)).all()


def test_ranges_meet_probes_by_cells(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    ranges = [(i, *sorted([word(), word()])) for i in range(300)]
    probes = [word() for _ in range(100)] + ["", "zz"]
    a, b = spark.createDataFrame(ranges, "table long, first_key string, last_key string"), spark.createDataFrame([(p,) for p in probes], "probe string")
    want = sorted((p, i) for p in probes for i, x, y in ranges if x <= p <= y)
    for send in (lookup.SEND_ROWS, 10):
        monkeypatch.setattr(lookup, "SEND_ROWS", send)
        assert sorted(map(tuple, lookup.tables_holding(a, b).collect())) == want
