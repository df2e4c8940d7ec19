import zlib
from collections import Counter

import pytest
from loam.llm import sharding
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, source string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit(1), "src": F.lit(2), "r": F.lit(3), "size": F.lit("x"), "cell": F.lit(0)})


def check(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("n", [1, 39, 40, 1000])
def test_laws(spark, n):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None) for i in range(n)]
    check(sharding.interleave(make(spark, rows)).collect(), rows, 40)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "x", "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c") for i in range(4000)]
    got = sharding.interleave(make(spark, rows), shards=20).collect()
    source = {i: s for i, _, s in rows}
    for s in range(20):
        mix = Counter(source[r.doc_id] for r in got if r.shard == s)
        assert abs(mix["a"] - 120) <= 2 and abs(mix["b"] - 60) <= 2 and abs(mix["c"] - 20) <= 2


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "x", "s")] * 50 + [(None, None, None)] * 30 + [(2, "x", ""), (2, "y", "")] + [(3, "long " * 100_000, "s")]
    check(sharding.interleave(make(spark, rows), shards=7).collect(), rows, 7)
    assert sharding.interleave(make(spark, []), shards=7).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(make(spark, rows), shards=0)


def test_runs_again_alike(spark):
    df = make(spark, [(i, str(i), f"s{i % 3}") for i in range(500)])
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df.repartition(7)).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, seed=8).collect()}
    assert one == two != other


def test_small_sources_share_one_rank_but_no_range(spark, monkeypatch):
    """Every row a source of its own: all have the fractional rank 1/2, and digests split them."""
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    out = sharding.interleave(df)
    check(out.collect(), [(i, "x", None) for i in range(n)], 40)
    digest = F.md5(F.concat(F.lit("7:="), F.col("doc_id").cast("string"), F.lit(":"), F.col("text_crc32").cast("string")).cast("binary"))
    parts = out.groupBy(F.substring(digest, 4, 3).alias("part")).agg(F.count("*").alias("n"), F.min(F.col("shard") * n + F.col("slot")).alias("a"), F.max(F.col("shard") * n + F.col("slot")).alias("b")).orderBy("part").collect()
    assert len(parts) > 4000 and max(r.n for r in parts) < 40  # what one window sorts
    assert all(p.b < q.a for p, q in zip(parts[:-1], parts[1:], strict=True))


def test_null_ids_are_shuffled(spark):
    rows = [(None, f"text {i}", "s") for i in range(2000)]
    got = sorted(sharding.interleave(make(spark, rows)).collect(), key=lambda r: (r.shard, r.slot))
    crcs = [r.text_crc32 for r in got]
    rises = sum(a < b for a, b in zip(crcs[:-1], crcs[1:], strict=True))
    check(got, rows, 40)
    assert 900 < rises < 1100


def test_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(None, None, "s")] * 200 + [(5, "t", "u")] * 33 + [(i, "x", "s") for i in range(10)]
    check(sharding.interleave(make(spark, rows), shards=6).collect(), rows, 6)
