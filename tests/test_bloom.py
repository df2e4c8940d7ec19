import pytest
from loam.functions import bloom
from pyspark.sql import functions as F


def test_bits():
    keys = ["key1", "key2", "key3"]
    assert bloom.build(keys, 1, 2) == b"3\x02" and bloom.build(keys, 3, 2) == b"\x003\x10\x02"
    assert bloom.build(keys, *bloom.parameters(3, 0.0001))[-1] == bloom.parameters(3, 0.0001)[1]


def test_membership_has_no_false_negatives():
    keys = [f"k{i}" for i in range(2000)]
    data = bloom.build(keys, *bloom.parameters(2000))
    assert all(bloom.may_contain(data, k) for k in keys)
    assert sum(bloom.may_contain(data, f"x{i}") for i in range(5000)) < 25


def test_no_keys():
    with pytest.raises(ValueError):
        bloom.parameters(0)


def test_columns(spark):
    df = spark.range(1, 3000, 7).select("id", *(c.alias(n) for c, n in zip(bloom.parameter_columns(F.col("id")), ("size", "hashes"), strict=True)))
    assert all((r.size, r.hashes) == bloom.parameters(r.id) for r in df.collect())
    rows = spark.createDataFrame([("a", f"k{i}") for i in range(50)] + [("b", "z")], "t string, key string")
    made = bloom.filters(rows, "t")
    asked = rows.join(made, "t").select(bloom.might_contain("bloom", "key").alias("m"))
    assert all(r.m for r in asked.collect()) and {(r.t, r["keys"]) for r in made.collect()} == {("a", 50), ("b", 1)}
