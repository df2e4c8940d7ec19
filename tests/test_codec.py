import pytest
from hypothesis import given
from hypothesis import strategies as st
from loam.config import Configuration
from loam.functions import codec
from loam.operators import folds
from loam.sources import binary
from pyspark.sql import functions as F


def test_record_bytes():
    assert codec.encode_record("key1", b"value1") == b"\x04\x00\x00\x00key1\x06\x00\x00\x00value1"
    assert codec.encode_record("ü", b"") == b"\x02\x00\x00\x00\xc3\xbc\x00\x00\x00\x00"


@given(st.lists(st.tuples(st.text(), st.binary())))
def test_lists_round_trip(records):
    assert list(codec.decode_records(b"".join(codec.encode_record(*r) for r in records))) == records


def test_torn_records_raise():
    whole = codec.encode_record("key1", b"value1")
    for n in range(1, len(whole)):
        with pytest.raises(ValueError):
            list(codec.decode_records(whole[:n]))


def test_columns_equal_the_plain_codec(spark):
    rows = [("key1", bytearray(b"value1")), ("", bytearray()), ("ключ\U0001f600", bytearray(bytes(range(256)) * 3))]
    df = spark.createDataFrame(rows, "key string, value binary")
    got = df.select("key", "value", codec.encode().alias("data"), codec.record_size().alias("size"), codec.record().alias("r"))
    got = got.withColumn("back", codec.decode("data")).collect()
    for r in got:
        assert bytes(r.data) == codec.encode_record(r.key, bytes(r.value)) and r.size == len(r.data)
        assert r.back.key == r.key and r.back.value == r.value and r.r.key == r.key
    data = df.select(F.lit(b"".join(codec.encode_record(k, bytes(v)) for k, v in rows)).alias("d")).limit(1)
    listed = sorted(codec.decode_lists(data, "d").collect(), key=lambda r: r.position)
    assert [(r.key, bytes(r.value)) for r in listed] == [(k, bytes(v)) for k, v in rows]


def test_block_bytes():
    one, two = codec.encode_record("key1", b"value1"), codec.encode_record("key2", b"value2")
    data = binary.encode_block([one, two])
    assert data == one + two + b"\x00\x00\x12\x00\x02\x00" and len(data) == folds.block_bytes(36, 2)
    assert binary.decode_block(data) == [("key1", b"value1"), ("key2", b"value2")]
    with pytest.raises(ValueError):
        binary.decode_block(b"\x09\x00")


def test_index_entry_bytes():
    entry = binary.MetaBlock("first_key", "last_key", 100)
    assert entry.encode() == b"\x09\x00first_key\x08\x00last_key\x64\x00\x00\x00"
    assert binary.decode_metas(entry.encode() * 2) == [entry, entry]


def test_table_bytes():
    records = [(f"key{i}", f"value{i}".encode()) for i in (1, 2, 3)]
    data = binary.encode_table(records, block_size=40, rate=0.0001)
    index = b"\x04\x00key1\x04\x00key2\x00\x00\x00\x00\x04\x00key3\x04\x00key3\x2a\x00\x00\x00"
    assert data[64:96] == index and data[-8:] == b"\x40\x00\x00\x00\x60\x00\x00\x00"
    table = binary.decode_table(data)
    assert table.scan() == records and [table.get(k) for k in ("key1", "key3", "key4")] == [b"value1", b"value3", None]
    with pytest.raises(ValueError):
        binary.decode_table(b"\xff" * 20)


def test_four_block_table():
    keys = [c * 3 for c in "abcdefghijklmnop"]
    table = binary.decode_table(binary.encode_table([(k, f"some_long_value_for_{k}".encode()) for k in keys], 150))
    assert [(m.first_key, m.last_key) for m in table.metas] == [("aaa", "ddd"), ("eee", "hhh"), ("iii", "lll"), ("mmm", "ppp")]
    assert [m.offset for m in table.metas] == [0, 146, 292, 438]
    want = {"ddd": 0, "eee": 1, "jj": 2, "ooo": 3, "iiii": 2, "a": None, "zzz": None}
    assert {k: table.find_block(k) for k in want} == want
    for low, high in (("cc", "eee"), ("a", "ccc"), ("a", "aa"), ("dd", "zzzz"), ("ww", "zzzz"), ("", "")):
        assert [k for k, _ in table.scan(low, high)] == [k for k in keys if low <= k <= high]
    assert [k for k, _ in table.scan(None, "bbb")] == ["aaa", "bbb"]


def test_event_log_bytes():
    config = Configuration(10, 0.1, 10, 1000, 100)
    header = binary.encode_header(config)
    assert len(header) == 24
    events = [
        {"event_type": "flush", "level": None, "inputs": [], "outputs": ["s1"]},
        {"event_type": "compaction", "level": 2, "inputs": ["s1", "ü2"], "outputs": ["s3"]},
    ]
    data = header + b"".join(map(binary.encode_event, events))
    assert data[24:] == b"\x00\x03\x02s1" + b"\x01\x02\x07\x00\x03\x00" + b"\x02s1\x03\xc3\xbc2" + b"\x02s3"
    assert binary.decode_manifest(data) == (config, events)
    with pytest.raises(ValueError):
        binary.encode_event({"event_type": "other"})
    with pytest.raises(ValueError):
        binary.decode_events(b"\x07")
