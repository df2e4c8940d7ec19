import pytest
from loam.sources import binary, sst
from loam.store import Store
from loam.streaming.ingest import into_store, live_view


def test_sst_source(spark, tmp_path):
    sst.register(spark)
    rows = spark.range(500).selectExpr("printf('k%04d', id) key", "cast(cast(id as string) as binary) value")
    folder = f"file://{tmp_path}/t"
    written = sst.write(rows, folder, block_size=200, table_bytes=500)
    assert sum(r.records for r in written.collect()) == 500 and len(list((tmp_path / "t").iterdir())) > 3
    df = spark.read.format("sst").load(folder)
    assert sorted(r.key for r in df.collect()) == [f"k{i:04d}" for i in range(500)]
    assert sorted(r.key for r in df.filter("key >= 'k0100' and key <= 'k0103'").collect()) == ["k0100", "k0101", "k0102", "k0103"]
    assert df.filter("key = 'k0200'").count() == 1 and df.filter("key = 'nope'").count() == 0
    path = next((tmp_path / "t").iterdir())
    assert binary.decode_table(path.read_bytes()).metas


def test_empty_sst_folder(spark, tmp_path):
    sst.register(spark)
    (tmp_path / "e").mkdir()
    assert spark.read.format("sst").load(f"file://{tmp_path}/e").count() == 0


def test_stream_is_put_once(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "key string, value binary, seq long"
    spark.range(100).selectExpr("printf('k%02d', id % 10) key", "cast(cast(id as string) as binary) value", "id seq").write.parquet(source)
    store = Store.create(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second time there is nothing new
        into_store(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "ck"), "s", order="seq").awaitTermination()
    want = {f"k{i:02d}": (90 + i) for i in range(10)}
    assert {r.key: int(r.value) for r in store.scan().collect()} == want
    into_store(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "other"), "s", order="seq").awaitTermination()
    assert store.state.streams == {"s": 0}  # same name and batch: not put again
    view = live_view(spark.readStream.schema(schema).parquet(source), "seq")
    query = view.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.key: int(r.value) for r in spark.sql("select * from live").collect()} == want


def test_a_task_that_runs_again_writes_the_same_tables(spark, tmp_path):
    rows = spark.range(300).selectExpr("printf('k%04d', id) key", "cast(cast(id as string) as binary) value")
    folder = f"file://{tmp_path}/t"
    written = sst.write(rows, folder, block_size=200, table_bytes=500)
    first = sorted(r.path for r in written.collect())
    assert sorted(r.path for r in written.collect()) == first == sorted(str(p) for p in (tmp_path / "t").iterdir())
    sst.register(spark)
    assert spark.read.format("sst").load(folder).count() == 300


def test_only_asked_ranges_are_read():
    records = [(f"k{i:04d}", b"v" * 50) for i in range(1000)]
    data, seen = binary.encode_table(records, 1000), []

    def read(start, end):
        seen.append(end - start)
        return data[start:end]

    table = binary.Table(read, len(data))
    assert table.get("k0500") == b"v" * 50 and sum(seen) < len(data) // 5
    seen.clear()
    assert table.get("k0500x") is None and table.get("zzz") is None and [r[0] for r in table.scan("k0100", "k0102")] == ["k0100", "k0101", "k0102"]
    assert sum(seen) < 5000 and table.scan() == records


def test_addresses(tmp_path):
    from loam.sources.address import filesystem

    for form in (f"{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}"):
        assert filesystem(form)[1] == str(tmp_path)


def test_filters_of_the_store_let_few_strangers_through():
    from loam.functions import bloom

    keys = [f"user{i:08d}" for i in range(2000)]
    data = bloom.build(keys, *bloom.parameters(len(keys)))
    assert bloom.may_contain_all(data, keys).all()
    assert bloom.may_contain_all(data, [f"other{i}" for i in range(20_000)]).mean() < 0.003


def test_files_are_made_once_and_must_be_there(tmp_path):
    from loam.config import Configuration
    from loam.sources.files import EventLog, RecordLog, TableFile

    records = [(f"k{i}", f"v{i}".encode()) for i in range(9)]
    makers = {
        TableFile: lambda a: TableFile.create(a, records, 40),
        RecordLog: RecordLog.create,
        EventLog: lambda a: EventLog.create(a, Configuration()),
    }
    for kind, make in makers.items():
        address = f"file://{tmp_path}/deep/{kind.__name__}"
        with pytest.raises(ValueError):
            kind.open(address)
        made = make(address)
        with pytest.raises(ValueError):
            make(address)
        assert made.exists() and kind.open(address) == made != kind(f"{address}2")
    table = TableFile.open(f"file://{tmp_path}/deep/TableFile").table()
    assert table.scan() == records and table.get("k4") == b"v4" and len(table.metas) > 2
    log = RecordLog.open(f"file://{tmp_path}/deep/RecordLog")
    log.append(records[:2])
    log.append([("k0", b"again"), ("é", b"")])
    assert log.records() == [*records[:2], ("k0", b"again"), ("é", b"")]
    log.remove()
    assert not log.exists()
    events = EventLog.open(f"file://{tmp_path}/deep/EventLog")
    events.append({"event_type": "flush", "outputs": ["s1"]})
    events.append({"event_type": "compaction", "level": 0, "inputs": ["s1"], "outputs": ["s2", "s3"]})
    config, found = events.decode()
    assert config == Configuration() and [e["outputs"] for e in found] == [["s1"], ["s2", "s3"]]
    with pytest.raises(ValueError):
        events.append({"event_type": "other"})
