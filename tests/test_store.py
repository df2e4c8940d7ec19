import random

import pytest
from loam.config import Configuration
from loam.sources.log import CommitLog, Conflict, Files
from loam.store import Store

SMALL = Configuration(nb_levels=3, levels_ratio=0.5, max_l0_sstables=3, max_sstable_size=60, block_size=20)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/deep/store"


def batch(spark, rows):
    return spark.createDataFrame([(k, bytearray(v.encode()), i) for i, (k, v) in enumerate(rows)], "key string, value binary, at int").coalesce(1)


def read(store, *bounds):
    return [(r.key, bytes(r.value).decode()) for r in store.scan(*bounds).collect()]


def test_puts_overwrite_and_buffers_freeze(spark, root):
    store = Store.create(spark, root, Configuration(max_sstable_size=30))
    for k, v in [("key1", "value1A"), ("key2", "value2A"), ("key3", "value3"), ("key1", "value1B")]:
        store.put(k, v.encode())
    assert len(store.state.immutable) == 2 and not store.state.active
    assert read(store, "key1", "key3") == [("key1", "value1B"), ("key2", "value2A"), ("key3", "value3")]
    assert store.get("key1") == b"value1B" and store.get("key9") is None
    store.put("empty", b"")
    assert store.get("empty") == b""
    assert read(store, "", "") == [] and read(store, "x", "a") == []
    with pytest.raises(ValueError):
        store.scan("a", None)
    with pytest.raises(ValueError):
        Store.create(spark, root)


def test_reads_do_not_depend_on_layout(spark, root):
    rng = random.Random(7)
    store, model = Store.create(spark, root, SMALL), {}
    steps = [store.freeze, store.flush_next, lambda: store.compact(0), lambda: store.compact(1), lambda: store.compact(3), lambda: store.vacuum(0)]
    for step in range(8):
        rows = [(f"k{rng.randrange(12):02d}", f"v{step}-{i}") for i in range(rng.randrange(1, 6))]
        store.put_all(batch(spark, rows), order="at")
        model |= dict(rows)
        rng.choice(steps)()
        if step % 3 == 2:
            store = Store.open(spark, root)
            steps[:] = [store.freeze, store.flush_next, lambda s=store: s.compact(0), lambda s=store: s.compact(1), lambda s=store: s.compact(3), lambda s=store: s.vacuum(0)]
        assert read(store) == sorted(model.items())
    low, high = "k03", "k08"
    assert read(store, low, high) == sorted((k, v) for k, v in model.items() if low <= k <= high)
    keys = spark.createDataFrame([(k,) for k in ["k00", "nope", *model]], "key string")
    assert {r.key: r.value and bytes(r.value).decode() for r in store.multi_get(keys).collect()} == {"k00": None, "nope": None} | model
    store.close()
    assert not store.state.active and not store.state.immutable and read(store) == sorted(model.items())
    live = read(Store.open(spark, root))
    store.vacuum(0)
    assert read(Store.open(spark, root)) == live


def test_compaction_of_less_than_a_block_keeps_all(spark, root):
    store = Store.create(spark, root, Configuration(nb_levels=2, max_l0_sstables=50))
    for n in range(3):
        store.put_all(batch(spark, [("a", f"{n}"), (f"b{n}", "x")]), order="at")
        store.freeze()
        store.flush_next()
    assert store.counts() == [3, 0, 0]
    store.compact(0)
    assert store.counts() == [0, 1, 0] and read(store) == [("a", "2"), ("b0", "x"), ("b1", "x"), ("b2", "x")]
    store.compact(1)
    store.compact(2)  # the last level is rewritten in place
    assert store.counts() == [0, 0, 1] and store.get("a") == b"2"
    table = store.state.levels[2][0]
    assert (table.first_key, table.last_key, table.records) == ("a", "b2", 4)


def test_large_tables_are_cut_by_key(spark, root):
    store = Store.create(spark, root, Configuration(nb_levels=2, max_l0_sstables=50, max_sstable_size=4000))
    store.put_all(batch(spark, [(f"k{i:04d}", "v" * 50) for i in range(500)]), order="at")
    store.flush_next()
    store.compact(0)
    tables = sorted(store.state.levels[1], key=lambda r: r.first_key)
    assert len(tables) > 4 and all(a.last_key < b.first_key for a, b in zip(tables, tables[1:], strict=False))
    assert len(read(store)) == 500 and store.get("k0250") == b"v" * 50


def test_writers_do_not_lose_each_others_work(spark, root):
    one = Store.create(spark, root)
    two = Store.open(spark, root)
    one.put("a", b"1")
    two.put("b", b"2")
    one.put("a", b"3")
    assert read(two) == read(one) == [("a", b"3".decode()), ("b", "2")]
    one.freeze()
    assert two.flush_next() and not one.flush_next()
    log = CommitLog(Files(spark, root))
    with pytest.raises(Conflict):
        log.append(1, {"event_type": "freeze"})


def test_streams_nulls_and_empty_puts(spark, root):
    store = Store.create(spark, root)
    rows = batch(spark, [("a", "1")])
    assert store.put_all(rows, batch_of=("t", 0)) and not Store.open(spark, root).put_all(rows, batch_of=("t", 0))
    assert not store.put_all(rows.limit(0))
    with pytest.raises(ValueError):
        store.put_all(spark.createDataFrame([("a", None)], "key string, value binary"))
    assert read(store) == [("a", "1")] and not store.flush_next() and store.freeze()


def test_missing_store(spark, root):
    with pytest.raises(ValueError):
        Store.open(spark, root)
    empty = Store.create(spark, root)
    assert empty.get("a") is None and read(empty) == [] and empty.vacuum() == []
    empty.close()


def test_snapshots_bound_an_opening(spark, root, monkeypatch):
    monkeypatch.setattr("loam.store.SNAPSHOT_EVERY", 3)
    store = Store.create(spark, root, SMALL)
    for n in range(4):
        store.put_all(batch(spark, [(f"k{n}", str(n)), ("a", str(n))]), order="at", batch_of=("s", n))
        store.freeze()
    store.flush_next()
    again = Store.open(spark, root)
    assert again.state == store.state and again.log.last_snapshot()[0] > 0 and again.state.streams == {"s": 3}
    assert read(again) == [("a", "3"), ("k0", "0"), ("k1", "1"), ("k2", "2"), ("k3", "3")]


def test_vacuum_spares_what_another_writer_has_not_named_yet(spark, root, monkeypatch):
    one = Store.create(spark, root)
    one.put("a", b"1")
    two = Store.open(spark, root)
    plain = Store._write
    removed = []

    def write(self, rows, name):
        run = plain(self, rows, name)
        removed.append(one.vacuum())  # between the writing of a run and the event that names it
        return run

    monkeypatch.setattr(Store, "_write", write)
    two.put("b", b"2")
    assert removed == [[]] and read(Store.open(spark, root)) == [("a", "1"), ("b", "2")]
    monkeypatch.setattr(Store, "_write", lambda self, rows, name: (plain(self, rows, name), one.vacuum(0))[0])
    with pytest.raises(RuntimeError):  # without a grace the run is gone, and no event names it
        two.put("c", b"3")
    assert read(Store.open(spark, root)) == [("a", "1"), ("b", "2")] and Store.open(spark, root).get("c") is None
    assert one.vacuum() == [] and one.vacuum(0) == []


def test_lookups_of_many_keys_read_runs_by_range(spark, root, monkeypatch):
    store = Store.create(spark, root, Configuration(max_l0_sstables=50))
    for n in range(3):
        store.put_all(batch(spark, [(f"{'abc'[n]}{i}", f"{n}{i}") for i in range(20)]), order="at")
    seen = []
    plain = Store._rows
    monkeypatch.setattr(Store, "_rows", lambda self, runs: seen.append(len(runs)) or plain(self, runs))
    keys = spark.createDataFrame([("a3",), ("a99",), ("c1",), (None,)], "key string")
    want = {"a3": b"03", "a99": None, "c1": b"21", None: None}
    assert {r.key: r.value and bytes(r.value) for r in store.multi_get(keys).collect()} == want and seen == [2]
    monkeypatch.setattr("loam.store.PRUNE_KEYS", 2)
    assert {r.key: r.value and bytes(r.value) for r in store.multi_get(keys).collect()} == want and seen == [2, 3]
    assert store.multi_get(keys.limit(0)).count() == 0
