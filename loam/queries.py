"""Query catalogue over the driver's tables, each with the same query in DuckDB's SQL where SQL can say it.

``events`` is read as a changelog with many overwrites (key: user, order: event id), ``orders`` as records of unique keys.
"""

from __future__ import annotations

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.config import Configuration
from loam.functions import bloom, codec
from loam.operators import folds, layout, lookup
from loam.operators.merge import concat_runs as concat
from loam.operators.merge import merge_runs, newest_wins, numbered
from loam.operators.stage import scratch
from loam.plans.replay import EVENTS, live_tables
from loam.sources import binary, sst
from loam.sources.address import filesystem
from loam.sources.log import Files
from loam.store import Store
from loam.streaming.ingest import into_store

#: Sizes of the parity folds over the small tables.
BUFFER_BYTES, BLOCK_BYTES, TABLE_BYTES = 16_384, 1_024, 4_096
LOWER, UPPER = "user00000010", "user00000060"
POINT = "user00000007"

KV_EVENTS = "SELECT printf('user%08d', user_id) AS key, encode(event_type || '|' || props) AS value, event_id AS seq FROM events"
KV_ORDERS = "SELECT printf('%012d', o_orderkey) AS key, encode(o_orderstatus || '|' || o_orderpriority) AS value, o_orderkey AS seq FROM orders"
SIZE = "(strlen(key) + octet_length(value) + 8)::BIGINT"


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("|", "event_type", "props").cast("binary")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.format_string("user%08d", "user_id").alias("key"), value.alias("value"), F.col("event_id").alias("seq"))


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("|", "o_orderstatus", "o_orderpriority").cast("binary")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.format_string("%012d", "o_orderkey").alias("key"), value.alias("value"), F.col("o_orderkey").alias("seq"))


def _hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.hex("value"))


def _probes(spark: SparkSession, form: str, step: int, count: int = 60, tail: str = "") -> DataFrame:
    return spark.range(count).select(F.concat(F.format_string(form, F.col("id") * step), F.lit(tail)).alias("probe"))


# Codec


def record_size(spark, sf_dir):
    return kv_events(spark, sf_dir).select("seq", codec.record_size().alias("size"))


def record_encode(spark, sf_dir):
    return kv_orders(spark, sf_dir).select("key", F.hex(codec.encode()).alias("encoded"))


def record_roundtrip(spark, sf_dir):
    coded = kv_orders(spark, sf_dir).select(codec.encode().alias("data"))
    return _hexed(coded.select(codec.decode("data").alias("r")).select("r.*"))


def record_list_decode(spark, sf_dir):
    """Byte strings of a hundred records each, taken apart."""
    orders = kv_orders(spark, sf_dir)
    packed = orders.groupBy(F.floor(F.col("seq") / 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("seq", codec.encode().alias("d")))).alias("r"))
    joined = packed.select(F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["d"])), "")).alias("data"))
    return _hexed(codec.decode_lists(joined, "data").select("key", "value", "position"))


# Reads


def point_get(spark, sf_dir):
    return _hexed(lookup.get(kv_events(spark, sf_dir), POINT, ["seq"])).select("key", "value", "seq")


def multi_get(spark, sf_dir):
    keys = _probes(spark, "user%08d", 3).withColumnRenamed("probe", "key")
    return _hexed(lookup.multi_get(kv_events(spark, sf_dir), keys, ["seq"])).select("key", "value")


def range_scan(spark, sf_dir):
    return _hexed(lookup.scan(kv_events(spark, sf_dir), LOWER, UPPER, ["seq"])).select("key", "value").orderBy("key")


def full_scan(spark, sf_dir):
    return _hexed(lookup.scan(kv_events(spark, sf_dir), None, None, ["seq"])).select("key", "value").orderBy("key")


def lower_bound(spark, sf_dir):
    return lookup.lower_bounds(kv_events(spark, sf_dir), _probes(spark, "user%08d", 7, tail="x"))


# Merges


def _runs(spark, sf_dir):
    rows = kv_events(spark, sf_dir)
    return [rows.filter(F.col("seq") % 3 == i) for i in range(3)]


def merge_newest_wins(spark, sf_dir):
    return _hexed(merge_runs(_runs(spark, sf_dir), order="seq")).select("key", "value", F.col("precedence").cast("long"))


def merge_with_duplicates(spark, sf_dir):
    return _hexed(numbered(_runs(spark, sf_dir))).select("key", "value", "seq", F.col("precedence").cast("long")).orderBy("key", "precedence", "seq")


def concat_runs(spark, sf_dir):
    return _hexed(concat(_runs(spark, sf_dir), "seq")).select("key", "value", "seq", F.col("table_pos").cast("long"))


# Layout


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("size", codec.record_size())


def _batched(spark, sf_dir):
    rows = _sized(kv_events(spark, sf_dir))
    return rows.join(folds.freeze(rows, BUFFER_BYTES), "seq")


def memtable_freeze(spark, sf_dir):
    return folds.freeze(_sized(kv_events(spark, sf_dir)), BUFFER_BYTES)


def _snapshot(spark, sf_dir):
    return _batched(spark, sf_dir).groupBy("batch", "key").agg(F.max_by(F.struct("value", "size"), "seq").alias("v")).select("batch", "key", "v.*")


def memtable_snapshot(spark, sf_dir):
    return _hexed(_snapshot(spark, sf_dir)).select("batch", "key", "value")


def approximate_vs_exact_size(spark, sf_dir):
    """A buffer's counted size, overwrites included, and that of the newest values."""
    rows = _batched(spark, sf_dir)
    newest = rows.groupBy("batch", "key").agg(F.max_by("size", "seq").alias("last"), F.sum("size").alias("every"))
    return newest.groupBy("batch").agg(F.sum("every").cast("long").alias("approximate_size"), F.sum("last").cast("long").alias("exact_size"))


def _placed(spark, sf_dir):
    return folds.blocks(_snapshot(spark, sf_dir).withColumnRenamed("batch", "table"), BLOCK_BYTES)


def block_pack(spark, sf_dir):
    return _placed(spark, sf_dir).select("table", "key", "block")


def meta_blocks(spark, sf_dir):
    return layout.meta_blocks(_placed(spark, sf_dir)).withColumn("records", F.col("records").cast("long"))


def find_block(spark, sf_dir):
    """For each probe the block that may hold it, in every table that has one."""
    return lookup.find_blocks(layout.meta_blocks(_placed(spark, sf_dir)), _probes(spark, "user%08d", 2, 80))


def _summaries(spark, sf_dir):
    return layout.table_summary(_snapshot(spark, sf_dir).withColumnRenamed("batch", "table"))


def sstable_summary(spark, sf_dir):
    return _summaries(spark, sf_dir)


def table_range_prune(spark, sf_dir):
    return lookup.tables_holding(_summaries(spark, sf_dir), _probes(spark, "user%08d", 9, 18))


def bloom_parameters(spark, sf_dir):
    size, hashes = bloom.parameter_columns(F.col("records"))
    return _summaries(spark, sf_dir).select("table", "records", size.alias("nb_bytes"), hashes.alias("nb_hashes"))


def bloom_membership(spark, sf_dir):
    """For each table: keys of the store in its range, how many it holds, and how many of those its filter does not let through."""
    rows = _snapshot(spark, sf_dir).select(F.col("batch").alias("table"), "key")
    probes = rows.select(F.col("key").alias("probe")).distinct()
    held = rows.select("table", F.col("key").alias("probe"), F.lit(True).alias("held"))
    asked = lookup.tables_holding(_summaries(spark, sf_dir), probes).join(bloom.filters(rows, "table"), "table")
    asked = asked.withColumn("maybe", bloom.might_contain("bloom", "probe")).join(held, ["table", "probe"], "left")
    return asked.groupBy("table").agg(
        F.count("*").alias("asked"), F.count("held").alias("held"), F.count_if(F.col("held") & ~F.col("maybe")).alias("missed")
    )


def get_serving_tier(spark, sf_dir):
    rows = numbered(_runs(spark, sf_dir), "tier")
    return lookup.serving_tiers(rows.withColumn("tier", F.col("tier").cast("long")))


# Compaction and recovery


def compact_l0(spark, sf_dir):
    """Newest values of all flushed batches, cut into tables."""
    merged = newest_wins(_snapshot(spark, sf_dir), ["batch"])
    return folds.tables(merged, BLOCK_BYTES, TABLE_BYTES).select("key", "table")


#: Flushes of the store whose levels are counted, and its tuning: compactions from level 0 and, in turn, from those below.
FLUSHES, LEVELS, RATIO, MOST_L0 = 7, 3, 1.0, 2


def compact_levels(spark, sf_dir):
    """Tables by level of a store after each of its flushes, as the policy compacts them."""
    store = Store.create(spark, scratch(spark, "store"), Configuration(nb_levels=LEVELS, levels_ratio=RATIO, max_l0_sstables=MOST_L0))
    rows, out = kv_events(spark, sf_dir), []
    for step in range(FLUSHES):
        store.put_all(rows.filter(F.col("seq") % FLUSHES == step), order="seq")
        store.freeze()
        store.flush_next()
        out += [(step, level, n) for level, n in enumerate(store.counts())]
    return spark.createDataFrame(out, "step long, level long, tables long")


LOG = [(1, "flush", None, [], ["s1"]), (2, "flush", None, [], ["s2"]), (3, "compaction", 0, ["s1", "s2"], ["s3", "s5"]), (4, "flush", None, [], ["s4"]), (5, "compaction", 1, ["s3"], ["s6"])]


def manifest_replay(spark, sf_dir):
    live = live_tables(spark.createDataFrame(LOG, EVENTS))
    return live.select(F.col("level").cast("long"), "path", F.row_number().over(_by_level()).cast("long").alias("place"))


def event_log_roundtrip(spark, sf_dir):
    """A log of events in the byte format, one event for each order, written by one task and read back."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("n")).repartition(1).sortWithinPartitions("n")

    def event(n: int) -> dict:
        if n % 3:
            return {"event_type": "flush", "level": None, "inputs": [], "outputs": [f"t{n}"]}
        return {"event_type": "compaction", "level": n % 5, "inputs": [f"t{n - 1}", f"t{n - 2}"], "outputs": [f"c{n}"] if n % 2 else []}

    def run(batches):
        for pdf in batches:
            log = binary.encode_header(Configuration()) + b"".join(binary.encode_event(event(n)) for n in pdf["n"].tolist())
            _, events = binary.decode_manifest(log)
            yield pd.DataFrame({"event": pdf["n"], "kind": [e["event_type"] for e in events], "level": pd.array([e["level"] for e in events], "Int64"), "inputs": [",".join(e["inputs"]) for e in events], "outputs": [",".join(e["outputs"]) for e in events]})

    return orders.mapInPandas(run, "event long, kind string, level long, inputs string, outputs string")


def _by_level():
    from pyspark.sql import Window

    return Window.partitionBy("level").orderBy(F.desc("event_seq"), "position")


def wal_replay(spark, sf_dir):
    """The log of unflushed puts, read back in order; later ones overwrite."""
    path = scratch(spark, "wal")
    kv_events(spark, sf_dir).write.parquet(path)
    log = spark.read.parquet(path)
    return _hexed(newest_wins(log, ["seq"], keep=["value"])).select("key", "value")


def _filled(spark, sf_dir, config=None) -> Store:
    """A store that has been put to in three batches, flushed and compacted."""
    store = Store.create(spark, scratch(spark, "store"), config or Configuration(nb_levels=3, max_l0_sstables=2, max_sstable_size=100_000))
    rows = kv_events(spark, sf_dir)
    for part in range(3):
        store.put_all(rows.filter(F.col("seq") % 3 == part) if part else rows.filter("seq % 3 = 0"), order="seq")
        store.freeze()
        store.flush_next()
    return store


def scan_after_compaction(spark, sf_dir):
    """Reading a compacted store: batches are the runs of merge_newest_wins, the last the newest."""
    return _hexed(_filled(spark, sf_dir).scan())


def store_reopen(spark, sf_dir):
    """A store that is left with unflushed puts, opened again."""
    store = _filled(spark, sf_dir)
    store.put_all(kv_events(spark, sf_dir).filter("seq % 50 = 0").withColumn("value", F.col("key").cast("binary")), order="seq")
    return _hexed(Store.open(spark, store.files.root).scan())


def store_multi_get(spark, sf_dir):
    keys = _probes(spark, "user%08d", 3).withColumnRenamed("probe", "key")
    return _hexed(_filled(spark, sf_dir).multi_get(keys))


def sst_roundtrip(spark, sf_dir):
    """Unique records written as byte-format tables and read back through the data source."""
    folder = _files(spark, kv_orders(spark, sf_dir))
    return _hexed(spark.read.format("sst").load(folder).filter(F.col("key") >= "000000000100"))


def _files(spark, rows: DataFrame) -> str:
    """A folder of byte-format tables of the rows."""
    sst.register(spark)
    folder = scratch(spark, "sst")
    Files(spark, folder).make()
    sst.write(rows, folder, BLOCK_BYTES).count()
    return folder


def sst_get(spark, sf_dir):
    """Single keys of byte-format tables, by filter, index and one block each: every tenth that is there and some that are not."""
    folder = _files(spark, kv_orders(spark, sf_dir))
    fs, path = filesystem(folder)
    names = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".sst")]
    probes = _probes(spark, "%012d", 10, 2000)

    def run(batches):
        fs, _ = filesystem(folder)
        files = [fs.open_input_file(n) for n in names]
        tables = [binary.Table(lambda start, end, f=f: f.read_at(end - start, start), f.size()) for f in files]
        for pdf in batches:
            found = [next((v for v in (t.get(k) for t in tables) if v is not None), None) for k in pdf["probe"]]
            yield pd.DataFrame({"key": pdf["probe"], "value": found})

    return _hexed(probes.mapInPandas(run, "key string, value binary"))


def store_close(spark, sf_dir):
    """What the tables of a closed store hold: nothing is left in its log."""
    store = _filled(spark, sf_dir)
    store.put_all(kv_events(spark, sf_dir).filter("seq % 50 = 0").withColumn("value", F.col("key").cast("binary")), order="seq")
    store.close()
    runs = [r for level in Store.open(spark, store.files.root).state.levels for r in level]
    return _hexed(lookup.scan(store._rows(runs), None, None, ["batch", "pos"])).select("key", "value")


def store_from_files(spark, sf_dir):
    """A store made from byte-format tables and the event log that names them: the runs of merge_newest_wins, the last flushed the newest."""
    kv = kv_events(spark, sf_dir)
    folder, parts, events = _files(spark, kv.limit(0)), [], []
    for part in range(3):
        rows = newest_wins(kv.filter(F.col("seq") % 3 == part), ["seq"], keep=["value"])
        parts.append([r["path"] for r in sst.write(rows, folder, BLOCK_BYTES).collect()])
        if part == 2:  # both earlier flushes have gone down a level as they are
            events.append({"event_type": "compaction", "level": 0, "inputs": [*parts[0], *parts[1]], "outputs": [*parts[1], *parts[0]]})
        events += [{"event_type": "flush", "outputs": [p]} for p in parts[-1]]
    log = binary.encode_header(Configuration(nb_levels=3)) + b"".join(binary.encode_event(e) for e in events)
    fs, path = filesystem(f"{folder}/manifest")
    with fs.open_output_stream(path) as f:
        f.write(log)
    return _hexed(Store.from_files(spark, scratch(spark, "store"), f"{folder}/manifest").scan())


def streaming_upsert(spark, sf_dir):
    """The changelog as a stream, put into a store batch by batch and read."""
    source = scratch(spark, "stream")
    kv_events(spark, sf_dir).repartition(1).write.parquet(source)
    store = Store.create(spark, scratch(spark, "store"))
    stream = spark.readStream.schema("key string, value binary, seq long").parquet(source)
    query = into_store(stream, store, scratch(spark, "offsets"), "events", order="seq")
    query.awaitTermination()
    return _hexed(store.scan())


_NEWEST = "SELECT key, hex(arg_max(value, seq)) AS value FROM kv GROUP BY key"
_RUNS = f"kv AS ({KV_EVENTS}), runs AS (SELECT *, seq % 3 AS precedence FROM kv)"
_FOLD = f"""kv AS ({KV_EVENTS}), sized AS (SELECT *, {SIZE} AS size, row_number() OVER (ORDER BY seq) AS i FROM kv),
fold AS (SELECT i, seq, 0::BIGINT AS batch, size AS running FROM sized WHERE i = 1
  UNION ALL SELECT s.i, s.seq, f.batch + (f.running >= {BUFFER_BYTES})::BIGINT, CASE WHEN f.running >= {BUFFER_BYTES} THEN s.size ELSE f.running + s.size END
  FROM fold f JOIN sized s ON s.i = f.i + 1),
batched AS (SELECT s.*, f.batch FROM sized s JOIN fold f USING (i)),
snapshot AS (SELECT batch, key, arg_max(value, seq) AS value, arg_max(size, seq) AS size FROM batched GROUP BY batch, key)"""
_BLOCKS = f"""{_FOLD},
ordered AS (SELECT batch, key, size, row_number() OVER (PARTITION BY batch ORDER BY key) AS k FROM snapshot),
packed AS (SELECT batch, key, size, k, 0::BIGINT AS block, size AS filled FROM ordered WHERE k = 1
  UNION ALL SELECT o.batch, o.key, o.size, o.k, p.block + (p.filled + o.size > {BLOCK_BYTES})::BIGINT,
    CASE WHEN p.filled + o.size > {BLOCK_BYTES} THEN o.size ELSE p.filled + o.size END
  FROM packed p JOIN ordered o ON o.batch = p.batch AND o.k = p.k + 1),
metas AS (SELECT batch AS "table", block, min(key) AS first_key, max(key) AS last_key, count(*) AS records, sum(size)::BIGINT + 2 * count(*) + 2 AS bytes FROM packed GROUP BY batch, block)"""
_SUMMARY = f"""{_FOLD}, summary AS (SELECT batch AS "table", min(key) AS first_key, max(key) AS last_key, count(*) AS records, sum(size)::BIGINT AS bytes FROM snapshot GROUP BY batch)"""


def _numbers(form: str, step: int, count: int = 60, tail: str = "") -> str:
    return f"probes AS (SELECT printf('{form}', i * {step}) || '{tail}' AS probe FROM range({count}) t(i))"


ORACLES = {
    "record_size": f"WITH kv AS ({KV_EVENTS}) SELECT seq, {SIZE} AS size FROM kv",
    "record_encode": f"""WITH kv AS ({KV_ORDERS}) SELECT key,
      printf('%02X000000', strlen(key)) || hex(encode(key)) || printf('%02X000000', octet_length(value)) || hex(value) AS encoded FROM kv""",
    "record_roundtrip": f"WITH kv AS ({KV_ORDERS}) SELECT key, hex(value) AS value FROM kv",
    "record_list_decode": f"WITH kv AS ({KV_ORDERS}) SELECT key, hex(value) AS value, row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) - 1 AS position FROM kv",
    "point_get": f"WITH kv AS ({KV_EVENTS}) SELECT key, hex(value) AS value, seq FROM kv WHERE key = '{POINT}' ORDER BY seq DESC LIMIT 1",
    "multi_get": f"WITH kv AS ({KV_EVENTS}), {_numbers('user%08d', 3)}, newest AS ({_NEWEST}) SELECT probe AS key, value FROM probes LEFT JOIN newest ON key = probe",
    "range_scan": f"WITH kv AS ({KV_EVENTS}) SELECT key, hex(arg_max(value, seq)) AS value FROM kv WHERE key BETWEEN '{LOWER}' AND '{UPPER}' GROUP BY key",
    "full_scan": f"WITH kv AS ({KV_EVENTS}) {_NEWEST}",
    "lower_bound": f"WITH kv AS ({KV_EVENTS}), {_numbers('user%08d', 7, tail='x')} SELECT probe, min(key) AS key FROM probes LEFT JOIN kv ON key >= probe GROUP BY probe",
    "merge_newest_wins": f"""WITH {_RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY precedence, seq DESC) AS n FROM runs)
      SELECT key, hex(value) AS value, precedence FROM ranked WHERE n = 1""",
    "merge_with_duplicates": f"WITH {_RUNS} SELECT key, hex(value) AS value, seq, precedence FROM runs",
    "concat_runs": f"WITH {_RUNS} SELECT key, hex(value) AS value, seq, precedence AS table_pos FROM runs",
    "memtable_freeze": f"WITH RECURSIVE {_FOLD} SELECT seq, batch FROM fold",
    "memtable_snapshot": f"WITH RECURSIVE {_FOLD} SELECT batch, key, hex(value) AS value FROM snapshot",
    "approximate_vs_exact_size": f"""WITH RECURSIVE {_FOLD} SELECT batch, a.n AS approximate_size, sum(s.size)::BIGINT AS exact_size
      FROM (SELECT batch, sum(size)::BIGINT AS n FROM batched GROUP BY batch) a JOIN snapshot s USING (batch) GROUP BY batch, a.n""",
    "block_pack": f'WITH RECURSIVE {_BLOCKS} SELECT batch AS "table", key, block FROM packed',
    "meta_blocks": f"""WITH RECURSIVE {_BLOCKS} SELECT "table", block, first_key, last_key, records,
      coalesce(sum(bytes) OVER (PARTITION BY "table" ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM metas""",
    "find_block": f"""WITH RECURSIVE {_BLOCKS}, {_numbers('user%08d', 2, 80)} SELECT "table", probe, min(block) AS block
      FROM probes JOIN metas ON probe BETWEEN first_key AND last_key GROUP BY "table", probe""",
    "sstable_summary": f"WITH RECURSIVE {_SUMMARY} SELECT * FROM summary",
    "table_range_prune": f'WITH RECURSIVE {_SUMMARY}, {_numbers("user%08d", 9, 18)} SELECT probe, "table" FROM probes JOIN summary ON probe BETWEEN first_key AND last_key',
    "bloom_parameters": f"""WITH RECURSIVE {_SUMMARY}, bits AS (SELECT "table", records, -records * ln({bloom.RATE}) / (ln(2.0) * ln(2.0)) AS m FROM summary)
      SELECT "table", records, ceil(m / 8)::BIGINT AS nb_bytes, round_even(m / records * ln(2.0), 0)::BIGINT AS nb_hashes FROM bits""",
    "bloom_membership": f"""WITH RECURSIVE {_SUMMARY}, probes AS (SELECT DISTINCT key AS probe FROM snapshot)
      SELECT "table", count(*) AS asked, count(h.key) AS held, 0::BIGINT AS missed FROM summary JOIN probes ON probe BETWEEN first_key AND last_key
      LEFT JOIN snapshot h ON h.batch = "table" AND h.key = probe GROUP BY "table" """,
    "get_serving_tier": f"WITH {_RUNS} SELECT key, min(precedence) AS tier FROM runs GROUP BY key",
    "compact_l0": f"""WITH RECURSIVE {_FOLD},
      merged AS (SELECT key, arg_max(size, batch) AS size, row_number() OVER (ORDER BY key) AS k FROM snapshot GROUP BY key),
      cut AS (SELECT k, key, 0::BIGINT AS "table", size AS filled, 1::BIGINT AS n, 0::BIGINT AS done FROM merged WHERE k = 1
        UNION ALL SELECT m.k, m.key, c."table" + (c.done >= {TABLE_BYTES})::BIGINT,
          CASE WHEN c.done >= {TABLE_BYTES} OR c.filled + m.size > {BLOCK_BYTES} THEN m.size ELSE c.filled + m.size END,
          CASE WHEN c.done >= {TABLE_BYTES} OR c.filled + m.size > {BLOCK_BYTES} THEN 1 ELSE c.n + 1 END,
          CASE WHEN c.done >= {TABLE_BYTES} THEN 0 WHEN c.filled + m.size > {BLOCK_BYTES} THEN c.done + c.filled + 2 * c.n + 2 ELSE c.done END
        FROM cut c JOIN merged m ON m.k = c.k + 1)
      SELECT key, "table" FROM cut""",
    # A flush adds a table to level 0; a compaction leaves one (all tables are small), on top of those of the next level.
    "compact_levels": f"""WITH RECURSIVE pass AS (
        SELECT -1::BIGINT AS step, 0::BIGINT AS l0, 0::BIGINT AS l1, 0::BIGINT AS l2, 0::BIGINT AS l3
        UNION ALL
        SELECT step, l0, l1, CASE WHEN m2 THEN 0 ELSE l2 END, CASE WHEN m2 THEN l3 + 1 ELSE l3 END FROM (
          SELECT *, l2 > 0 AND l2 >= {RATIO} * l3 AS m2 FROM (
            SELECT step, l0, CASE WHEN m1 THEN 0 ELSE l1 END AS l1, CASE WHEN m1 THEN l2 + 1 ELSE l2 END AS l2, l3 FROM (
              SELECT *, l1 > 0 AND l1 >= {RATIO} * l2 AS m1 FROM (
                SELECT step + 1 AS step, CASE WHEN l0 + 1 >= {MOST_L0} THEN 0 ELSE l0 + 1 END AS l0,
                  CASE WHEN l0 + 1 >= {MOST_L0} THEN l1 + 1 ELSE l1 END AS l1, l2, l3 FROM pass WHERE step + 1 < {FLUSHES}))))
        )
      SELECT step, unnest([0, 1, 2, 3])::BIGINT AS level, unnest([l0, l1, l2, l3])::BIGINT AS tables FROM pass WHERE step >= 0""",
    "event_log_roundtrip": """SELECT o_orderkey AS event, CASE WHEN o_orderkey % 3 <> 0 THEN 'flush' ELSE 'compaction' END AS kind,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS level,
      CASE WHEN o_orderkey % 3 = 0 THEN 't' || (o_orderkey - 1) || ',t' || (o_orderkey - 2) ELSE '' END AS inputs,
      CASE WHEN o_orderkey % 3 <> 0 THEN 't' || o_orderkey WHEN o_orderkey % 2 <> 0 THEN 'c' || o_orderkey ELSE '' END AS outputs FROM orders""",
    "manifest_replay": """WITH events AS (SELECT * FROM (VALUES (1,'flush',0,[]::VARCHAR[],['s1']),(2,'flush',0,[],['s2']),(3,'compaction',0,['s1','s2'],['s3','s5']),
        (4,'flush',0,[],['s4']),(5,'compaction',1,['s3'],['s6'])) t(seq, kind, level, inputs, outputs)),
      made AS (SELECT seq, CASE kind WHEN 'flush' THEN 0 ELSE level + 1 END AS level, unnest(outputs) AS path, unnest(range(len(outputs))) AS position FROM events),
      gone AS (SELECT level, unnest(inputs) AS path FROM events WHERE kind = 'compaction')
      SELECT level::BIGINT AS level, path, row_number() OVER (PARTITION BY level ORDER BY seq DESC, position) AS place FROM made m
      WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.level = m.level AND g.path = m.path)""",
    "wal_replay": f"WITH kv AS ({KV_EVENTS}) {_NEWEST}",
    "scan_after_compaction": f"WITH kv AS (SELECT key, value, (seq % 3) * 1000000000000 + seq AS seq FROM ({KV_EVENTS})) {_NEWEST}",
    "store_reopen": f"""WITH kv AS (SELECT key, value, (seq % 3) * 1000000000000 + seq AS seq FROM ({KV_EVENTS})
        UNION ALL SELECT key, encode(key), 9000000000000 + seq FROM ({KV_EVENTS}) WHERE seq % 50 = 0) {_NEWEST}""",
    "store_multi_get": f"""WITH kv AS (SELECT key, value, (seq % 3) * 1000000000000 + seq AS seq FROM ({KV_EVENTS})), {_numbers('user%08d', 3)}, newest AS ({_NEWEST})
      SELECT probe AS key, value FROM probes LEFT JOIN newest ON key = probe""",
    "sst_get": f"""WITH kv AS ({KV_ORDERS}), {_numbers('%012d', 10, 2000)} SELECT probe AS key, hex(value) AS value FROM probes LEFT JOIN kv ON key = probe""",
    "store_close": f"""WITH kv AS (SELECT key, value, (seq % 3) * 1000000000000 + seq AS seq FROM ({KV_EVENTS})
        UNION ALL SELECT key, encode(key), 9000000000000 + seq FROM ({KV_EVENTS}) WHERE seq % 50 = 0) {_NEWEST}""",
    "store_from_files": f"WITH kv AS (SELECT key, value, (seq % 3) * 1000000000000 + seq AS seq FROM ({KV_EVENTS})) {_NEWEST}",
    "sst_roundtrip": f"WITH kv AS ({KV_ORDERS}) SELECT key, hex(value) AS value FROM kv WHERE key >= '000000000100'",
    "streaming_upsert": f"WITH kv AS ({KV_EVENTS}) {_NEWEST}",
}

_QUERIES = [
    record_size, record_encode, record_roundtrip, record_list_decode, point_get, multi_get, range_scan, full_scan, lower_bound, merge_newest_wins,
    merge_with_duplicates, concat_runs, memtable_freeze, memtable_snapshot, approximate_vs_exact_size, block_pack, meta_blocks, find_block, sstable_summary,
    table_range_prune, bloom_parameters, bloom_membership, get_serving_tier, compact_l0, compact_levels, manifest_replay, wal_replay, scan_after_compaction,
    store_reopen, store_multi_get, sst_roundtrip, streaming_upsert, sst_get, event_log_roundtrip, store_close, store_from_files,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLES)
