"""An ordered key/value store: puts go to a log of segments, flushes and compactions rewrite it as sorted tables.

Every record carries the batch and position of its put, so that the newest value of a key is the same wherever the record
lies: no flush, compaction or reopening changes a read.  The state is a fold over a versioned log of events; a version is
made by one writer only, who is then the one that changed the state (others reload and try again), and readers keep the
version that they began with.  Files are never changed, and only ``vacuum`` removes any.
"""

from __future__ import annotations

import bisect
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam.config import Configuration
from loam.functions.codec import record_size
from loam.operators import lookup
from loam.operators.merge import newest_wins
from loam.plans.policy import cascade
from loam.plans.replay import EVENTS, live_tables
from loam.sources import sst
from loam.sources.address import filesystem
from loam.sources.binary import decode_manifest
from loam.sources.log import CommitLog, Conflict, Files

ROWS = "key string, value binary, batch long, pos long"
ORDER = ["batch", "pos"]
#: Versions between two snapshots of the state, which bound what an opening reads.
SNAPSHOT_EVERY = 64
#: Seconds for which a run that no version names may still be another writer's, about to be named.
GRACE = 86_400
#: Requested keys that are brought to the driver, where they tell which runs can hold any.
PRUNE_KEYS = 10_000


@dataclass(frozen=True)
class Run:
    """A segment of the log or a table: a folder of Parquet files and what it holds."""

    path: str
    first_key: str
    last_key: str
    records: int
    bytes: int

    def holds(self, lower: str, upper: str) -> bool:
        return self.first_key <= upper and self.last_key >= lower


@dataclass(frozen=True)
class State:
    version: int = 0
    next_batch: int = 0
    active: tuple[Run, ...] = ()
    immutable: tuple[tuple[Run, ...], ...] = ()  # newest first
    levels: tuple[tuple[Run, ...], ...] = ()  # newest first; 0 to nb_levels
    streams: dict = field(default_factory=dict)  # last batch of each stream that was put

    def runs(self) -> list[Run]:
        return [*self.active, *(r for b in self.immutable for r in b), *(r for level in self.levels for r in level)]

    @classmethod
    def from_dict(cls, d: dict) -> State:
        runs = lambda group: tuple(Run(**r) for r in group)
        return cls(d["version"], d["next_batch"], runs(d["active"]), tuple(map(runs, d["immutable"])), tuple(map(runs, d["levels"])), d["streams"])


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Configuration, state: State):
        self.spark, self.config, self.state = spark, config, state
        self.files = Files(spark, root)
        self.log = CommitLog(self.files)
        self._lock = threading.RLock()

    # Opening and closing

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: Configuration | None = None) -> Store:
        """A new store; the folder is made, and must not hold a store."""
        config = config or Configuration()
        files = Files(spark, root)
        for folder in ("manifest", "snapshots"):
            files.make(folder)
        try:
            CommitLog(files).append(0, {"event_type": "create", "configuration": config.as_dict()})
        except Conflict:
            raise ValueError(f"{root} holds a store") from None
        return cls(spark, files.root, config, State(levels=((),) * (config.nb_levels + 1)))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """The store as its log says, with all records that were put."""
        log = CommitLog(Files(spark, root))
        first = log.read(0)
        if first is None:
            raise ValueError(f"{root} holds no store")
        config = Configuration(**first["configuration"])
        snapshot = log.last_snapshot()
        store = cls(spark, root, config, State.from_dict(snapshot[1]) if snapshot else State(levels=((),) * (config.nb_levels + 1)))
        store.refresh()
        return store

    def refresh(self) -> State:
        with self._lock:
            while (event := self.log.read(self.state.version + 1)) is not None:
                self.state = replace(_fold(self.state, event), version=self.state.version + 1)
            return self.state

    def close(self) -> None:
        """Freezes what is active and flushes everything."""
        with self._lock:
            self.freeze()
            while self.state.immutable:
                self.flush_next()

    def _commit(self, make: Callable[[State], dict | None]) -> bool:
        """Appends the event that ``make`` derives from the state; tries again from the newest state after a conflict."""
        while True:
            state = self.refresh()
            event = make(state)
            if event is None:
                return False
            try:
                self.log.append(state.version + 1, event)
            except Conflict:
                continue
            self.state = replace(_fold(state, event), version=state.version + 1)
            if self.state.version % SNAPSHOT_EVERY == 0:
                self.log.snapshot(self.state.version, asdict(self.state))
            return True

    def _whole(self, *paths: str) -> None:
        """Before runs are named by an event: none of them may have been removed meanwhile."""
        gone = [p for p in paths if not self.files.exists(p)]
        if gone:
            raise RuntimeError(f"runs are gone before their event: {gone}; a vacuum's grace was shorter than this write")

    # Writing

    def put(self, key: str, value: bytes) -> None:
        self.put_all(self.spark.createDataFrame([(key, bytearray(value))], "key string, value binary").coalesce(1))

    def put_all(self, df: DataFrame, order: str | None = None, batch_of: tuple[str, int] | None = None) -> bool:
        """Puts rows (key, value); later ones in ``order`` win, rows without an order in any.  ``batch_of`` names a stream
        and its batch's number: a batch up to the stream's last is not put again."""
        again = lambda s: batch_of is not None and s.streams.get(batch_of[0], -1) >= batch_of[1]
        with self._lock:
            if again(self.refresh()):
                return False
            self._commit(lambda s: {"event_type": "reserve"})
            batch = self.state.next_batch - 1  # this version's, so no other writer's
            position = F.col(order).cast("long") if order else F.monotonically_increasing_id()
            rows = df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(batch).cast("long").alias("batch"), position.alias("pos"))
            run = self._write(rows, f"log/{uuid.uuid4().hex}")
            if run is None:
                return False
            self._whole(run.path)
            put = self._commit(lambda s: None if again(s) else {"event_type": "put", "run": run.__dict__, "batch_of": batch_of})
            if put and sum(r.bytes for r in self.state.active) >= self.config.max_sstable_size:
                self.freeze()
            return put

    def _write(self, rows: DataFrame, name: str) -> Run | None:
        seen = Observation()
        size = record_size()
        measured = rows.observe(seen, F.count("*").alias("records"), F.sum(size).alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count_if(F.col("key").isNull() | F.col("value").isNull()).alias("nulls"))
        _write_rows(measured, f"{self.files.root}/{name}")
        got = seen.get
        if got["nulls"]:
            self.files.remove(name)
            raise ValueError("keys and values must not be null")
        if not got["records"]:
            self.files.remove(name)
            return None
        return Run(name, got["first_key"], got["last_key"], got["records"], got["bytes"])

    def freeze(self) -> bool:
        """What is active becomes the newest immutable batch."""
        return self._commit(lambda s: {"event_type": "freeze"} if s.active else None)

    def flush_next(self) -> bool:
        """The oldest immutable batch becomes the newest table of level 0; compactions that are due follow."""
        with self._lock:
            state = self.refresh()
            if not state.immutable:
                return False
            oldest = state.immutable[-1]
            rows = newest_wins(self._rows(list(oldest)), ORDER)
            table = self._write(self._sorted(rows, sum(r.bytes for r in oldest)), f"tables/{uuid.uuid4().hex}")
            self._whole(table.path)
            done = self._commit(lambda s: {"event_type": "flush", "outputs": [table.__dict__]} if s.immutable and s.immutable[-1] == oldest else None)
        if done:
            self.try_compact()
        return done

    def _sorted(self, rows: DataFrame, size: int) -> DataFrame:
        parts = max(1, -(-size // self.config.max_sstable_size))
        return (rows.repartitionByRange(int(parts), "key") if parts > 1 else rows.coalesce(1)).sortWithinPartitions("key")

    # Compaction

    def counts(self) -> list[int]:
        return [len(level) for level in self.state.levels]

    def try_compact(self) -> list[int]:
        return cascade(self.counts, self.config, self.compact)

    def compact(self, level: int) -> None:
        """Rewrites a level's tables, newest value of each key, as tables by key range on the next level (the last level
        stays).  Runs in one pass over its inputs: a shuffle by key with values combined first, then one by range.  What the tables
        hold is counted from their keys and sizes, which are columns of their own; values are not read again."""
        with self._lock:
            state = self.refresh()
            inputs = state.levels[level]
            if not inputs:
                return
            size = sum(r.bytes for r in inputs)
            folder = f"tables/{uuid.uuid4().hex}"
            rows = self._sorted(newest_wins(self._rows(list(inputs)), ORDER), size).withColumns({"part": F.spark_partition_id(), "size": record_size()})
            _write_rows(rows.sortWithinPartitions("part", "key"), f"{self.files.root}/{folder}", "part")
            written = self.spark.read.schema("key string, size long, part int").parquet(f"{self.files.root}/{folder}")
            each = written.groupBy("part").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
            outputs = [Run(f"{folder}/part={r['part']}", r["first_key"], r["last_key"], r["records"], r["bytes"]).__dict__ for r in each.orderBy("part").collect()]  # a row a table
            self._whole(*(r["path"] for r in outputs))
            event = {"event_type": "compaction", "level": level, "inputs": [r.path for r in inputs], "outputs": outputs}
            self._commit(lambda s: event if set(inputs) <= set(s.levels[level]) else None)

    # Reading

    def _rows(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], ROWS)
        paths = [f"{self.files.root}/{r.path}" for r in runs]
        return self.spark.read.schema(ROWS).parquet(*paths)

    def rows(self, lower: str | None = None, upper: str | None = None) -> DataFrame:
        """All records within the bounds, old ones too, of runs that can hold any: key, value, batch, pos."""
        lookup.check_bounds(lower, upper)
        runs = [r for r in self.refresh().runs() if lower is None or r.holds(lower, upper)]
        return self._rows(runs).filter(lookup.within(lower, upper))

    def get(self, key: str) -> bytes | None:
        found = lookup.get(self.rows(key, key), key, ORDER).collect()
        return bytes(found[0]["value"]) if found else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of each requested key, null where it is missing.

        Reads the runs that can hold a requested key, by the keys themselves if they are few, else by their range; the bounds
        reach the files' statistics, and the keys, if few, their filters.
        """
        wanted = keys.select("key").distinct()
        few = [r["key"] for r in wanted.filter("key is not null").limit(PRUNE_KEYS + 1).collect()]
        if len(few) > PRUNE_KEYS:
            lower, upper = wanted.agg(F.min("key"), F.max("key")).first()
            rows = self.rows(lower, upper)
        else:
            few.sort()
            at = [(bisect.bisect_left(few, r.first_key), r) for r in self.refresh().runs()]
            rows = self._rows([r for i, r in at if i < len(few) and few[i] <= r.last_key])
            rows = rows.filter(F.col("key").isin(few)) if few else rows.limit(0)
        return lookup.multi_get(rows, keys, ORDER).select("key", "value")

    def scan(self, lower: str | None = None, upper: str | None = None) -> DataFrame:
        """(key, value) within the inclusive bounds, in key order; both bounds or none."""
        return lookup.scan(self.rows(lower, upper), lower, upper, ORDER).select("key", "value").orderBy("key")

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Removes runs that the newest version does not hold; readers of older versions must be done.

        A run in which anything was written within ``grace`` seconds stays: another writer may be about to name it.
        """
        before = self.files.now() - 1000 * grace
        live = {r.path.split("/part=")[0] for r in self.refresh().runs()}
        dead = [f"{d}/{n}" for d in ("log", "tables") for n in self.files.names(d) if f"{d}/{n}" not in live]
        return [n for n in dead if (not grace or self.files.touched(n) < before) and self.files.remove(n)]

    # Exchange with files in the byte format

    @classmethod
    def from_files(cls, spark: SparkSession, root: str, manifest: str, folder: str | None = None) -> Store:
        """A new store at ``root`` with the configuration and tables that an event log in the byte format names.

        Tables keep their levels, and newer ones stay newer.  ``folder``: where the tables are, if their paths are relative.
        """
        files, path = filesystem(manifest)
        with files.open_input_file(path) as f:
            config, events = decode_manifest(f.read())
        rows = [(n, e["event_type"], e["level"], e["inputs"], e["outputs"]) for n, e in enumerate(events)]
        live = live_tables(spark.createDataFrame(rows, EVENTS)).orderBy("level", F.desc("event_seq"), "position").collect()  # a row a table
        store = cls.create(spark, root, config)
        sst.register(spark)
        for r in reversed(live):  # the oldest first, so that each batch is newer than those before
            store._commit(lambda s: {"event_type": "reserve"})
            records = spark.read.format("sst").load(f"{folder.rstrip('/')}/{r['path']}" if folder else r["path"])
            rows = records.select("key", "value", F.lit(store.state.next_batch - 1).cast("long").alias("batch"), F.lit(0).cast("long").alias("pos"))
            run = store._write(rows.coalesce(1).sortWithinPartitions("key"), f"tables/{uuid.uuid4().hex}")
            if run:
                store._commit(lambda s, run=run, r=r: {"event_type": "import", "level": min(r["level"], config.nb_levels), "outputs": [run.__dict__]})
        return store


def _write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.option("parquet.bloom.filter.enabled#key", "true")
    (writer.partitionBy(by) if by else writer).parquet(path)


def _fold(state: State, event: dict) -> State:
    """The state after an event."""
    kind = event["event_type"]
    if kind == "put":
        run = Run(**event["run"])
        streams = state.streams | dict([event["batch_of"]]) if event["batch_of"] else state.streams
        return replace(state, active=(*state.active, run), streams=streams)
    if kind == "reserve":
        return replace(state, next_batch=state.next_batch + 1)
    if kind == "freeze":
        return replace(state, active=(), immutable=(state.active, *state.immutable))
    levels = [list(level) for level in state.levels]
    outputs = [Run(**r) for r in event["outputs"]] if kind in ("flush", "compaction", "import") else []
    if kind == "flush":
        levels[0] = outputs + levels[0]
        state = replace(state, immutable=state.immutable[:-1])
    elif kind == "import":
        levels[event["level"]] = outputs + levels[event["level"]]
    elif kind == "compaction":
        level, taken = event["level"], set(event["inputs"])
        levels[level] = [r for r in levels[level] if r.path not in taken]
        below = min(level + 1, len(levels) - 1)
        levels[below] = outputs + levels[below]
    else:
        raise ValueError(f"unknown event {kind}")
    return replace(state, levels=tuple(map(tuple, levels)))
