"""Tables in the byte format as a data source: ``spark.read.format("sst").load(folder)``, and a writer of such files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from loam.sources.address import filesystem
from loam.sources.binary import Table, encode_table

SCHEMA = "key string, value binary"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SstReader(DataSourceReader):
    """A partition a file, of which the end, the index and the blocks that can match are read; bounds on the key are taken over,
    and a single key asks the filter first."""

    def __init__(self, folder: str):
        self.folder, self.lower, self.upper = folder, None, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the name is the data source interface's
        for f in filters:
            on_key = getattr(f, "attribute", None) == ("key",)
            if on_key and isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.lower = f.value if self.lower is None else max(self.lower, f.value)
            if on_key and isinstance(f, (EqualTo, LessThanOrEqual)):
                self.upper = f.value if self.upper is None else min(self.upper, f.value)
            if not (on_key and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual))):
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = filesystem(self.folder)
        one = fs.get_file_info(path)
        found = [one] if one.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in found if f.path.endswith(".sst") or one.is_file] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(partition.path) as f:
            for rows in Table(lambda start, end: f.read_at(end - start, start), f.size()).blocks(self.lower, self.upper):
                if rows:
                    keys, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["key", "value"])


class SstDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SstReader:
        return SstReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; key bounds are then handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SstDataSource)


def write(rows: DataFrame, folder: str, block_size: int = 65_536, table_bytes: int = 64 << 20) -> DataFrame:
    """Writes sorted, distinct (key, value) rows as tables by key ranges; gives (path, records) of each file.

    A table's name is that of this write, of its task and of its place in it, so that a task that runs again writes the same
    tables; each is moved to its name when it is whole.
    """
    ordered = rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key")
    write = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get().partitionId()
        held, size, out = [], 0, []

        def close() -> None:
            name, part = f"{path}/{write}-{task:06d}-{len(out):06d}.sst", f"{path}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(part) as f:
                f.write(encode_table(held, block_size))
            fs.move(part, name)
            out.append((name, len(held)))

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((key, value))
                size += 8 + len(key.encode()) + len(value)
                if size >= table_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["path", "records"])

    return ordered.mapInArrow(run, "path string, records long")
