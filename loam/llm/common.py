"""Helpers shared by the text operators: shared storage, skew-safe numbering, word splitting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009 to U+000D.  ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "loam-shared")
        _folders[app] = f"{base.rstrip('/')}/loam-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have gone first; the folder is then left to the cluster's own cleaning
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder, for small rows that are read whole; in ``parts`` files at most.

    One file a partition, without a commit protocol: many small rounds cost far fewer file operations than tables do.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def parts_for(rows: int, each: int = 250_000) -> int:
    """Files for so many narrow rows: a dozen at least, and ``each`` rows in a file beyond that."""
    return max(12, -(-rows // each))


def unused(df: DataFrame, stem: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def quoted(df: DataFrame) -> list[str]:
    """The columns' names for ``select``, whatever signs are in them."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def filtered(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that ``run`` leaves of each batch of ``df``, with all columns, whatever their names."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor) over an unsigned array."""
    with np.errstate(over="ignore"):
        a = a.astype(np.uint64, copy=True)
        a ^= a >> np.uint64(32)
        a *= np.uint64(0xD6E8FEB86659FD93)
        a ^= a >> np.uint64(32)
        a *= np.uint64(0xD6E8FEB86659FD93)
        a ^= a >> np.uint64(32)
    return a


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_powers = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text: a polynomial of its bytes, mixed.  No word becomes an object."""
    global _powers
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    kept = b[word]
    if not len(kept):
        return np.empty(0, np.uint64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    lengths = edges[1::2] - edges[0::2]
    first = np.cumsum(lengths) - lengths
    while lengths.max() > len(_powers):
        _powers = np.cumprod(np.full(2 * len(_powers), _powers[0], np.uint64))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    value = (kept.astype(np.uint64) + np.uint64(1)) * _powers[place]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def window_sums(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` words, from the words' hashes."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : n + k] * _places[k]
    return mix64(total)


_places = np.random.default_rng(20_240_229).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus``; a null counts as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
