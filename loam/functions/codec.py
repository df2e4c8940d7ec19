"""The byte layout of records: a little-endian int32 length before each of key and value."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the two lengths.
OVERHEAD = 8
RECORD = "key string, value binary"


def record(key: str = "key", value: str = "value") -> Column:
    return F.struct(F.col(key).alias("key"), F.col(value).alias("value"))


def record_size(key: str = "key", value: str = "value") -> Column:
    """Encoded bytes of a record; lengths are of bytes, so any text is a key."""
    return (F.octet_length(key) + F.octet_length(value) + OVERHEAD).cast("long")


def int32(number: Column) -> Column:
    digits = F.lpad(F.hex(number.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))))


def encode(key: str = "key", value: str = "value") -> Column:
    raw = F.col(key).cast("binary")
    return F.concat(int32(F.octet_length(raw)), raw, int32(F.octet_length(value)), F.col(value))


def _int32_at(data: Column, start: Column) -> Column:
    digits = [F.hex(F.substring(data, start + k, F.lit(1))) for k in (3, 2, 1, 0)]
    return F.conv(F.concat(*digits), 16, 10).cast("int")


def decode(data: str) -> Column:
    """struct(key, value) of the first record of a binary column, inside generated code."""
    raw = F.col(data)
    n = _int32_at(raw, F.lit(1))
    m = _int32_at(raw, n + 5)
    return F.struct(F.decode(F.substring(raw, F.lit(5), n), "UTF-8").alias("key"), F.substring(raw, n + 9, m).alias("value"))


def encode_record(key: str, value: bytes) -> bytes:
    raw = key.encode()
    return struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(value)) + value


def decode_records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """All records of a byte string; a torn record raises."""
    at = 0
    while at < len(data):
        parts = []
        for _ in range(2):
            if at + 4 > len(data):
                raise ValueError("a record's length is cut off")
            (n,) = struct.unpack_from("<i", data, at)
            if n < 0 or at + 4 + n > len(data):
                raise ValueError("a record is cut off")
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        yield parts[0].decode(), parts[1]


def decode_lists(df: DataFrame, data: str) -> DataFrame:
    """Rows (list, position, key, value) of byte strings of many records; ``list`` is the string's digest."""
    rows = df.select(F.sha1(data).alias("list"), F.col(data).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i.as_py(), k, *r) for i, d in zip(batch.column(0), batch.column(1), strict=True) for k, r in enumerate(decode_records(d.as_py()))]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["list", "position", "key", "value"])

    return rows.mapInArrow(run, f"list string, position long, {RECORD}")
