"""Index entries of blocks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def meta_blocks(placed: DataFrame, table: str = "table") -> DataFrame:
    """(table, block, first_key, last_key, records, offset) from rows (table, block, key, size).

    A block's bytes are its records' and two for each record and for the count; offsets add up within the table.
    """
    each = placed.groupBy(table, "block").agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("records"), (F.sum("size") + 2 * F.count("*") + 2).alias("bytes")
    )
    before = Window.partitionBy(table).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long")
    return each.withColumn("offset", offset).select(table, "block", "first_key", "last_key", "records", "offset")


def table_summary(rows: DataFrame, table: str = "table") -> DataFrame:
    """(table, first_key, last_key, records, bytes) from rows (table, key, size)."""
    return rows.groupBy(table).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("records"), F.sum("size").cast("long").alias("bytes"))
