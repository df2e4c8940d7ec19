"""Reads: point, batch and range lookups, block and table search.

All take rows with a ``key`` and return DataFrames; bounds are plain values, so that they reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.merge import newest_wins
from loam.operators.stage import written

#: Rows of a lookup's smaller side up to which it is sent to every task; beyond it both sides are dealt by key.
SEND_ROWS = 200_000
#: Cells of the key space by which many ranges meet their probes.
RANGE_CELLS = 256


def check_bounds(lower: str | None, upper: str | None) -> None:
    if (lower is None) != (upper is None):
        raise ValueError("give both bounds or none")


def within(lower: str | None, upper: str | None, key: str = "key") -> Column:
    """The inclusive range; the empty text is a bound like any other."""
    check_bounds(lower, upper)
    return F.lit(True) if lower is None else F.col(key).between(lower, upper)


def get(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of a key, or none: a top-1, without a shuffle of other keys."""
    return df.filter(F.col("key") == key).orderBy(*(F.desc(c) for c in order)).limit(1)


def scan(df: DataFrame, lower: str | None, upper: str | None, order: list[str]) -> DataFrame:
    return newest_wins(df.filter(within(lower, upper)), order)


def sent_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if a count, that stops at the bound, proves it small."""
    rows = SEND_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def multi_get(df: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """A row for each requested key, with null columns for those that are missing."""
    wanted = sent_if_small(keys.select("key").distinct())
    newest = newest_wins(df.join(wanted, "key", "left_semi"), order)
    return wanted.join(newest, "key", "left")


def lower_bounds(df: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, key): the least key at or above each probe, null if none.

    Keys and probes are sorted together and the next key is carried back, range by range: no pair of a probe and a
    key is ever made.  The carried value of later ranges is one row a range.
    """
    both = df.select("key").distinct().select(F.col("key").alias("at"), F.lit(1).alias("kind"), "key").unionByName(
        probes.select(F.col("probe").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("key"))
    )
    # Written, so that both uses below see the same ranges.
    ranged = written(both.repartitionByRange(F.col("at")).withColumn("part", F.spark_partition_id()))
    later = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = ranged.withColumn("next", F.first("key", ignorenulls=True).over(later))
    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    carried = first.withColumn("after", F.min("first").over(after)).select("part", "after")
    return found.filter("kind = 0").join(F.broadcast(carried), "part").select(F.col("at").alias("probe"), F.coalesce("next", "after").alias("key"))


def _cuts(ranges: DataFrame, count: int) -> list[str]:
    """About ``RANGE_CELLS`` first keys, chosen by digest: bounds of cells of the key space."""
    share = max(1, count // RANGE_CELLS)
    chosen = ranges.filter(F.pmod(F.xxhash64("first_key"), F.lit(share)) == 0).select("first_key").distinct()
    return sorted(r[0] for r in chosen.limit(4 * RANGE_CELLS).collect())


def range_join(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of ``probes`` (probe, ..) with the rows of ``ranges`` (first_key, last_key, ..) that hold it.

    Few ranges go to where the probes are.  Beyond ``SEND_ROWS`` both meet by cells of the key space: a probe lies in one, a range in
    those that it reaches over, and only rows of a cell are compared.
    """
    hit = (F.col("probe") >= F.col("first_key")) & (F.col("probe") <= F.col("last_key"))
    count = ranges.count()
    if count <= SEND_ROWS:
        return probes.join(F.broadcast(ranges), hit)
    cuts = F.array(*map(F.lit, _cuts(ranges, count))).cast("array<string>")
    cell = lambda c: F.size(F.filter(cuts, lambda x: x <= F.col(c)))
    placed = ranges.withColumn("__cell", F.explode(F.sequence(cell("first_key"), cell("last_key"))))
    return probes.withColumn("__cell", cell("probe")).join(placed, "__cell").filter(hit).drop("__cell")


def find_blocks(metas: DataFrame, probes: DataFrame) -> DataFrame:
    """(table, probe, block): for each table that has one the first block whose key range holds the probe."""
    return range_join(probes.select("probe"), metas).groupBy("table", "probe").agg(F.min("block").alias("block"))


def tables_holding(tables: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, table) for the tables whose key range holds the probe."""
    return range_join(probes, tables).select("probe", "table")


def serving_tiers(df: DataFrame, tier: str = "tier") -> DataFrame:
    """(key, tier): the first tier that holds each key."""
    return df.groupBy("key").agg(F.min(tier).alias(tier))
