"""Merging runs of records.

``newest_wins`` keeps one row a key.  It combines in each task before anything moves, so that a key with a third of all
rows sends one row from each task; a filter on the key passes below it to the scan, one on the value must stand above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, order: list[str | Column], key: str = "key", keep: list[str] | None = None) -> DataFrame:
    """key and the ``keep`` columns (all others if not given) of the row with the greatest ``order`` of each key."""
    keep = keep if keep is not None else [c for c in df.columns if c != key]
    rows = F.struct(*order).alias("__order")
    best = F.max_by(F.struct(*keep), rows).alias("__best")
    return df.groupBy(key).agg(best).select(key, *(F.col(f"__best.{c}").alias(c) for c in keep))


def numbered(runs: list[DataFrame], name: str = "precedence") -> DataFrame:
    """All runs' rows with the position of their run: 0 stands for the newest."""
    return reduce(DataFrame.unionByName, [r.withColumn(name, F.lit(i)) for i, r in enumerate(runs)])


def merge_runs(runs: list[DataFrame], order: str | None = None) -> DataFrame:
    """The newest run's row of each key; within a run the greatest ``order``."""
    by = [-F.col("precedence"), *([F.col(order)] if order else [])]
    return newest_wins(numbered(runs), by, keep=[c for c in runs[0].columns if c != "key"] + ["precedence"])


def merge_with_duplicates(runs: list[DataFrame]) -> DataFrame:
    """All rows by key, newer runs first."""
    return numbered(runs).orderBy("key", "precedence")


def concat_runs(runs: list[DataFrame], position: str) -> DataFrame:
    """All rows, run after run, each in its own order."""
    return numbered(runs, "table_pos").orderBy("table_pos", position)
