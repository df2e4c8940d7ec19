"""Greedy folds that cut a sequence of record sizes into buffers, blocks and tables.

A fold's next cut is found in the running sums by binary search, so that its work is by cuts, not by records.  Folds within a
table run for each table in its own task, on rows that the table's size bounds.

The freeze fold is over the whole log, in ranges of ``RANGE_ROWS`` records.  Where a range's cuts lie depends on how full the
buffer is when the range begins, which only the ranges before tell; so each range first says, for every record that may be
its first cut (those of one buffer, and runs of them that come to the same are one), how many cuts follow and how full the
buffer is at its end.  One pass over these summaries gives each range its beginning, and all ranges are then cut side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.stage import written


#: Records of the log that are folded in one task.
RANGE_ROWS = 4_000_000


def after_full(sizes: np.ndarray, limit: int, carried: int = 0) -> tuple[np.ndarray, int]:
    """Group of each record when a group closes after the record that makes it ``limit`` or more; and the open group's size."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    group = np.zeros(len(sizes), np.int64)
    start, base = 0, -carried
    while start < len(sizes):
        end = int(np.searchsorted(total, base + limit, "left"))
        if end > len(sizes):
            return group, int(total[-1] - base)
        group[end:] += 1
        start, base = end, int(total[end])
    return group, 0


def before_full(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Group of each record when a group closes before the record that would take it over ``limit``.

    A record over the limit gets a group of its own.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    group = np.zeros(len(sizes), np.int64)
    start, number = 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        group[start:end] = number
        start, number = end, number + 1
    return group


def block_bytes(payload: int, records: int) -> int:
    return payload + 2 * records + 2


def table_cuts(sizes: np.ndarray, block_size: int, table_size: int) -> np.ndarray:
    """Table of each record of a merged run: a table closes after the record that makes its finished blocks ``table_size``
    or more, and the block begun by that record belongs to it; what is left over at the end is a table too."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    table = np.zeros(len(sizes), np.int64)
    start, number = 0, 0
    while start < len(sizes):
        at, finished = start, 0
        while True:
            end = max(at + 1, int(np.searchsorted(total, total[at] + block_size, "right")) - 1)
            if end >= len(sizes):
                table[start:] = number
                return table
            finished += block_bytes(int(total[end] - total[at]), end - at)
            at = end
            if finished >= table_size:  # the record at ``end`` finished the block
                break
        table[start : at + 1] = number
        start, number = at + 1, number + 1
    return table


def outcomes(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each possible first cut of a range of sizes: bytes up to it, cuts from it on, and the open bytes at the end; first cuts
    that come to the same are one, by the last of them."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(1, min(len(sizes), int(np.searchsorted(total, limit, "left"))) + 1)
    # Chains of cuts from all of them, step by step; chains that meet go on as one.
    cuts, left = np.ones(len(first), np.int64), np.zeros(len(first), np.int64)
    live, chain, on = np.arange(len(first)), first, np.arange(len(first))
    while len(live):
        after = np.searchsorted(total, total[chain] + limit, "left")
        ended = (after > len(sizes))[on]
        left[live[ended]] = total[-1] - total[chain[on[ended]]]
        live = live[~ended]
        cuts[live] += 1
        chain, on = np.unique(after[on[~ended]], return_inverse=True)
    last = np.flatnonzero((np.diff(cuts) != 0) | (np.diff(left) != 0))
    last = np.concatenate([last, [len(first) - 1]]) if len(first) else last
    return total[first[last]], cuts[last], left[last]


def freeze(df: DataFrame, limit: int, order: str = "seq", size: str = "size") -> DataFrame:
    """(order, batch): the write buffer that each record of the log falls in."""
    narrow = df.select(F.col(order).cast("long"), F.col(size).cast("long"))
    parts = -(-narrow.count() // RANGE_ROWS)
    if parts <= 1:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, carried = 0, 0
            for pdf in batches:
                group, carried = after_full(pdf[size].to_numpy(), limit, carried)
                yield pd.DataFrame({order: pdf[order], "batch": group + number})
                number += int(group[-1]) + (carried == 0) if len(group) else 0

        return narrow.coalesce(1).sortWithinPartitions(order).mapInPandas(run, f"{order} long, batch long")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order)[size].to_numpy()
        upto, cuts, left = outcomes(sizes, limit)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bytes": [int(sizes.sum())], "upto": [upto], "cuts": [cuts], "open": [left]})

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, carried = 0, 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame({"part": [r.part], "number": [number], "carried": [carried]})
                k = int(np.searchsorted(r.upto, limit - carried, "left"))
                number, carried = (number + int(r.cuts[k]), int(r.open[k])) if k < len(r.upto) else (number, carried + int(r.bytes))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        group, _ = after_full(pdf[size].to_numpy(), limit, int(pdf["carried"].iloc[0]))
        return pd.DataFrame({order: pdf[order], "batch": group + int(pdf["number"].iloc[0])})

    ranged = written(narrow.repartitionByRange(int(parts), order).withColumn("part", F.spark_partition_id()))
    said = ranged.groupBy("part").applyInPandas(summary, "part int, bytes long, upto array<long>, cuts array<long>, open array<long>")
    begun = said.coalesce(1).sortWithinPartitions("part").mapInPandas(begin, "part int, number long, carried long")
    return ranged.join(F.broadcast(begun), "part").groupBy("part").applyInPandas(cut, f"{order} long, batch long")


def blocks(df: DataFrame, limit: int, table: str = "table", size: str = "size") -> DataFrame:
    """``df`` (table, key, size) with the block of each record, by key within its table."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", key=lambda s: s.map(str.encode))
        return pdf.assign(block=before_full(pdf[size].to_numpy(), limit))

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (table, "key", size))
    return df.select(table, "key", size).groupBy(table).applyInPandas(one, f"{kinds}, block long")


class TableCuts:
    """``table_cuts`` over a sequence that comes in parts; what is kept between parts is a few numbers."""

    def __init__(self, block_size: int, table_size: int):
        self.block_size, self.table_size = block_size, table_size
        self.table, self.finished, self.filled, self.records = 0, 0, 0, 0

    def add(self, sizes: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(sizes), np.int64)
        at = 0
        while at < len(sizes):
            # The open block takes records while they fit; an empty one takes any.
            end = int(np.searchsorted(total, total[at] + self.block_size - self.filled, "right")) - 1
            end = max(end, at + 1) if not self.records else max(end, at)
            out[at:end] = self.table
            self.filled, self.records = self.filled + int(total[end] - total[at]), self.records + end - at
            at = end
            if at < len(sizes):  # this record finished the block
                self.finished += block_bytes(self.filled, self.records)
                self.filled = self.records = 0
                if self.finished >= self.table_size:
                    out[at] = self.table
                    at, self.table, self.finished = at + 1, self.table + 1, 0
        return out


def tables(df: DataFrame, block_size: int, table_size: int, size: str = "size") -> DataFrame:
    """(key, size, table) of a merged run, cut exactly, by one task that holds a batch at a time; production compaction cuts by
    key ranges instead, side by side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = TableCuts(block_size, table_size)
        for pdf in parts:
            yield pdf.assign(table=cuts.add(pdf[size].to_numpy()))

    kind = f"key {df.schema['key'].dataType.simpleString()}, {size} long, table long"
    return df.select("key", F.col(size).cast("long")).repartition(1).sortWithinPartitions("key").mapInPandas(run, kind)
