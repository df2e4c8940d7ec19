"""State of the levels from the log of events, as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_seq long, event_type string, level int, inputs array<string>, outputs array<string>"


def live_tables(events: DataFrame) -> DataFrame:
    """(level, path, event_seq, position) of the tables that no later compaction has taken.

    A flush puts its output on level 0, a compaction takes its inputs from its level and puts its outputs one below.
    """
    lower = F.when(F.col("event_type") == "flush", 0).otherwise(F.col("level") + 1)
    made = events.select("event_seq", lower.cast("int").alias("level"), F.posexplode("outputs").alias("position", "path"))
    gone = events.filter("event_type = 'compaction'").select("level", F.explode("inputs").alias("path"))
    return made.join(gone, ["level", "path"], "left_anti").select("level", "path", "event_seq", "position")
