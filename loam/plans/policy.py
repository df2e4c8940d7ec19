"""When levels are compacted."""

from __future__ import annotations

from collections.abc import Callable

from loam.config import Configuration


def cascade(counts: Callable[[], list[int]], config: Configuration, compact: Callable[[int], None]) -> list[int]:
    """One ascending pass: level 0 by its number of tables, then each level but the last if it has tables and they are
    ``levels_ratio`` of the next level's or more (an empty next level always is).  ``counts`` is asked anew before each
    decision, since a compaction may trigger the next.  Gives the levels that were compacted."""
    done = []
    if counts()[0] >= config.max_l0_sstables:
        compact(0)
        done.append(0)
    for level in range(1, config.nb_levels):
        now = counts()
        if now[level] and now[level] >= config.levels_ratio * now[level + 1]:
            compact(level)
            done.append(level)
    return done
