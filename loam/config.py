"""Tuning of a store."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Configuration:
    """Sizes are in encoded bytes; ``levels_ratio`` is the share of the next level's tables that triggers a compaction."""

    nb_levels: int = 6
    levels_ratio: float = 0.1
    max_l0_sstables: int = 10
    max_sstable_size: int = 262_144_000
    block_size: int = 65_536

    def __post_init__(self):
        if self.nb_levels < 1 or self.max_sstable_size < 1 or self.block_size < 1:
            raise ValueError("levels and sizes must be positive")

    def as_dict(self) -> dict:
        return asdict(self)
