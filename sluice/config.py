"""Shape of the sketch and tolerances of the recovery."""

from __future__ import annotations

from dataclasses import dataclass

#: Hash constants that other implementations of the sketch share.
CMS_SEEDS = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BLOOM_SEEDS = (
    0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x0AE7300A96DADB6C,
    0xD6E8FEB86659FD93, 0xA5B85C5E198ED849, 0xD4E4C98CB9E392B6, 0xFF51AFD7ED558CCD,
)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class SketchConfig:
    rows: int = 4
    columns: int = 16384
    bloom_columns: int = 1024
    cms_seeds: tuple[int, ...] = CMS_SEEDS
    bloom_seeds: tuple[int, ...] = BLOOM_SEEDS
    counter_modulus: int = 1 << 32
    least_correlation: float = 1e-9
    least_pivot: float = 1e-12
    least_residual: float = 1e-6
    heavy_buckets: int = 32
    heavy_share: float = 0.1
    full_scan_every: int = 10

    def __post_init__(self):
        for n in (self.columns, self.bloom_columns):
            if n < 1 or n & (n - 1):
                raise ValueError("columns must be a power of two")
        if not 1 <= self.rows <= len(self.cms_seeds):
            raise ValueError("there must be a seed for each row")

    @property
    def counters(self) -> int:
        return self.rows * self.columns


DEFAULT = SketchConfig()
