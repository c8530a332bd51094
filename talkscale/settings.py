"""Settings of the engine; all have the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    gate: float = 0.5
    member_speeches: int = 3
    member_sittings: int = 3
    member_max_se: float | None = None
    group_speeches: int = 5
    group_sittings: int = 5
    max_se: float = 0.60
    effective_sittings: float = 3
    calibration_pairs: int = 30
    calibration_packs: int = 3
    replicates: int = 1000
    seed: int = 20260921
    min_words: int = 60
    max_chars: int = 8000
    interruption_words: int = 25
    pack_chars: int = 24_000
    validation_experts: int = 3
    validation_clusters: int = 8


SETTINGS = Settings()
