"""Business parameters, passed to jobs as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: they decide prices and tiers
    margin: float = 0.18
    scrap: float = 0.03
    min_order_eur: float = 500.0
    fast_track: float = 0.80
    fast_track_similarity: float = 0.85
    manual: float = 0.55
    min_similarity: float = 0.50
    min_blend: float = 0.60
    top_k: int = 3
    max_deviation: float = 0.30
    outsourced_weeks: int = 1
    default_batch: int = 200
    home_plant: str = "DE"
    tiers: tuple[int, ...] = (50, 200, 500, 1000, 2500)
    bars_mm: tuple[int, ...] = (10, 12, 16, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 120, 150, 180, 200)
    plates_mm: tuple[int, ...] = (5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 80, 100)


DEFAULT = Params()
