"""Thresholds of all metrics; values go into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    active_window_days: int = 90
    criticality_pass_percentile: float = 50.0
    decay_days: float = 30.0  # an e-folding time: a dependent of this age counts exp(-1)
    top_share_flag: float = 0.50
    hhi_moderate: float = 1500.0
    hhi_concentrated: float = 2500.0
    hhi_critical: float = 5000.0
    hhi_pass_below: float = 2500.0
    adoption_pass_percentile: float = 40.0
    debt_criticality_percentile: float = 75.0
    debt_hhi: float = 2500.0
    signals_required: int = 2
    fuzzy_cutoff: float = 0.6
    trend_days: tuple[int, int, int] = (14, 45, 89)
    fer_bounds: tuple[float, float, float, float] = (2.0, 1.3, 0.7, 0.4)


DEFAULT = Config()
