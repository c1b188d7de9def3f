"""Tiers and labels as column expressions.

Fixed values: the names of tiers and bands, their bounds (here and in config), and the labels of directions.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def hhi_tier(hhi: Column, config: Config = DEFAULT) -> Column:
    return F.when(hhi < config.hhi_moderate, "healthy").when(hhi < config.hhi_concentrated, "moderate").when(hhi < config.hhi_critical, "concentrated").otherwise("critical")


def fer_tier(fer: Column, config: Config = DEFAULT) -> Column:
    a, b, c, d = config.fer_bounds
    return F.when(fer.isNull(), "unfunded").when(fer > a, "critically_underfunded").when(fer > b, "underfunded").when(fer > c, "balanced").when(fer > d, "overfunded").otherwise("significantly_overfunded")


FER_TIERS = ("critically_underfunded", "underfunded", "balanced", "overfunded", "significantly_overfunded", "unfunded")


def commit_trend(days: Column, config: Config = DEFAULT) -> Column:
    a, b, c = config.trend_days
    return F.when(days < a, "active").when(days < b, "stable").when(days < c, "stagnant").otherwise("declining")


def edge_share_band(percent: Column) -> Column:
    return F.when(percent >= 70, "dominant").when(percent >= 40, "major").when(percent >= 20, "notable").otherwise("minor")


def top_share_band(percent: Column) -> Column:
    return F.when(percent < 30, "healthy").when(percent < 50, "moderate").when(percent < 80, "concentrated").otherwise("critical")


def ecosystem_of(key: Column, npm_prefixes: Collection[str] = ("@",)) -> Column:
    """By prefix: scopes (and names) of one registry, repository URLs, else the other registry."""
    npm = reduce(or_, [key.startswith(p) for p in npm_prefixes], F.lit(False))
    return F.when(npm, "NPM").when(key.startswith("https://github.com"), "GITHUB").otherwise("PYPI")


def direction(delta: Column, lower_is_better: bool = False) -> Column:
    up, down = ("worsening", "improving") if lower_is_better else ("improving", "worsening")
    return F.when(delta == 0, "--").when(delta > 0, f"↑ ({up})").otherwise(f"↓ ({down})")
