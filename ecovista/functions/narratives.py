"""Sentences that explain results, as column expressions (own wording)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def _n(x: Column, digits: int = 0) -> Column:
    """A number in text: whole, or with a fixed number of digits."""
    return F.round(x, 0).cast("long").cast("string") if digits == 0 else F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def criticality(raw: Column, pct: Column, passed: Column, config: Config = DEFAULT) -> Column:
    need = f"{config.criticality_pass_percentile:.0f}"
    return _join("criticality ", F.when(passed, "met").otherwise("missed"), ": ", _n(raw), " active packages build on it, more than ", _n(pct), f" % of all packages have (", need, " % asked)")


def concentration(hhi: Column, contributor: Column, share: Column, passed: Column, config: Config = DEFAULT) -> Column:
    limit = f"{config.hhi_pass_below:.0f}"
    bad = _join("maintenance missed: ", contributor, " made ", _n(share * 100), " % of the commits, HHI ", _n(hhi), f" (under {limit} asked)")
    return F.when(passed, _join("maintenance met: HHI ", _n(hhi), f" (under {limit} asked)")).otherwise(bad)


def adoption(score: Column, passed: Column, config: Config = DEFAULT) -> Column:
    return _join("adoption ", F.when(passed, "met").otherwise("missed"), ": mean rank of downloads, stars and forks ", _n(score), f" of 100 ({config.adoption_pass_percentile:.0f} asked)")


def gate(passed: Column, votes: Column, texts: list[Column], config: Config = DEFAULT) -> Column:
    return _join(F.when(passed, "Passes").otherwise("Fails"), " with ", votes, f" of {config.signals_required} signals needed; ", F.concat_ws("; ", *texts), ".")


def funding(tier: Column, crit_pct: Column, fund_pct: Column, fer: Column) -> Column:
    places = _join("criticality rank ", _n(crit_pct), ", funding rank ", _n(fund_pct), ", ratio ", _n(fer, 2))
    words = {"critically_underfunded": "Far too little money for what depends on it: ", "underfunded": "Less money than its importance suggests: ", "balanced": "Money and importance agree: ", "overfunded": "More money than its importance suggests: "}
    text = F.when(tier == "unfunded", _join("No funding to compare with; criticality rank ", _n(crit_pct), "."))
    for name, head in words.items():
        text = text.when(tier == name, _join(head, places, "."))
    return text.otherwise(_join("Much more money than its importance suggests: ", places, "."))


def debt(project: Column, pct: Column, dependents: Column, contributor: Column, share: Column, hhi: Column, tier: Column, trend: Column, days: Column) -> Column:
    return _join(project, ": ", dependents, " dependents (rank ", _n(pct), "), ", trend, " for ", days, " days; ", contributor, " made ", _n(share * 100), " % of the commits (HHI ", _n(hhi), ", ", tier, ").")


def keystone(contributor: Column, repos: Column, projects: Column, score: Column, reach: Column) -> Column:
    """Counts packages and the distinct projects they belong to."""
    return _join("Without ", contributor, ", ", repos, " packages of ", projects, " projects lose their main maintainer (score ", score, "); ", reach, " packages lie downstream.")


def north_star_text(total: Column, underfunded: Column, debt_size: Column, pass_pct: Column) -> Column:
    return _join(underfunded, " of ", total, " projects have too little funding for their importance, ", debt_size, " repositories carry maintenance debt, and ", pass_pct, " % of those scored pass the gate.")


def comparison(earlier: Column, later: Column, gate: Column, hhi: Column, flagged: Column, debt: Column) -> Column:
    """What changed between two rounds, leaving out what didn't (but for the gate)."""
    moved = lambda x, up, down, by: F.when(F.round(x, 9) > 0, _join(up, by)).when(F.round(x, 9) < 0, _join(down, by))
    # Differences without their binary noise, and in decimals: a half is rounded up whatever its factors are in binary.
    size = lambda x: F.round(F.abs(x), 9).cast("decimal(28,9)")
    points = lambda x: _join(_n(100 * size(x), 1), " points")
    parts = [
        F.coalesce(moved(gate, "gate passes up by ", "gate passes down by ", points(gate)), F.lit("gate passes as before")), moved(hhi, "concentration up by ", "concentration down by ", _n(size(hhi))),
        moved(flagged, "flagged repositories up by ", "flagged repositories down by ", points(flagged)), moved(debt, "debt entries up by ", "debt entries down by ", _n(size(debt))),
    ]
    return _join(earlier, " to ", later, ": ", F.concat_ws(", ", *parts), ".")
