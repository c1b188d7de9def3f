"""Repository names and URLs as column expressions.  Fixed values: the patterns of paths and of the .git ending."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def github_path(url: Column) -> Column:
    """owner/repo of a repository URL; null for other hosts, deeper or shorter paths."""
    s = F.regexp_replace(F.regexp_replace(F.trim(url), r"/+$", ""), r"\.git$", "")
    return F.nullif(F.regexp_extract(s, r"(?i)^https?://github\.com/([^/]+/[^/]+)$", 1), F.lit(""))


def host_path(url: Column, host: str) -> Column:
    """Text behind host/ without slashes around; the URL itself where the host isn't in it."""
    return F.when(url.contains(host + "/"), F.regexp_replace(F.substring_index(url, host + "/", -1), "^/+|/+$", "")).otherwise(url)


def as_url(name: Column, host: str = "github.com") -> Column:
    """owner/repo as a URL; URLs and other names stay."""
    return F.when(name.startswith("http"), name).when(name.contains("/"), F.concat(F.lit(f"https://{host}/"), name)).otherwise(name)


def short_name(name: Column, host: str = "github.com") -> Column:
    """Last segment of a path behind the host, else the name as it is."""
    return F.when(name.contains(host + "/"), F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)).otherwise(name)


def canonical(name: Column, aliases: Mapping[str, str]) -> Column:
    """Display name by a small map of aliases, else the name itself."""
    if not aliases:
        return name
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def slug(label: Column) -> Column:
    return F.replace(F.lower(label), F.lit(" "), F.lit("_"))
