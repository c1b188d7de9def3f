"""Landed API payloads (a JSON text per row) as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def commits(df: DataFrame) -> DataFrame:
    """repo, payload (array of commits) -> repo, email, name, committed_at; no email: unknown_{name}@unknown; login before name."""
    kind = "array<struct<commit:struct<author:struct<name:string,email:string,date:string>>,author:struct<login:string>>>"
    c = df.select("repo", F.explode(F.from_json("payload", kind)).alias("c"))
    author = F.col("c.commit.author")
    email = F.nullif(F.lower(F.trim(author["email"])), F.lit(""))
    return c.select("repo", F.coalesce(email, F.concat(F.lit("unknown_"), F.coalesce(author["name"], F.lit("")), F.lit("@unknown"))).alias("email"), F.coalesce("c.author.login", author["name"]).alias("name"), F.to_timestamp(author["date"]).alias("committed_at"))


def dependency_edges(df: DataFrame) -> DataFrame:
    """payload with nodes[] and edges[] that refer to nodes by index -> from_name, to_name, is_direct (node 0 is the package itself)."""
    kind = "struct<nodes:array<struct<versionKey:struct<system:string,name:string,version:string>>>,edges:array<struct<fromNode:int,toNode:int,requirement:string>>>"
    p = df.select(F.from_json("payload", kind).alias("p")).select("p.nodes", F.explode("p.edges").alias("e"))
    node = lambda i: F.try_element_at("nodes", F.coalesce(F.col(i), F.lit(0)) + 1)
    return p.select(node("e.fromNode")["versionKey"]["name"].alias("from_name"), node("e.toNode")["versionKey"]["name"].alias("to_name"), node("e.toNode")["versionKey"]["system"].alias("ecosystem"), (F.coalesce("e.fromNode", F.lit(0)) == 0).alias("is_direct"))


def version_metadata(df: DataFrame) -> DataFrame:
    """payload -> name, version, licences joined, first source or home page link, purl."""
    kind = "struct<versionKey:struct<system:string,name:string,version:string>,licenses:array<string>,links:array<struct<label:string,url:string>>>"
    p = df.select(F.from_json("payload", kind).alias("p"))
    link = F.try_element_at(F.filter("p.links", lambda x: x["label"].isin("SOURCE_REPO", "HOME_PAGE")), F.lit(1))["url"]
    k = F.col("p.versionKey")
    return p.select(k["name"].alias("name"), k["version"].alias("version"), F.array_join("p.licenses", ", ").alias("licences"), link.alias("source_url"), F.concat(F.lit("pkg:"), F.lower(k["system"]), F.lit("/"), k["name"], F.lit("@"), k["version"]).alias("purl"))


def project_enrichment(df: DataFrame) -> DataFrame:
    """payload -> stars, forks, issues, score and reason of the first check named Maintained."""
    kind = "struct<projectKey:struct<id:string>,starsCount:bigint,forksCount:bigint,openIssuesCount:bigint,scorecard:struct<checks:array<struct<name:string,score:int,reason:string>>>>"
    p = df.select(F.from_json("payload", kind).alias("p"))
    check = F.try_element_at(F.filter("p.scorecard.checks", lambda x: x["name"] == "Maintained"), F.lit(1))
    return p.select(F.col("p.projectKey.id").alias("id"), F.col("p.starsCount").alias("stars"), F.col("p.forksCount").alias("forks"), F.col("p.openIssuesCount").alias("issues"), check["score"].alias("maintained"), check["reason"].alias("reason"))


def reverse_dependencies(df: DataFrame) -> DataFrame:
    """dependencies[] joined with versions[] on version_id; without a version the dependency's own crate_id."""
    kind = "struct<dependencies:array<struct<id:bigint,version_id:bigint,crate_id:string,req:string>>,versions:array<struct<id:bigint,crate:string,num:string>>>"
    p = df.select("package", F.from_json("payload", kind).alias("p"))
    versions = F.map_from_entries(F.transform("p.versions", lambda v: F.struct(v["id"], v)))
    d = p.select("package", versions.alias("v"), F.explode("p.dependencies").alias("d"))
    return d.select("package", F.coalesce(F.try_element_at("v", F.col("d.version_id"))["crate"], F.col("d.crate_id")).alias("dependent"), F.col("d.req").alias("requirement"))


def package_stats(df: DataFrame, known_urls: Mapping[str, str]) -> DataFrame:
    """payload -> downloads, recent downloads, repository URL (a map of known ones first; others only on github.com)."""
    name = F.get_json_object("payload", "$.crate.id")
    url = F.regexp_replace(F.get_json_object("payload", "$.crate.repository"), "/+$", "")
    table = F.create_map(*[F.lit(x) for p in known_urls.items() for x in p]) if known_urls else F.create_map(F.lit(""), F.lit(""))
    return df.select(name.alias("name"), F.get_json_object("payload", "$.crate.downloads").cast("long").alias("downloads"), F.get_json_object("payload", "$.crate.recent_downloads").cast("long").alias("recent"), F.coalesce(F.try_element_at(table, name), F.when(url.contains("github.com"), url)).alias("repository"))


def downloads(payload: Column) -> Column:
    """Monthly downloads of either form: {downloads}, {data: {last_month}}, or the sum of {data: [{downloads}]} (0 is null)."""
    listed = F.aggregate(F.from_json(F.get_json_object(payload, "$.data"), "array<struct<downloads:bigint>>"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["downloads"], F.lit(0)))
    return F.coalesce(F.get_json_object(payload, "$.downloads").cast("long"), F.get_json_object(payload, "$.data.last_month").cast("long"), F.nullif(listed, F.lit(0).cast("long")))


def grants(df: DataFrame, fields: str = "struct<title:string,amount:double>") -> DataFrame:
    """A bare list, or the first list found under grants, applications, projects or data."""
    kind = f"array<{fields}>"
    bare = F.when(F.trim("payload").startswith("["), F.from_json("payload", kind))
    under = [F.when(F.get_json_object("payload", f"$.{k}").startswith("["), F.from_json(F.get_json_object("payload", f"$.{k}"), kind)) for k in ("grants", "applications", "projects", "data")]
    return df.select(F.explode(F.coalesce(bare, *under)).alias("g")).select("g.*")
