"""CSV and JSON scans with explicit schemas, and guarded sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import as_url, slug
from ..operators.rank import first_per_key, last_per_key

PROJECTS = "title string, category string, integration_status string, github_url string, website string, total_awarded_usd string, open_source string, description string"
REPOS = "github_url string, round string, submission_title string, total_awarded_usd string, tranche_completion string"
CONTRIBUTIONS = "repo_full_name string, contributor_login string, commits_90d string, commit_share_pct string"
DEPENDENCIES = "from_repo string, to_package string, ecosystem string, is_direct string"
ADOPTION = "repo_full_name string, ecosystem string, monthly_downloads string, github_stars string, github_forks string"
ORGS = "github_org string, project_count string"
ACTIVITY = "map<string,struct<days_since_commit:int,latest_commit_date:string,accessible:boolean,archived:boolean>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV scan; `ord` (a struct that can be compared) is the order of input rows within a file, and of files by path.

    Files are read in splits unless a quoted value goes over lines: then one of its lines has an odd number of quotes.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    whole = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    df = spark.read.schema(schema).option("header", True).option("multiLine", whole).option("escape", '"').option("enforceSchema", False).csv(path)
    # Ids grow within a split, and splits of a file by where they begin.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn("ord", place)


def number(c: str, kind: str = "double"):
    return F.coalesce(F.expr(f"try_cast(`{c}` AS {kind})"), F.lit(0).cast(kind))


def projects(raw: DataFrame) -> DataFrame:
    """Titles trimmed, empty ones dropped; money that isn't a number is 0."""
    return raw.withColumn("title", F.trim("title")).filter("title <> ''").withColumn("total_awarded_usd", number("total_awarded_usd"))


def repos(raw: DataFrame) -> DataFrame:
    """Rows with a URL; the first row of a URL wins."""
    ok = raw.filter("github_url IS NOT NULL AND trim(github_url) NOT IN ('', 'nan')")
    return first_per_key(ok, ["github_url"], "ord").withColumn("total_awarded_usd", number("total_awarded_usd"))


def orgs(raw: DataFrame) -> DataFrame:
    return raw.filter("github_org IS NOT NULL AND github_org <> ''").select("github_org", number("project_count", "bigint").alias("project_count"))


def seed_projects(rows: DataFrame, categories: list[str] | None, statuses: list[str], flag: str = "true") -> DataFrame:
    """Project rows of these categories (None: all) and statuses that pass the flag (a condition) and have a repository URL."""
    ok = F.col("integration_status").isin(*statuses) & F.expr(flag) & (F.coalesce(F.trim("github_url"), F.lit("")) != "")
    return rows.filter(ok if categories is None else ok & F.col("category").isin(*categories))


def org_counts(rows: DataFrame) -> DataFrame:
    """github_org, project_count: the organisations of the rows' repository URLs."""
    org = F.nullif(F.regexp_extract("github_url", r"(?i)github\.com/([^/]+)", 1), F.lit(""))
    return rows.select(org.alias("github_org")).filter("github_org IS NOT NULL").groupBy("github_org").agg(F.count(F.lit(1)).alias("project_count"))


def contributions(raw: DataFrame) -> DataFrame:
    return raw.filter("coalesce(repo_full_name, '') <> '' AND coalesce(contributor_login, '') <> ''").select(F.col("contributor_login").alias("contributor"), as_url(F.col("repo_full_name")).alias("repo"), number("commits_90d", "bigint").alias("commits"), "ord")


def dependencies(raw: DataFrame) -> DataFrame:
    return raw.select("from_repo", "to_package", "ecosystem", F.coalesce(F.col("is_direct").isin("True", "true", "1"), F.lit(False)).alias("is_direct"), "ord")


def adoption(raw: DataFrame) -> DataFrame:
    """Names as URLs, missing numbers 0; the last row of a key wins."""
    named = raw.select(as_url(F.col("repo_full_name")).alias("node_id"), "ecosystem", number("monthly_downloads", "bigint").alias("downloads"), number("github_stars", "bigint").alias("stars"), number("github_forks", "bigint").alias("forks"), "ord")
    return last_per_key(named.filter("node_id IS NOT NULL"), ["node_id"], "ord")


def activity(lines: DataFrame, column: str = "value") -> DataFrame:
    """A JSON object by URL as rows."""
    return lines.select(F.explode(F.from_json(column, ACTIVITY)).alias("repo", "a")).select("repo", "a.*")


def url_list(df: DataFrame, fallback: str = "url") -> DataFrame:
    """Distinct trimmed URLs of github_url, else repo_url, else the fallback column; by first place where there is `ord`."""
    name = next((c for c in ("github_url", "repo_url", fallback) if c in df.columns), None)
    if name is None:
        raise ValueError("no URL column")
    urls = df.withColumn("url", F.trim(F.col(name))).filter("url IS NOT NULL AND url NOT IN ('', 'nan')")
    if "ord" in df.columns:
        return urls.groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord").select("url")
    return urls.select("url").distinct()


def write_guarded(df: DataFrame, path: str, kind: str = "parquet") -> bool:
    """Replace the table at path, unless df is empty; says whether it wrote. The commit protocol makes it all or nothing."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").format(kind).option("header", True).save(path)
    return True


def write_snapshot(snapshot: DataFrame, path: str, label: str = "round_label", date: str = "snapshot_date") -> None:
    """snapshot: one row a round with its label and date, kept as JSON by date and label; a rerun replaces its own rows only."""
    keyed = snapshot.withColumns({"date": F.date_format(date, "yyyy-MM-dd"), "round": slug(F.coalesce(label, F.lit("")))})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "round").json(path)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Contributors of one exported row.
EXPORT_PAGE = 1000


def contributor_pages(rollup: DataFrame, page: int = EXPORT_PAGE) -> DataFrame:
    """rollup (repo, email, display, commits, aliases) as nested rows: repo, part, contributors; a repo with more than
    about `page` contributors has several parts, so no row grows with the table."""
    parts = rollup.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / page).alias("_parts"))
    part = F.pmod(F.xxhash64("email"), F.col("_parts")).cast("int")
    return rollup.join(parts, "repo").withColumn("part", part).groupBy("repo", "part").agg(F.array_sort(F.collect_list(F.struct("email", "display", "commits", "aliases"))).alias("contributors"))


def export_contributors(rollup: DataFrame, path: str) -> None:
    contributor_pages(rollup).write.mode("overwrite").json(path)
