"""Global ranks without a single-task sort.

Ties collapse to one row per value, values are dealt out by range, and only one total per range partition comes to
the driver; running sums stay within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import apart, cut


def value_ranks(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(table of value, less_than, ties, number of rows): how many rows have a smaller value, how many this one."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(parts, "value").withColumn("range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in dealt.groupBy("range").agg(F.sum("ties").alias("n")).orderBy("range").collect():  # one row for each range
        offsets += [F.lit(r["range"]), F.lit(before)]
        before += r["n"]
    base = F.element_at(F.create_map(*offsets), F.col("range")) if offsets else F.lit(0)
    inner = F.sum("ties").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.select("value", (base + F.coalesce(inner, F.lit(0))).alias("less_than"), "ties"), before


def _with(df: DataFrame, value: str, name: str, make) -> DataFrame:
    ranks, n = value_ranks(df, value)
    ranks = ranks.select(F.col("value").alias("_value"), make(F.col("less_than"), F.col("ties"), n).alias(name))
    return df.join(apart(ranks), F.col(value) == F.col("_value"), "left").drop("_value")


def exclusive_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of rows with a smaller value, in percent: the least gets 0, all get less than 100."""
    return _with(df, value, name, lambda less, ties, n: less / F.lit(max(n, 1)) * 100)


def average_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of ties, in percent: a single row gets 100."""
    return _with(df, value, name, lambda less, ties, n: (less + (ties + 1) / 2) / F.lit(max(n, 1)) * 100)


def average_percentiles(df: DataFrame, columns: list[str], suffix: str = "_pct") -> DataFrame:
    """average_percentile of several columns of whole numbers, with one pass over the rows and one deal of the values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("long").alias("_value")) for c in columns])
    counts = df.select(F.inline(pairs)).filter("_value IS NOT NULL").groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("ties"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(parts, "_column", "_value").withColumn("_range", F.spark_partition_id()))
    before: dict = dict.fromkeys(columns, 0)
    offsets = []
    for r in dealt.groupBy("_column", "_range").agg(F.sum("ties").alias("n")).orderBy("_column", "_range").collect():  # a row for each range, and one more for each column
        offsets.append((r["_column"], r["_range"], before[r["_column"]]))
        before[r["_column"]] += r["n"]
    base = df.sparkSession.createDataFrame(offsets, "_column string, _range int, _before long")
    inner = F.sum("ties").over(Window.partitionBy("_column", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1))
    ranks = cut(dealt.join(F.broadcast(base), ["_column", "_range"]).select("_column", "_value", (F.col("_before") + F.coalesce(inner, F.lit(0)) + (F.col("ties") + 1) / 2).alias("_rank")))
    for c in columns:
        own = ranks.filter(F.col("_column") == c).select(F.col("_value").alias("_v"), (F.col("_rank") / F.lit(max(before[c], 1)) * 100).alias(f"{c}{suffix}"))
        df = df.join(apart(own), F.col(c) == F.col("_v"), "left").drop("_v")
    return df


def truncated_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    return _with(df, value, name, lambda less, ties, n: F.floor(less / F.lit(max(n, 1)) * 100).cast("long"))


def funded_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """Exclusive percentile among rows with a value over 0; 0 for the others."""
    ranks, n = value_ranks(df.filter(F.col(value) > 0), value)
    ranks = ranks.select(F.col("value").alias("_value"), (F.col("less_than") / F.lit(max(n, 1)) * 100).alias(name))
    return df.join(apart(ranks), F.col(value) == F.col("_value"), "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(0.0)))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: gini of the values (null for none or a sum of 0). Ties share a value, so their places can be summed."""
    ranks, n = value_ranks(df, value)
    i_sum = F.col("ties") * F.col("less_than") + F.col("ties") * (F.col("ties") + 1) / 2
    total = F.sum(F.col("value") * F.col("ties"))
    return ranks.agg((F.sum(F.col("value") * (2 * i_sum - F.col("ties") * (n + 1))) / F.nullif(F.lit(n) * total, F.lit(0.0))).alias("gini"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: total, median, max and gini of the values."""
    whole = df.agg(F.sum(value).alias("total"), F.max(value).alias("max"))
    return whole.crossJoin(quantile(df, value, 0.5, "median")).crossJoin(gini(df, value))  # one row each


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n, pct."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(total).select("value", "n", F.round(100 * F.col("n") / F.col("_total"), 2).alias("pct"))  # total is one row


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least order (not null); one row a key leaves each task, whatever a key holds."""
    return _edge_of_key(df, keys, F.min_by(F.struct(*df.columns), order))


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _edge_of_key(df, keys, F.max_by(F.struct(*df.columns), order))


def _edge_of_key(df: DataFrame, keys: list[str], best: Column) -> DataFrame:
    return df.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the quantile of the values (between two of them in proportion; null for none), read from the value ranks."""
    ranks, n = value_ranks(df, value)
    at = q * max(n - 1, 0)
    low = int(at)
    holds = lambda i: (F.col("less_than") <= i) & (F.lit(i) < F.col("less_than") + F.col("ties"))
    pick = lambda i: F.max(F.when(holds(i), F.col("value").cast("double")))
    return ranks.agg(pick(low).alias("_a"), pick(min(low + 1, max(n - 1, 0))).alias("_b")).select((F.col("_a") + (F.col("_b") - F.col("_a")) * (at - low)).alias(name))


def place(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with each row's place within its group under a total order: rows are dealt out by range, and one count for each
    group and range goes to the driver, so no task sorts a whole group."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    before: dict = {}
    offsets = []
    for r in dealt.groupBy(group, "_range").count().orderBy(group, "_range").collect():  # a row for each range, and one more for each group
        offsets.append((r[group], r["_range"], before.get(r[group], 0)))
        before[r[group]] = before.get(r[group], 0) + r["count"]
    base = df.sparkSession.createDataFrame(offsets, f"_group {df.schema[group].dataType.simpleString()}, _part int, _before long")
    w = Window.partitionBy(group, "_range").orderBy(*order)
    placed = dealt.join(F.broadcast(base), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))  # null is a group too
    return placed.withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_range", "_group", "_part", "_before")


def leading(df: DataFrame, value: str, key: str, k: int, nulls_first: bool = False, digits: int | None = None) -> DataFrame:
    """The k rows of the greatest value, in that order (ties: least key); each task passes on k rows at most.

    Rows without a value are left out, or come first with nulls_first.  digits: values that are equal after rounding tie.
    """
    by = F.col(value) if digits is None else F.round(value, digits)
    rows = df if nulls_first else df.filter(F.col(value).isNotNull())
    return rows.orderBy(by.desc_nulls_first() if nulls_first else by.desc(), key).limit(k)


def top(df: DataFrame, value: str, key: str, k: int, *more: str) -> DataFrame:
    """One row: `top`, the k rows of the greatest value (ties: least key) as an array of structs in that order."""
    best = df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(k)
    rows = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("_minus"), F.col(key), F.col(value), *[F.col(c) for c in more])))  # k rows
    return best.agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in (key, value, *more)])).alias("top"))
