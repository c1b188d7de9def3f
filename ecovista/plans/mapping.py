"""The star-schema tables as an ecosystem: the mapping by which the queries and their SQL twins see the given tables."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart, cut
from ..operators import graph, incremental
from .ecosystem import Ecosystem

CONTRIBUTION_DAYS = 365


class Model(Ecosystem):
    """An ecosystem whose inputs are derived from the tables of one folder."""

    _known: dict[tuple, Model] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config = DEFAULT, days_back: int = 0):
        """days_back: the ecosystem as it was so many days before the last commit."""
        self.spark, self.dir, self.config, self.days_back = spark, sf_dir, config, days_back

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Model:
        """One model for each state of a folder in an application: files written anew make a new one."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        states = []
        for name in ("part", "lineitem"):  # what an ecosystem is derived from
            at = path(f"{sf_dir}/{name}.parquet")
            files = at.getFileSystem(spark._jsc.hadoopConfiguration())
            found = files.globStatus(path(at, "*")) or files.globStatus(at) or []
            states += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
        key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(states)))
        if key not in cls._known:
            cls._known = {k: m for k, m in cls._known.items() if k[:2] != key[:2]}
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def day(self) -> date:
        """The day that ages are counted to."""
        return self.table("lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0] - timedelta(days=self.days_back)

    @property
    def as_of(self):
        return F.lit(self.day)

    @cached_property
    def commits(self) -> DataFrame:
        rows = self.table("lineitem").select(F.col("l_partkey").alias("repo"), F.col("l_suppkey").alias("contributor"), F.to_date("l_shipdate").alias("committed_at"), F.col("l_quantity").alias("quantity"))
        return rows.filter(F.col("committed_at") <= self.as_of) if self.days_back else rows

    @cached_property
    def ages(self) -> DataFrame:
        return self.commits.groupBy("repo").agg(F.datediff(self.as_of, F.max("committed_at")).cast("long").alias("age"))

    @cached_property
    def contributions(self) -> DataFrame:
        """Of recent commits only, which are left before they are grouped."""
        recent = self.commits.filter(F.col("committed_at") >= F.date_sub(self.as_of, CONTRIBUTION_DAYS))
        return cut(recent.groupBy("repo", "contributor").agg(F.count(F.lit(1)).alias("commits"), F.min("committed_at").alias("first_date"), F.max("committed_at").alias("last_date")))

    @cached_property
    def signals(self) -> DataFrame:
        pairs = self.commits.groupBy("repo", "contributor").agg(F.count(F.lit(1)).alias("stars"), F.sum("quantity").alias("downloads"))
        return pairs.groupBy(F.col("repo").alias("node_id")).agg(F.sum("stars").alias("stars"), F.count(F.lit(1)).alias("forks"), F.sum("downloads").cast("long").alias("downloads"))

    @cached_property
    def nodes(self) -> DataFrame:
        p = self.table("part").join(apart(self.ages), F.col("p_partkey") == F.col("repo"), "left")
        key = F.col("p_partkey")
        base = p.select(
            key.alias("node_id"), F.when(key % 10 == 0, "ExternalRepo").otherwise("Repo").alias("node_type"), F.concat("p_brand", F.lit("/"), "p_type").alias("project"),
            F.when((key % 100 == 0) | (key % 97 == 5), None).otherwise(F.col("age")).alias("days_since_commit"), (F.col("p_size") == 50).alias("archived"),
        )
        active = F.coalesce((F.col("days_since_commit") <= self.config.active_window_days) & ~F.col("archived"), F.lit(False))
        return cut(graph.project_active(base.withColumn("active", active), self.config))

    @cached_property
    def all_edges(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("src"))
        loop = self.spark.range(1).select(F.lit(2).cast("long").alias("src"), F.lit(11).cast("long").alias("dst"))  # closes a cycle
        return cut(p.withColumn("dst", F.expr("src div 2")).unionAll(p.withColumn("dst", F.expr("src div 3"))).unionAll(loop).filter("src <> dst").distinct())

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("part").groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("title")).agg(F.sum(F.when(F.col("p_size") > 45, F.col("p_retailprice")).otherwise(0.0).cast("decimal(18,2)")).cast("double").alias("total_awarded_usd"))

    @cached_property
    def refreshed(self) -> incremental.Views:
        """The views after some ages have changed, some nodes and edges have gone and others come."""
        key = F.col("node_id")
        before = incremental.Views(self.nodes, self.all_edges, self.edges, incremental.Closure.of(self.closure), self.criticality.select("node_id", "criticality"))
        aged = self.nodes.filter(key % 50 == 7).withColumns({"days_since_commit": F.when(key % 100 == 7, 400).otherwise(1).cast("long"), "archived": F.lit(False), "active": key % 100 == 57})
        changes = aged.filter(key % 211 != 13).withColumn("deleted", F.lit(False)).unionByName(self.nodes.filter(key % 211 == 13).withColumn("deleted", F.lit(True))).drop("retained")
        new = self.nodes.filter(key % 37 == 5).select(key.alias("src"), F.expr("node_id div 7").alias("dst")).filter("dst > 0")
        edge_changes = self.all_edges.filter("src % 40 = 3").join(new, ["src", "dst"], "left_anti").withColumn("deleted", F.lit(True)).unionByName(new.withColumn("deleted", F.lit(False)))
        return incremental.refresh(before, changes, edge_changes, self.config)
