"""Intermediate tables in the cluster's shared folder, and connected components over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}
#: Shuffle files go as soon as the query that wrote them ends, not when the driver happens to collect its garbage.
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and the master is local (as in tests) one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _UNSET.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="brindle-"))


class Scratch:
    """Tables written once and read many times.

    A written table cuts lineage as a checkpoint does: if an executor is lost, later stages
    read the files again. drop() removes tables that nothing reads any more; a table's shuffle files go once it is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:02d}-{name}"
        before = self.spark.conf.get(_CLEAR, None)
        self.spark.conf.set(_CLEAR, "true")
        try:
            df.select("*").write.parquet(path)  # a new plan, which sees the setting
        finally:
            self.spark.conf.set(_CLEAR, before) if before else self.spark.conf.unset(_CLEAR)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is one aggregation to the smallest
    neighbour and one join on the node, so no neighbour list is ever gathered, and AQE can
    split the join of a hub. Nulls and self loops are ignored; no edges give an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = scratch.save(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.union(low.select("a", "m")).distinct(), "stars")
        scratch.drop(e)
        e = after
    out = scratch.save(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct()), "components")
    scratch.drop(e)
    return out


def _is_stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or points to one centre."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return per_node.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0
