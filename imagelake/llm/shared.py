"""What several operators share: tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_written: list[str] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")  # driver and tasks are one process here
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/imagelake-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the shuffles behind the table aren't needed again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() returned and that nothing reads any more."""
    for table in tables:
        path = _path_of.pop(table, None)
        if path in _written:
            _written.remove(path)
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that cut() wrote; call it once the results that use them are stored."""
    gone = 0
    _path_of.clear()
    while _written:
        gone += _delete(spark, _written.pop())
    return gone


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint when its counted rows, with what a hash table needs for each, stay under limit_bytes; else as it is, to be shuffled."""
    return F.broadcast(df) if rows * (row_bytes + 48) <= limit_bytes else df


def number_rows(df: DataFrame, by: list[str], spread: Column, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """df with a column `name` that numbers the rows of each group `by` from 0 without gaps.

    Rows are counted in hash buckets of `spread`, the counts are summed over the earlier buckets, and rows are ranked
    inside their bucket by `order`: no group is gathered in one task. df is read twice, so it should be cut.
    """
    bucket = f"{name}_bucket"
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(*by, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{name}_first"))
    rank = F.row_number().over(W.partitionBy(*by, bucket).orderBy(*order))
    return (
        rows.withColumn(name, rank)
        .join(first, [*by, bucket])
        .withColumn(name, (F.col(name) + F.col(f"{name}_first") - 1).cast("long"))
        .drop(bucket, f"{name}_first")
    )


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps, which rewire each edge towards the smallest neighbour;
    the number of edges never grows and no neighbourhood is gathered in one place.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current, before = cut(both), None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest neighbour of u
        around = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u itself, goes to the smallest of them
        large = large.where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
