"""Version resolution: what a log of (key, version, ...) held at some version.

All operators take any DataFrame and column names. Resolving a whole table is one partial aggregation and one shuffle by
key; a hot key with a long chain of versions is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from imagelake.sources.tables import checkpoint_table

MODES = ("EQ", "LE", "LT", "GE", "GT")


def _names(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def resolve_version(log: DataFrame, key: str | list[str], version: str, at: int | Column | None = None) -> DataFrame:
    """The row of each key with the greatest version, of those up to `at`. Rows with equal key and version: the greatest row."""
    keys = _names(key)
    rows = log.where(F.col(version) <= at) if at is not None else log
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_row")
    return rows.where(F.col(version).isNotNull()).groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*log.columns)


def drop_deleted(resolved: DataFrame, deleted: Column) -> DataFrame:
    """Rows not marked deleted; only after resolution, or an older version would come back."""
    return resolved.where(~F.coalesce(deleted, F.lit(False)))


def asof_lookup(probes: DataFrame, log: DataFrame, key: str, version: str, probe_version: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the log's row of the same key with the greatest version up to the probe's, or nulls.

    Probes and log are laid in one ordered sequence per key and the last log row is carried on, so that a key with many
    probes and many versions doesn't multiply. A probe with a null key or version finds nothing.
    """
    cells = F.struct(*values)
    left = probes.select(F.struct("*").alias("_probe"), F.col(key).alias("_key"), F.col(probe_version).alias("_version"), F.lit(None).cast(log.select(cells.alias("v")).schema["v"].dataType).alias("_values"), F.lit(1).alias("_side"))
    right = log.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.col(key).alias("_key"), F.col(version).alias("_version"), cells.alias("_values"), F.lit(0).alias("_side"))
    order = W.partitionBy("_key").orderBy("_version", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = left.unionByName(right).withColumn("_found", F.last("_values", ignorenulls=True).over(order))
    hit = F.col("_key").isNotNull() & F.col("_version").isNotNull()
    return found.where("_side = 1").select("_probe.*", *[F.when(hit, F.col("_found")[c]).alias(f"found_{c}") for c in values])


def neighbor_lookup(probes: DataFrame, table: DataFrame, probe: str, value: str, mode: str, range_rows: int = 1 << 19) -> DataFrame:
    """probes with `neighbor`: the value of table that stands in the relation `mode` to the probe, or null if none does.

    Values and probes are dealt to ranges in one order, backwards for GE and GT, and a running window carries the last value on.
    What lies before a range comes from the ranges' last values, a row a range. EQ is LE, where that finds the probe itself. A range has
    about range_rows rows however large the input is, and equal ones are dealt to several, so that no task grows with the
    input or with a frequent probe.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    up = mode[0] == "G"
    kind = table.schema[value].dataType
    wide = probes.select(F.coalesce(F.col(probe), F.lit(None).cast(kind)).alias("v")).schema["v"].dataType  # in which the two are compared
    first = F.lit(2 if mode[1] == "T" else 0)  # an equal value comes before the probe or behind it
    asked = probes.select(F.col(probe).cast(wide).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_hit"), F.struct("*").alias("_probe"))
    rows = table.where(F.col(value).isNotNull()).select(F.col(value).cast(wide).alias("_v"), first.alias("_side"), F.col(value).alias("_hit"), F.lit(None).cast(asked.schema["_probe"].dataType).alias("_probe"))
    n = max(table.sparkSession.sparkContext.defaultParallelism, -(-(probes.count() + table.count()) // range_rows))
    order = [F.desc("_v") if up else F.asc("_v"), F.asc("_side")]
    both = asked.unionByName(rows).withColumn("_place", F.monotonically_increasing_id())
    dealt = checkpoint_table(both.repartitionByRange(n, *order, "_place").drop("_place").withColumn("_b", F.spark_partition_id()))  # written once, so the ranges stay
    limits = dealt.groupBy("_b").agg((F.min if up else F.max)("_hit").alias("_limit"))
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    far = limits.select("_b", F.last("_limit", ignorenulls=True).over(earlier).alias("_far"))
    running = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = dealt.repartitionById(n, F.col("_b")).withColumn("_near", F.last("_hit", ignorenulls=True).over(running)).where("_side = 1")
    near = F.coalesce("_near", "_far")
    found = found.join(F.broadcast(far), "_b")  # a row a range
    hit = near.cast(wide) == F.col("_v") if mode == "EQ" else F.col("_v").isNotNull()
    return found.select("_probe.*", F.when(hit, near).alias("neighbor"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: str | list[str]) -> DataFrame:
    """(keys, change, before struct, after struct): rows added, removed or changed between two resolved states."""
    names = _names(keys)
    rest = [c for c in before.columns if c not in names]
    a = before.select(*[F.col(k).alias(f"_a_{k}") for k in names], F.struct(*rest).alias("before"), F.lit(True).alias("_in_a"))
    b = after.select(*[F.col(k).alias(f"_b_{k}") for k in names], F.struct(*rest).alias("after"), F.lit(True).alias("_in_b"))
    same_key = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in names]
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    both = a.join(b, same_key, "full_outer").withColumn("change", change).where("change is not null")
    return both.select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in names], "change", "before", "after")


def as_of_snapshot(log: DataFrame, snapshots: DataFrame, key: str, version: str, snapshot_version: str, deleted: Column | None = None) -> DataFrame:
    """The state at each snapshot's version: (snapshot columns, log row). Few snapshots, so each log row meets each later one.

    Aggregated before the shuffle, by snapshot and key.
    """
    rest = [c for c in log.columns if c != key]
    few = F.broadcast(snapshots.withColumnRenamed(snapshot_version, "_at"))  # snapshots of a volume, bounded by its owner
    paired = log.join(few, F.col(version) <= F.col("_at"))
    extra = [c for c in snapshots.columns if c != snapshot_version]
    newest = paired.groupBy("_at", *extra, key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    out = newest.select(F.col("_at").alias(snapshot_version), *extra, key, "_row.*")
    return drop_deleted(out, deleted) if deleted is not None else out
