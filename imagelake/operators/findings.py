"""Anomalies of all kinds as one table (kind, object_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.operators.blocks import filename_hash, le_number, object_type_name
from imagelake.operators.namespace import COMPRESSED, COMPRESSION_ATTRIBUTE, METHODS

#: Fixed value: the magic number at the start of a compression attribute.
COMPRESSION_MAGIC = int.from_bytes(b"fpmc", "little")


def missing_reference(rows: DataFrame, key: str, targets: DataFrame, target_key: str, kind: str, object_id: str | None = None) -> DataFrame:
    """Rows whose key no target has: an anti join."""
    gone = rows.join(targets.select(F.col(target_key).alias("_t")).distinct(), F.col(key) == F.col("_t"), "left_anti")
    return gone.select(F.lit(kind).alias("kind"), F.col(object_id or key).cast("long").alias("object_id"), F.col(key).cast("string").alias("detail"))


def failed_check(rows: DataFrame, bad: Column, kind: str, object_id: str, detail: Column) -> DataFrame:
    return rows.where(bad).select(F.lit(kind).alias("kind"), F.col(object_id).cast("long").alias("object_id"), detail.cast("string").alias("detail"))


def findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _row(rows: DataFrame, kind: Column | str, object_id: str, detail: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select("image_id", kind.alias("kind"), F.col(object_id).cast("long").alias("object_id"), detail.cast("string").alias("detail")).where("kind is not null")


def map_findings(references: DataFrame, newest: DataFrame, blocks: DataFrame) -> DataFrame:
    """What references (image_id, oid) lead to: no map entry, a deleted one, no block, or one whose check sum is wrong.

    newest is the resolved object map (image_id, oid, flags, paddr), blocks the classified blocks (image_id, paddr, class).
    """
    asked = references.select("image_id", "oid").distinct()
    found = asked.join(newest.select("image_id", "oid", "flags", "paddr"), ["image_id", "oid"], "left")
    found = found.join(blocks.select("image_id", "paddr", "class"), ["image_id", "paddr"], "left")
    gone = F.col("flags").bitwiseAND(F.lit(1).cast("long")) != 0
    kind = F.when(F.col("paddr").isNull(), "no map entry").when(gone, "deleted map entry referenced").when(F.col("class").isNull(), "no block").when(F.col("class") != "Metadata", "bad check sum")
    return _row(found, kind, "oid", F.col("paddr"))


def compression_findings(inodes: DataFrame, xattrs: DataFrame) -> DataFrame:
    """Files marked compressed without the attribute, attributes with a wrong magic number, and unknown methods."""
    marked = inodes.where(F.col("bsd_flags").cast("long").bitwiseAND(F.lit(COMPRESSED).cast("long")) != 0)
    headers = xattrs.where(F.col("name") == COMPRESSION_ATTRIBUTE)
    bare = _row(marked.join(headers.select("image_id", "ino"), ["image_id", "ino"], "left_anti"), "compressed without attribute", "ino", F.col("bsd_flags"))
    magic, algo = le_number(F.col("data"), 0, 4), le_number(F.col("data"), 4, 4)
    kind = F.when(F.octet_length("data") < 16, "short compression header").when(magic != COMPRESSION_MAGIC, "bad compression magic").when(~algo.isin(*METHODS), "unknown compression method")
    return bare.unionByName(_row(headers.where("data is not null"), kind, "ino", algo))


def type_findings(headers: DataFrame) -> DataFrame:
    """Blocks (image_id, paddr, o_type, o_subtype) of an unknown object type."""
    kind = F.when(object_type_name("o_type", "o_subtype") == "Unknown", "unknown object type")
    return _row(headers, kind, "paddr", F.concat_ws("/", "o_type", "o_subtype"))


def name_findings(entries: DataFrame, fold: bool = False) -> DataFrame:
    """Directory entries (image_id, name, name_hash, file_id) whose stored hash isn't their name's."""
    hashed = entries.where("name_hash is not null").withColumn("_hash", F.shiftrightunsigned(filename_hash(fold)("name"), 10))
    return _row(hashed.where("_hash <> name_hash"), "wrong name hash", "file_id", F.col("name"))


def reference_findings(rows: DataFrame, key: str, targets: DataFrame, target_key: str, kind: str) -> DataFrame:
    """Rows of an image whose key no target of the same image has, e.g. entries without an inode or extents without a stream."""
    wanted = targets.select("image_id", F.col(target_key).alias("_t")).distinct()
    gone = rows.join(wanted.withColumnRenamed("image_id", "_i"), (F.col("image_id") == F.col("_i")) & (F.col(key) == F.col("_t")), "left_anti")
    return _row(gone, kind, key, F.col(key))
