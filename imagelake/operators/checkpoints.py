"""Superblocks, checkpoint rings and maps, volumes and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.functions.scalars import role_names, uuid_string
from imagelake.layouts import LAYOUTS
from imagelake.operators.blocks import le_number


def latest_superblock(objects: DataFrame, keys: list[str], at_xid: int | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """The object with the greatest xid of each key, or with exactly at_xid; of equal ones the first (least paddr).

    fallback (keys and the same columns, e.g. block 0) fills in where none is found.
    """
    rows = objects if at_xid is None else objects.where(F.col("xid") == at_xid)
    rest = [c for c in objects.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("xid", -F.col("paddr"))).alias("_row"))
    found = best.select(*keys, "_row.*")
    if fallback is None:
        return found
    return found.unionByName(fallback.select(*found.columns).join(found, keys, "left_anti"))


def ring_slots(rows: DataFrame, base: str, index: str, length: str, blocks: str) -> DataFrame:
    """A row for each used slot of a ring buffer: slot number and address base + (index + slot) mod blocks."""
    slots = rows.where((F.col(length) > 0) & (F.col(blocks) > 0)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1)).alias("slot"))
    return slots.withColumn("address", F.col(base).cast("long") + F.pmod(F.col(index).cast("long") + F.col("slot"), F.col(blocks).cast("long")))


def checkpoint_lookup(maps: DataFrame, oids: DataFrame, entries: str = "mappings") -> DataFrame:
    """oids with paddr, size and xid of their first mapping, by map block and place in it; nulls where there is none.

    maps: (block, xid, mappings array<struct<oid, paddr, size>>).
    """
    rows = maps.select("block", "xid", F.posexplode(entries).alias("_pos", "_m"))
    first = rows.groupBy(F.col("_m.oid").alias("oid")).agg(F.min_by(F.struct(F.col("_m.paddr").alias("paddr"), F.col("_m.size").alias("size"), "xid"), F.struct("block", "_pos")).alias("_f"))
    return oids.join(first, "oid", "left").select(*oids.columns, "_f.paddr", "_f.size", "_f.xid")


def volume_oids(superblocks: DataFrame) -> DataFrame:
    """(superblock columns but fs_oids, volume, oid): a row for each slot that isn't 0."""
    rest = [c for c in superblocks.columns if c != "fs_oids"]
    return superblocks.select(*rest, F.posexplode("fs_oids").alias("volume", "oid")).where("oid <> 0")


#: The magic numbers of a container's and of a volume's superblock.
CONTAINER_MAGIC, VOLUME_MAGIC = int.from_bytes(b"NXSB", "little"), int.from_bytes(b"APSB", "little")


def container_slots(superblocks: DataFrame) -> DataFrame:
    """(image_id, xid, block_size, volume, oid) of superblocks (image_id, xid, data): a row for each volume slot in use."""
    d = F.col("data")
    oids = F.transform(F.sequence(F.lit(0), F.least(le_number(d, 180, 4), F.lit(100)).cast("int")), lambda i: le_number(d, 184 + 8 * i, 8))
    slots = superblocks.select("image_id", "xid", le_number(d, 36, 4).alias("block_size"), F.slice(oids, 1, F.size(oids) - 1).alias("fs_oids"))
    return volume_oids(slots)


def volumes(superblocks: DataFrame, log: DataFrame, blocks: DataFrame, at_xid: int | None = None) -> DataFrame:
    """The volumes of containers: (image_id, volume, oid, paddr, status, name, uuid, and the fields that volume_summary reads).

    superblocks are container superblocks (image_id, xid, data), log the object map (image_id, oid, xid, flags, paddr), blocks
    (image_id, tier, paddr, data, class) those of the whole image. Each slot is resolved as of at_xid, or of its superblock's own xid. A slot that leads
    nowhere stays, with status `no map entry`, `deleted`, `no block`, `bad check sum` or `wrong magic`; a volume read is `ok`.
    """
    slots = container_slots(superblocks)
    upto = F.lit(at_xid).cast("long") if at_xid is not None else F.col("at")
    asked = slots.select("image_id", "oid", F.col("xid").alias("at")).distinct()
    known = log.select("image_id", "oid", F.col("xid").alias("map_xid"), "flags", "paddr").join(asked, ["image_id", "oid"]).where(F.col("map_xid") <= upto)
    newest = known.groupBy("image_id", "oid", "at").agg(F.max_by(F.struct("flags", "paddr"), "map_xid").alias("m"))
    found = slots.withColumnRenamed("xid", "at").join(newest, ["image_id", "oid", "at"], "left")
    found = found.select("image_id", "at", "block_size", "volume", "oid", F.col("m.flags").alias("map_flags"), F.col("m.paddr").alias("paddr"))
    read = found.join(blocks.where("tier = 'main'").select("image_id", "paddr", "data", "class"), ["image_id", "paddr"], "left")
    d = F.col("data")
    deleted = F.col("map_flags").bitwiseAND(F.lit(1).cast("long")) != 0
    status = F.when(F.col("paddr").isNull(), "no map entry").when(deleted, "deleted").when(d.isNull(), "no block").when(F.col("class") != "Metadata", "bad check sum").when(le_number(d, 32, 4) != VOLUME_MAGIC, "wrong magic").otherwise("ok")
    fields = [(f, at, n) for f, at, n in LAYOUTS["volume"][1] if n in (1, 2, 4, 8) and f != "magic"]
    ok = lambda value: F.when(F.col("status") == "ok", value)
    text = F.regexp_extract(F.substring(d, 705, 256).cast("string"), "^[^\\x00]*", 0)
    return read.withColumn("status", status).select(
        "image_id", "at", "block_size", "volume", "oid", "paddr", "status", ok(text).alias("name"), ok(uuid_string(F.substring(d, 241, 16))).alias("uuid"), *[ok(le_number(d, at, n)).alias(f) for f, at, n in fields]
    )


def volume_summary(volumes: DataFrame, block_size: int) -> DataFrame:
    """Names, roles, case sensitivity, bytes used, encryption and counts of each volume."""
    flag = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit).cast("long")) != 0
    return volumes.select(
        "volume",
        "name",
        role_names("role").alias("roles"),
        (~flag("incompat", 1)).alias("case_sensitive"),
        (F.col("alloc_count") * block_size).alias("bytes_used"),
        (~flag("fs_flags", 1)).alias("encrypted"),
        "num_files",
        "num_dirs",
        "num_symlinks",
        "num_snapshots",
    )


def snapshots(records: DataFrame, is_snapshot: Column) -> DataFrame:
    """Snapshot rows by xid."""
    return records.where(is_snapshot).orderBy("xid")
