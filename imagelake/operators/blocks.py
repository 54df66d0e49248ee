"""Predicates, headers and reports over blocks (image_id, tier, paddr, data)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from imagelake.functions.scalars import enum_name
from imagelake.kernels import fletcher64_sums, name_hash, valid_blocks

#: Object types below 0x21 by number.
#: The names of object types, by number.
OBJECT_TYPES = {
    0x00: "0", 0x01: "Container Superblock", 0x02: "B-Tree", 0x03: "B-Tree Node", 0x04: "M-Tree",
    0x05: "Spaceman", 0x06: "Spaceman CIB Address Block", 0x07: "Spaceman Chunk Info Block", 0x08: "Spaceman Bitmap", 0x09: "Spaceman Free Queue",
    0x0A: "Extent List Tree", 0x0B: "Object Map", 0x0C: "Checkpoint Map", 0x0D: "Volume Superblock", 0x0E: "Filesystem Tree",
    0x0F: "Block Ref Tree", 0x10: "Snap Meta Tree", 0x11: "NX Reaper", 0x12: "NX Reap List", 0x13: "OMap Snapshot",
    0x14: "EFI Jumpstart", 0x15: "Fusion Middle Tree", 0x16: "Fusion WBC", 0x17: "Fusion WBC List", 0x18: "ER State",
    0x19: "G Bitmap", 0x1A: "G Bitmap Tree", 0x1B: "G Bitmap Block", 0x1C: "ER Recovery Block", 0x1D: "Snap Meta Ext",
    0x1E: "Integrity Meta", 0x1F: "Fext Tree", 0x20: "Reserved 20",
}
B_TREE, B_TREE_NODE = 2, 3


def is_empty(data: Column | str) -> Column:
    """Whether all bytes are zero; true for no bytes."""
    d = F.col(data) if isinstance(data, str) else data
    return d.cast("binary") == F.unhex(F.repeat(F.lit("00"), F.octet_length(d)))


def tail_not_zero(data: Column | str, start: int) -> Column:
    """Whether a byte from `start` (from 0) on isn't zero."""
    d = F.col(data) if isinstance(data, str) else data
    return ~is_empty(F.substring(d.cast("binary"), F.lit(start + 1), F.octet_length(d)))


def _by_length(data: pd.Series, work, empty) -> pd.Series:
    """Applies work to the rows of each length together; empty where the length isn't a multiple of 4, or null."""
    out = np.full(len(data), empty, dtype=object)
    sizes = data.map(lambda x: -1 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes):
        if n > 0 and n % 4 == 0:
            at = np.flatnonzero(sizes == n)
            for part in np.array_split(at, max(1, len(at) * int(n) // (8 << 20) + 1)):
                if len(part):
                    done = work(np.frombuffer(b"".join(data.iloc[part]), np.uint8).reshape(len(part), n))
                    out[part] = np.fromiter(done, dtype=object, count=len(part))
    return pd.Series(out)


def fletcher64(data: Column | str) -> Column:
    """(s1, s2) of a block's little-endian 32-bit words; null for a length that isn't a multiple of 4, or 0."""

    @F.pandas_udf("array<long>")
    def run(data: pd.Series) -> pd.Series:
        return _by_length(data, lambda rows: fletcher64_sums(rows.view("<u4")).astype(np.int64).tolist(), None)

    return run(data)


def verify_block(data: Column | str) -> Column:
    """Whether a block holds its own valid check sum."""

    @F.pandas_udf("boolean")
    def run(data: pd.Series) -> pd.Series:
        return _by_length(data, lambda rows: valid_blocks(rows).tolist(), False).astype(bool)

    return run(data)


def le_number(data: Column, at: int, size: int) -> Column:
    """The unsigned little-endian number of size bytes from at (from 0), as long."""
    h = F.hex(F.substring(data, at + 1, size))
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.conv(swapped, 16, -10).cast("long")


def object_header(blocks: DataFrame) -> DataFrame:
    """blocks with cksum, oid, xid, o_type (low 16 bits), storage flags and o_subtype of the 32 header bytes."""
    d = F.col("data")
    kind = le_number(d, 24, 4)
    return blocks.select("*", F.substring(d, 1, 8).alias("cksum"), le_number(d, 8, 8).alias("oid"), le_number(d, 16, 8).alias("xid"), kind.bitwiseAND(F.lit(0xFFFF).cast("long")).alias("o_type"), kind.bitwiseAND(F.lit(0xFFFF0000).cast("long")).alias("o_flags"), le_number(d, 28, 4).alias("o_subtype"))


def object_type_name(kind: Column | str, subtype: Column | str) -> Column:
    """A type's name; B-trees and their nodes are named by their subtype."""
    k, s = (F.col(c) if isinstance(c, str) else c for c in (kind, subtype))
    k = k.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    return enum_name(F.when(k.isin(B_TREE, B_TREE_NODE), s.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))).otherwise(k), OBJECT_TYPES, "Unknown")


def classify(blocks: DataFrame) -> DataFrame:
    """blocks with class: Empty, Data (no valid check sum) or Metadata."""
    return blocks.withColumn("class", F.when(is_empty("data"), "Empty").when(verify_block("data"), "Metadata").otherwise("Data"))


def collapse_runs(rows: DataFrame, keys: list[str], order: str, value: str, buckets: Column | None = None) -> DataFrame:
    """Rows that start a run: their value differs from the row before, by order within keys.

    With buckets, a non-decreasing function of order, each bucket is a window of its own and the last value of the
    bucket before comes from a row per bucket, so that a whole image isn't one task.
    """
    if buckets is None:
        before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
        return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")
    dealt = rows.withColumn("_bucket", buckets)
    inside = W.partitionBy(*keys, "_bucket").orderBy(order)
    last = dealt.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(value), order).alias("_last"))
    edge = last.withColumn("_edge", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    marked = dealt.withColumn("_n", F.row_number().over(inside)).withColumn("_before", F.lag(F.struct(value)).over(inside)).join(edge, [*keys, "_bucket"])
    before = F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_before"))
    return marked.where(before.isNull() | ~before.eqNullSafe(F.struct(value))).drop("_bucket", "_n", "_before", "_edge")


def block_map(classified: DataFrame, bucket_blocks: int = 1 << 20) -> DataFrame:
    """The map of an image: each used block, and one row for each run of empty ones; none before the first used block."""
    keys = ["image_id", "tier"]
    state = classified.withColumn("_run", F.when(F.col("class") == "Empty", F.lit(-1).cast("long")).otherwise(F.col("paddr")))
    firsts = classified.where("class <> 'Empty'").groupBy(*keys).agg(F.min("paddr").alias("_first"))
    used = state.join(F.broadcast(firsts), keys).where("paddr >= _first").drop("_first")
    return collapse_runs(used, keys, "paddr", "_run", F.call_function("div", F.col("paddr"), F.lit(bucket_blocks).cast("long"))).drop("_run")


def block_census(rows: DataFrame, keys: list[str], xid: str, block_size: int = 4096) -> DataFrame:
    """Blocks, bytes and the range of xids for each level of keys, from all of them to none (rollup)."""
    return rows.rollup(*keys).agg(F.count("*").alias("blocks"), (F.count("*") * block_size).alias("bytes"), F.min(xid).alias("min_xid"), F.max(xid).alias("max_xid"))


def hexdump(data: Column | str, line: int = 16) -> Column:
    """array<struct<offset, hex, text>>: lines of hexadecimal digits and of printable ASCII, others as a dot."""
    d = (F.col(data) if isinstance(data, str) else data).cast("binary")
    n = F.octet_length(d)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(line))).otherwise(F.array().cast("array<int>"))

    def one(at: Column) -> Column:
        part = F.substring(d, at + 1, F.lit(line))
        pairs = F.rtrim(F.regexp_replace(F.hex(part), "(..)", "$1 "))
        text = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".")
        return F.struct(at.alias("offset"), pairs.alias("hex"), text.alias("text"))

    return F.transform(starts, one)


def filename_hash(fold: bool = False):
    """A pandas UDF: the hash word of file names, each different name of a batch hashed once."""

    @F.pandas_udf("long")
    def hashed(names: pd.Series) -> pd.Series:
        known = {x: name_hash(x, fold) for x in names.dropna().unique()}
        return names.map(known).astype("Int64")

    return hashed
