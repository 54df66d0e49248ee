"""Extents: byte ranges, file contents and shared blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT_COLUMNS = ("file_id", "logical_addr", "length", "phys_block", "crypto_id")


def all_extents(file_extents: DataFrame, sealed_extents: DataFrame | None = None) -> DataFrame:
    """Extents of both kinds by private id; those of a sealed volume have no crypto id."""
    plain = file_extents.select(*EXTENT_COLUMNS)
    if sealed_extents is None:
        return plain
    return plain.unionByName(sealed_extents.select(F.col("private_id").alias("file_id"), "logical_addr", "length", "phys_block", F.lit(0).cast("long").alias("crypto_id")))


def read_ranges(requests: DataFrame, extents: DataFrame, block_size: int, bin_size: int = 1 << 30) -> DataFrame:
    """The pieces of each request (request_id, file_id, offset, size): one per extent that it overlaps.

    (request_id, file_id, offset, size of the piece, phys_block and skip inside it, hole). Physical block 0 is a hole.
    Both sides are dealt to bins of the file, so a giant file's extents don't meet all its requests at one key;
    a pair counts in the bin where its overlap begins.
    """
    spread = lambda at, n: F.explode(F.sequence(F.call_function("div", at, F.lit(bin_size).cast("long")), F.call_function("div", at + n - 1, F.lit(bin_size).cast("long")))).alias("_bin")
    r = requests.where("size > 0").select("request_id", F.col("file_id").alias("_file"), F.col("offset").alias("_offset"), F.col("size").alias("_size"), spread(F.col("offset"), F.col("size")))
    e = extents.where("length > 0").select("*", spread(F.col("logical_addr"), F.col("length"))).withColumnRenamed("_bin", "_e_bin")
    start, end = F.greatest("_offset", "logical_addr"), F.least(F.col("_offset") + F.col("_size"), F.col("logical_addr") + F.col("length"))
    same = (F.col("_file") == F.col("file_id")) & (F.col("_bin") == F.col("_e_bin")) & (start < end) & (F.call_function("div", start, F.lit(bin_size).cast("long")) == F.col("_bin"))
    inside = start - F.col("logical_addr")
    return r.join(e, same).select(
        "request_id",
        "file_id",
        start.alias("offset"),
        (end - start).alias("size"),
        F.when(F.col("phys_block") != 0, F.col("phys_block") + F.call_function("div", inside, F.lit(block_size).cast("long"))).otherwise(F.lit(0).cast("long")).alias("phys_block"),
        F.pmod(inside, F.lit(block_size).cast("long")).alias("skip"),
        (F.col("phys_block") == 0).alias("hole"),
    )


def explode_extents(extents: DataFrame, block_size: int) -> DataFrame:
    """(file_id, file_block, paddr, crypto_unit): a row per block of each extent; an extent of length 0 has none."""
    blocks = F.ceil(F.col("length") / block_size).cast("long")
    rows = extents.where("length > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_i"))
    return rows.select(
        "file_id",
        (F.call_function("div", F.col("logical_addr"), F.lit(block_size).cast("long")) + F.col("_i")).alias("file_block"),
        F.when(F.col("phys_block") != 0, F.col("phys_block") + F.col("_i")).otherwise(F.lit(0).cast("long")).alias("paddr"),
        F.when(F.col("crypto_id") != 0, F.col("crypto_id") + F.col("_i")).otherwise(F.lit(0).cast("long")).alias("crypto_unit"),
    )


def concat_pieces(pieces: DataFrame, key: str | list[str], order: str, data: str, limit: int = 1 << 30) -> DataFrame:
    """(key, data): a key's pieces in order, joined. A key of more than limit bytes raises an error: it wouldn't fit a row."""
    keys = [key] if isinstance(key, str) else list(key)
    size = F.sum(F.octet_length(data))
    fits = F.when(size > limit, F.raise_error(F.concat(F.lit(f"more than {limit} bytes: "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    sizes = pieces.groupBy(*keys).agg(fits.cast("boolean").alias("_fits")).where("_fits").select(*keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    joined = pieces.join(sizes, keys, "left_semi").groupBy(*keys).agg(ordered.alias("_p"))
    # hex digits join in linear time; concat in a fold would copy what is done again and again
    return joined.select(*keys, F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["d"])), "")).alias(data))


def file_content(inodes: DataFrame, extents: DataFrame, blocks: DataFrame, block_size: int, limit: int = 1 << 30) -> DataFrame:
    """(private_id, size, part, data) of all files: the key is the private id, holes are zeros, the end is cut to the size.

    A file of up to limit bytes is part 0; a larger one is as many parts as it takes, each of limit bytes (in whole blocks)
    but the last, which in order are the file. Blocks are joined by address; an empty file has empty data. Missing blocks
    read as zeros.
    """
    per_part = max(1, limit // block_size)
    div = lambda c, n: F.call_function("div", c, F.lit(n).cast("long"))
    wanted = inodes.select("private_id", F.col("ds_size").alias("size"))
    units = explode_extents(extents, block_size).join(wanted, F.col("file_id") == F.col("private_id")).where(F.col("file_block") * block_size < F.col("size"))
    zero = F.unhex(F.repeat(F.lit("00"), block_size))
    read = units.join(blocks.select("paddr", "data"), "paddr", "left").select("private_id", "file_block", F.coalesce(F.when(F.col("paddr") != 0, F.col("data")), zero).alias("data"))
    # blocks that no extent covers are zeros too
    last = div(F.col("size") - 1, block_size)
    parts = wanted.where("size > 0").select("private_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), div(last, per_part))).alias("part"))
    end = F.least(last, (F.col("part") + 1) * per_part - 1)
    every = parts.select("private_id", "part", F.explode(F.sequence(F.col("part") * per_part, end)).alias("file_block"))
    full = every.join(read, ["private_id", "file_block"], "left").withColumn("data", F.coalesce("data", zero))
    joined = concat_pieces(full, ["private_id", "part"], "file_block", "data", per_part * block_size)
    whole = wanted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), div(F.greatest(last, F.lit(0)), per_part)))))
    left = F.least(F.col("size") - F.col("part") * per_part * block_size, F.lit(per_part * block_size)).cast("int")
    return whole.join(joined, ["private_id", "part"], "left").select("private_id", "size", "part", F.substring(F.coalesce("data", F.lit(b"")), F.lit(1), F.greatest(left, F.lit(0))).alias("data"))


def shared_extents(extents: DataFrame, by: list[str] | str, size: str) -> DataFrame:
    """Extents or contents that occur more than once: (by, owners, bytes, saved)."""
    keys = [by] if isinstance(by, str) else by
    return extents.groupBy(*keys).agg(F.count("*").alias("owners"), F.sum(size).alias("bytes"), (F.sum(size) - F.max(size)).alias("saved")).where("owners > 1")
