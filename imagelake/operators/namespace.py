"""Directories, names, paths and file metadata over (parent, name, child) entries and inodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.functions.scalars import entry_mode
from imagelake.operators.blocks import le_number
from imagelake.sources.tables import checkpoint_table

ROOT = 2  # the root directory's id
LONGEST_NAME = 1023
#: Attribute names, the flag of a compressed file, and known compression methods.
COMPRESSION_ATTRIBUTE = "com.apple.decmpfs"
RESOURCE_FORK = "com.apple.ResourceFork"
SYMLINK_ATTRIBUTE = "com.apple.fs.symlink"
COMPRESSED = 0x20
HAS_UNCOMPRESSED_SIZE = 0x40000
METHODS = (3, 4, 7, 8, 9, 10, 11, 12, 13, 14)


def list_directory(entries: DataFrame, parents: DataFrame | None = None, order: tuple[str, ...] = ("name_hash", "name")) -> DataFrame:
    """The entries of the given directories (parent_id), or all, sorted by key, with the mode bits of their type."""
    rows = entries if parents is None else entries.join(parents.select("parent_id").distinct(), "parent_id", "left_semi")
    keys = [c for c in order if c in entries.columns]
    return rows.withColumn("mode", entry_mode("flags")).orderBy("parent_id", *keys)


def lookup_name(probes: DataFrame, entries: DataFrame, fold: bool = False, hash_column: str | None = None) -> DataFrame:
    """probes (parent_id, name, ...) with file_id of the entry of that name, or null. Names over 1023 bytes find nothing.

    With hash_column both sides are joined on it too, as hashed directories are keyed. fold compares lower-case forms.
    """
    form = (lambda c: F.lower(c)) if fold else (lambda c: c)
    side = entries.select(F.col("parent_id").alias("_parent"), form(F.col("name")).alias("_name"), "file_id", *([F.col(hash_column).alias("_hash")] if hash_column else []))
    same = (F.col("parent_id") == F.col("_parent")) & (form(F.col("name")) == F.col("_name")) & (F.octet_length("name") <= LONGEST_NAME)
    if hash_column:
        same = same & (F.col(hash_column) == F.col("_hash"))
    return probes.join(side, same, "left").drop("_parent", "_name", "_hash")


def build_paths(entries: DataFrame, directories: Column, root: int = ROOT) -> DataFrame:
    """entries with depth and path from the root. An entry that no root reaches has none.

    Directories are stored once and walked level by level until a level is empty, whatever the depth; files join once at
    the end. A directory isn't entered again below itself, so a cycle in a corrupt image ends.
    """
    dirs = checkpoint_table(entries.where(directories).select("parent_id", "name", "file_id"))
    above = F.array(F.lit(root).cast("long"))
    level = dirs.where((F.col("parent_id") == root) & (F.col("file_id") != root)).select(F.col("file_id").alias("dir"), F.concat(F.lit("/"), "name").alias("dir_path"), F.lit(1).alias("dir_depth"), above.alias("above"))
    reached = entries.sparkSession.range(1).select(F.lit(root).cast("long").alias("dir"), F.lit("").alias("dir_path"), F.lit(0).alias("dir_depth"))
    depth = 0
    while True:
        depth += 1
        level = checkpoint_table(level)
        if level.isEmpty():
            break
        reached = reached.unionByName(level.drop("above"))
        if depth % 16 == 0:  # plans stay short
            reached = checkpoint_table(reached)
        below = dirs.join(level, F.col("parent_id") == F.col("dir")).withColumn("above", F.concat("above", F.array("dir"))).where(~F.array_contains("above", F.col("file_id")))
        level = below.select(F.col("file_id").alias("dir"), F.concat("dir_path", F.lit("/"), "name").alias("dir_path"), F.lit(depth + 1).alias("dir_depth"), "above")
    return entries.join(reached, F.col("parent_id") == F.col("dir"), "left").select(*[entries[c] for c in entries.columns], (F.col("dir_depth") + 1).alias("depth"), F.concat("dir_path", F.lit("/"), "name").alias("path"))


def orphans(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries that got no path: their parents are missing, or lie on a cycle."""
    return paths.where("path is null").select(*entries.columns)


def resolve_paths(paths: DataFrame, entries: DataFrame, root: int = ROOT, fold: bool = False) -> DataFrame:
    """paths (path) with file_id, one name lookup per component of the longest path; null where a component is missing."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    state = paths.withColumns({"_parts": parts, "_at": F.lit(root).cast("long")})
    deepest = state.agg(F.max(F.size("_parts"))).first()[0] or 0
    side = entries.select(F.col("parent_id").alias("_parent"), (F.lower("name") if fold else F.col("name")).alias("_name"), F.col("file_id").alias("_next"))
    for depth in range(1, deepest + 1):
        part = F.try_element_at("_parts", F.lit(depth))
        part = F.lower(part) if fold else part
        joined = state.join(side, (F.col("_at") == F.col("_parent")) & (part == F.col("_name")), "left")
        state = joined.withColumn("_at", F.when(F.size("_parts") >= depth, F.col("_next")).otherwise(F.col("_at"))).drop("_parent", "_name", "_next")
        if depth % 4 == 0:
            state = checkpoint_table(state)
    return state.withColumn("file_id", F.col("_at")).drop("_parts", "_at")


def with_compression_header(xattrs: DataFrame) -> DataFrame:
    """xattrs with algo and header_size, the method and size that an embedded compression attribute names; null for others."""
    own = (F.col("name") == COMPRESSION_ATTRIBUTE) & (F.octet_length("data") >= 16)
    return xattrs.withColumns({"algo": F.when(own, le_number(F.col("data"), 4, 4)), "header_size": F.when(own, le_number(F.col("data"), 8, 8))})


def stat(inodes: DataFrame, xattrs: DataFrame, uid: int | None = None, gid: int | None = None) -> DataFrame:
    """Inodes with kind, size, uid and gid, and size_status.

    A regular file that is marked compressed has the size of its inode if that says so, else of its compression header if
    the method is known, else of its resource fork, else an error. Other files have their stream's size or 0, a
    directory the number of its children.
    """
    header = xattrs.where(F.col("name") == COMPRESSION_ATTRIBUTE).select("ino", F.col("algo").alias("_algo"), F.col("header_size").alias("_header_size"))
    fork = xattrs.where(F.col("name") == RESOURCE_FORK).select("ino", F.col("stream_size").alias("_fork_size"))
    rows = inodes.join(header, "ino", "left").join(fork, "ino", "left")
    directory = F.col("mode").bitwiseAND(F.lit(0xF000).cast(inodes.schema["mode"].dataType)) == 0x4000
    compressed = F.col("bsd_flags").bitwiseAND(F.lit(COMPRESSED).cast(inodes.schema["bsd_flags"].dataType)) != 0
    own_size = F.col("internal_flags").bitwiseAND(F.lit(HAS_UNCOMPRESSED_SIZE).cast(inodes.schema["internal_flags"].dataType)) != 0
    packed = F.when(own_size, F.col("uncompressed_size")).when(F.col("_algo").isin(*METHODS), F.col("_header_size")).otherwise(F.col("_fork_size"))
    size = F.when(directory, F.col("nchildren_nlink").cast("long")).when(compressed, packed).otherwise(F.coalesce("ds_size", F.lit(0)))
    out = rows.withColumns({"kind": F.when(directory, "directory").otherwise("file"), "size": size})
    out = out.withColumn("size_status", F.when(F.col("size").isNull(), "no size of a compressed file").otherwise("ok"))
    if uid is not None:
        out = out.withColumn("uid", F.lit(uid).cast("long"))
    if gid is not None:
        out = out.withColumn("gid", F.lit(gid).cast("long"))
    return out.drop("_algo", "_header_size", "_fork_size")


def list_xattrs(xattrs: DataFrame, key: str = "ino", name: str = "name") -> DataFrame:
    """(key, names): attribute names of each inode in key order. An inode's attributes are few."""
    return xattrs.groupBy(key).agg(F.sort_array(F.collect_list(name)).alias("names"))


def symlinks(xattrs: DataFrame) -> DataFrame:
    """(ino, target): the text up to the first NUL."""
    text = F.col("data").cast("string")
    return xattrs.where(F.col("name") == SYMLINK_ATTRIBUTE).select("ino", F.substring_index(text, "\x00", 1).alias("target"))


def hardlinks(names: DataFrame, file: str = "file_id") -> DataFrame:
    """Files with more than one (parent_id, name): (file, links, names). names come from directory entries, each with its file.

    Counted first, so that only files with several names are gathered.
    """
    several = names.groupBy(file).agg(F.count("*").alias("links")).where("links > 1")
    return names.join(several, file).groupBy(file, "links").agg(F.array_sort(F.collect_list(F.struct("parent_id", "name"))).alias("names"))


def sibling_names(sibling_links: DataFrame, sibling_maps: DataFrame) -> DataFrame:
    """(file_id, parent_id, name) of every name that sibling records know; both tables must agree on the file."""
    maps = sibling_maps.select("sibling_id", F.col("file_id").alias("_file"))
    return sibling_links.join(maps, "sibling_id").where(F.col("file_id") == F.col("_file")).select("file_id", "parent_id", "name")
