"""Images as tables of blocks: raw files, two tiers, partition tables, sparse and compressed images."""

from __future__ import annotations

import base64
import bz2
import os
import plistlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image_id string, tier string, paddr long, data binary"
#: Fixed value: an address with this bit lies on the second device.
TIER2 = 1 << 62


class Range(InputPartition):
    def __init__(self, path: str, image_id: str, tier: str, start: int, end: int, offset: int, block_size: int):
        super().__init__(None)
        self.path, self.image_id, self.tier, self.start, self.end, self.offset, self.block_size = path, image_id, tier, start, end, offset, block_size


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.block_size = int(options.get("block_size", 4096))
        self.offset = int(options.get("offset", 0))
        self.length = int(options["length"]) if "length" in options else None
        self.tier = options.get("tier", "main")
        self.range_bytes = int(options.get("range_bytes", 128 << 20))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            size = os.path.getsize(path) - self.offset
            size = size if self.length is None else min(size, self.length)
            blocks, step = -(-size // self.block_size), max(1, self.range_bytes // self.block_size)
            out += [Range(path, path, self.tier, b, min(blocks, b + step), self.offset, self.block_size) for b in range(0, blocks, step)]
        return out or [Range("", "", self.tier, 0, 0, 0, self.block_size)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.string()), ("tier", pa.string()), ("paddr", pa.int64()), ("data", pa.binary())])
        if part.start >= part.end:
            return
        with open(part.path, "rb") as f:
            f.seek(part.offset + part.start * part.block_size)
            at = part.start
            while at < part.end:
                n = min(part.end - at, max(1, (4 << 20) // part.block_size))
                raw = f.read(n * part.block_size).ljust(n * part.block_size, b"\0")
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * part.block_size, part.block_size, dtype=np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array([part.image_id] * n), pa.array([part.tier] * n), pa.array(np.arange(at, at + n)), data], schema=schema)
                at += n


class BlockSource(DataSource):
    """format("image_blocks"): fixed-size blocks of files that every executor can open by path, a task per byte range."""

    @classmethod
    def name(cls) -> str:
        return "image_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def read_blocks(spark: SparkSession, paths: list[str] | str, block_size: int = 4096, offset: int = 0, length: int | None = None, tier: str = "main", range_bytes: int = 128 << 20) -> DataFrame:
    """A row per block of each image, with its address. The end of a file is filled up with zeros to a whole block."""
    spark.dataSource.register(BlockSource)
    reader = spark.read.format("image_blocks").option("paths", paths if isinstance(paths, str) else "\n".join(paths)).option("block_size", block_size).option("offset", offset).option("tier", tier).option("range_bytes", range_bytes)
    return (reader.option("length", length) if length is not None else reader).load()


def read_blocks_from_store(spark: SparkSession, path: str, block_size: int = 4096, tier: str = "main") -> DataFrame:
    """As read_blocks, through Spark's own file systems (hdfs:// and the like): images of whole blocks only."""
    rows = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(block_size)},
    )
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return spark.createDataFrame(rows.map(lambda r: (name, tier, r[0], bytes(r[1]))), SCHEMA)


def block_table(spark: SparkSession, path: str, block_size: int = 4096) -> DataFrame:
    """Blocks of a small file of any length in any file system: the whole file is one row first, so not for images."""
    whole = spark.read.format("binaryFile").load(path)
    n = F.ceil(F.col("length") / block_size).cast("long")
    rows = whole.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("image_id"), F.lit("main").alias("tier"), "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("paddr"))
    return rows.select("image_id", "tier", "paddr", F.rpad(F.substring("content", (F.col("paddr") * block_size + 1).cast("int"), F.lit(block_size)), block_size, F.lit(b"\0")).alias("data"))


def resolve_tier(df: DataFrame, address: str) -> DataFrame:
    """df with tier and offset: bit 62 of a byte address sends it to the second device, without that bit."""
    second = F.col(address).bitwiseAND(F.lit(TIER2).cast("long")) != 0
    return df.withColumns({"tier": F.when(second, "tier2").otherwise("main"), "offset": F.col(address).bitwiseAND(F.lit(TIER2 - 1).cast("long"))})


def parse_gpt(head: bytes, sector: int) -> list[dict]:
    """Entries of a partition table given the first bytes of an image; none if a check sum or the signature is wrong."""
    header = head[sector : sector + 92]
    if header[:8] != b"EFI PART":
        return []
    size = int.from_bytes(header[12:16], "little")
    plain = head[sector : sector + 16] + b"\0\0\0\0" + head[sector + 20 : sector + size]
    if zlib.crc32(plain) != int.from_bytes(header[16:20], "little"):
        return []
    at, n, each, crc = (int.from_bytes(header[a:b], "little") for a, b in ((72, 80), (80, 84), (84, 88), (88, 92)))
    table = head[at * sector : at * sector + n * each]
    if zlib.crc32(table) != crc:
        return []
    out = []
    for i in range(n):
        e = table[i * each : (i + 1) * each]
        first, last = int.from_bytes(e[32:40], "little"), int.from_bytes(e[40:48], "little")
        if first == 0 and last == 0:
            break
        out.append({"index": i, "type_guid": e[:16], "part_guid": e[16:32], "offset": first * sector, "size": (last - first + 1) * sector, "name": e[56:128].decode("utf-16-le", "replace").split("\0")[0]})
    return out


def read_partition_table(images: DataFrame, sectors: tuple[int, ...] = (512, 4096)) -> DataFrame:
    """Partitions of images (image_id, head binary: the first bytes, enough for the table): a row per entry."""

    @F.pandas_udf("array<struct<index int, type_guid binary, part_guid binary, offset long, size long, name string>>")
    def run(heads: pd.Series) -> pd.Series:
        return heads.map(lambda h: next((found for s in sectors if (found := parse_gpt(h, s))), []))

    from imagelake.functions.scalars import guid_string

    rows = images.select("image_id", F.explode(run("head")).alias("e")).select("image_id", "e.*")
    return rows.withColumns({"type_guid": guid_string("type_guid"), "part_guid": guid_string("part_guid")})


def first_partition(partitions: DataFrame, type_guid: str) -> DataFrame:
    """(image_id, offset, size) of each image's first partition of a type."""
    rows = partitions.where(F.col("type_guid") == type_guid.upper())
    return rows.groupBy("image_id").agg(F.min_by(F.struct("offset", "size"), "index").alias("p")).select("image_id", "p.*")


CHUNK_MAP = "method string, logical_off long, logical_len long, file_off long, file_len long"


def parse_sparse(head: bytes, read) -> list[dict]:
    """Bands of a sparse image: a header node at 0, index nodes linked from it; band numbers from 1, what no node names is a hole.

    Fixed values of the format, in bytes: the header has sectors per band at 8, the next node's offset (8 bytes) at 20, the
    total of sectors (8 bytes) at 28 and bands from 64; an index node has the next offset (8 bytes) at 12 and bands
    from 56. Bands follow their node of 4096 bytes in the order named. Holes give rows of method `zero`.
    """
    if head[:4] != b"sprs":
        return []
    number = lambda raw, at, n=4: int.from_bytes(raw[at : at + n], "big")
    band, total = number(head, 8) * 512, number(head, 28, 8) * 512
    placed, node, base, first, following, seen = {}, head, 0, 64, number(head, 20, 8), {0}
    while True:
        for i, at in enumerate(range(first, 4096, 4)):
            if logical := number(node, at):
                placed[logical - 1] = base + 4096 + i * band
        if not following or following in seen:  # a loop in a corrupt image ends
            break
        seen.add(following)
        base, node, first = following, read(following, 4096), 56
        following = number(node, 12, 8)
    out = []
    for k in range(-(-total // band) if band else 0):
        size = min(band, total - k * band)
        found = placed.get(k)
        out.append({"method": "zero" if found is None else "stored", "logical_off": k * band, "logical_len": size, "file_off": found or 0, "file_len": 0 if found is None else size})
    return out


def parse_dmg(read, size: int) -> list[dict]:
    """Runs of a disk image with a 'koly' trailer: XML tables of base64 'mish' blocks. Without a trailer one stored run."""
    trailer = read(size - 512, 512)
    if trailer[:4] != b"koly":
        return [{"method": "stored", "logical_off": 0, "logical_len": size, "file_off": 0, "file_len": size}]
    number = lambda raw, at, n=8: int.from_bytes(raw[at : at + n], "big")
    fork = number(trailer, 24)
    xml = plistlib.loads(read(number(trailer, 216), number(trailer, 224)))
    names = {0: "zero", 1: "stored", 2: "zero", 0x80000004: "adc", 0x80000005: "zlib", 0x80000006: "bzip2", 0x80000007: "lzfse", 0x80000008: "lzma"}
    out = []
    for entry in xml["resource-fork"]["blkx"]:
        table = entry["Data"] if isinstance(entry["Data"], bytes) else base64.b64decode(entry["Data"])
        if table[:4] != b"mish":
            continue
        first, data = number(table, 8), number(table, 24)
        for i in range(number(table, 200, 4)):
            run = table[204 + 40 * i : 244 + 40 * i]
            kind = number(run, 0, 4)
            if kind in (0xFFFFFFFF, 0x7FFFFFFE):  # the end, and comments
                continue
            out.append({"method": names.get(kind, "unsupported"), "logical_off": (first + number(run, 8)) * 512, "logical_len": number(run, 16) * 512, "file_off": fork + data + number(run, 24), "file_len": number(run, 32)})
    return out


def chunk_map(images: DataFrame, kind: str) -> DataFrame:
    """chunk_map rows (image_id, path, method, logical and file places) of images (image_id, path); kind: sparse or dmg."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image_id, path in zip(batch["image_id"], batch["path"], strict=True):
                with open(path, "rb") as f:

                    def read(at: int, n: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    rows = parse_sparse(read(0, 4096), read) if kind == "sparse" else parse_dmg(read, os.path.getsize(path))
                if rows:
                    yield pd.DataFrame(rows).assign(image_id=image_id, path=path)[["image_id", "path", "method", "logical_off", "logical_len", "file_off", "file_len"]]

    return images.select("image_id", "path").mapInPandas(run, f"image_id string, path string, {CHUNK_MAP}")


def read_mapped(chunks: DataFrame, block_size: int = 4096, tier: str = "main") -> DataFrame:
    """Blocks of mapped images: each chunk is read from its file and decoded in a task of its own, then cut into blocks."""
    from imagelake.operators.contents import _one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                data = b""
                if c["method"] not in ("zero", "unsupported"):
                    with open(c["path"], "rb") as f:
                        f.seek(c["file_off"])
                        data = f.read(c["file_len"])
                status, data = _one(c["method"], data, c["logical_len"])
                if status != "ok":
                    raise ValueError(f"{c['image_id']} at {c['logical_off']}: {status}")
                n = -(-len(data) // block_size)
                first = c["logical_off"] // block_size
                parts = [data[i * block_size : (i + 1) * block_size].ljust(block_size, b"\0") for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([c["image_id"]] * n, pa.string()), pa.array([tier] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(parts, pa.binary())], ["image_id", "tier", "paddr", "data"])

    return chunks.repartition("image_id", "logical_off").mapInArrow(run, SCHEMA)
