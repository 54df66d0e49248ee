"""Allocation: chunks, bitmaps, free space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.kernels import set_bits


def bits_of(value: Column | str, width: int = 64) -> Column:
    """The places of the set bits of a number, as array<int>, the least significant first."""
    v = (F.col(value) if isinstance(value, str) else value).cast("long")
    return F.filter(F.array(*[F.lit(i) for i in range(width)]), lambda i: F.call_function("shiftrightunsigned", v, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def allocated_blocks(chunks: DataFrame, bitmaps: DataFrame, device_blocks: int | None = None) -> DataFrame:
    """(image_id, tier, paddr) of every allocated block: chunks join their bitmap block, whose bits become rows.

    A chunk without a bitmap (bitmap_addr 0) is free. Bits past the chunk's count or the device's end are ignored.
    """
    keys = ["image_id", "tier"]
    joined = chunks.where("bitmap_addr <> 0").join(bitmaps.select(*keys, F.col("paddr").alias("bitmap_addr"), "data"), [*keys, "bitmap_addr"]).select(*keys, "addr", "block_count", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                image, tier, addr, count, data = (one.column(i)[0].as_py() for i in range(5))
                paddr = addr + set_bits(np.frombuffer(data, np.uint8), count).astype(np.int64)
                if device_blocks is not None:
                    paddr = paddr[paddr < device_blocks]
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(paddr), pa.string()), pa.array([tier] * len(paddr), pa.string()), pa.array(paddr, pa.int64())], [*keys, "paddr"])

    return joined.mapInArrow(run, "image_id string, tier string, paddr long")


def scan_allocated(blocks: DataFrame, allocated: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that are allocated: a left semi join."""
    return blocks.join(allocated, keys, "left_semi")


def space_totals(chunks: DataFrame, keys: list[str], total: str = "block_count", free: str = "free_count") -> DataFrame:
    """Total and free blocks of each key."""
    return chunks.groupBy(*keys).agg(F.sum(total).alias("total"), F.sum(free).alias("free"))


def chunk_consistency(chunks: DataFrame, allocated: DataFrame) -> DataFrame:
    """Chunks whose free count differs from what their bitmap says: (chunk columns, counted_free)."""
    keys = ["image_id", "tier"]
    size = chunks.agg(F.max("block_count")).first()[0] or 1  # all chunks but the last have the same size
    used = allocated.withColumn("addr", F.col("paddr") - F.pmod(F.col("paddr"), F.lit(size).cast("long"))).groupBy(*keys, "addr").agg(F.count("*").alias("_used"))
    both = chunks.join(used, [*keys, "addr"], "left").withColumn("counted_free", F.col("block_count") - F.coalesce("_used", F.lit(0)))
    return both.where("counted_free <> free_count").drop("_used")


def free_queue(records: DataFrame) -> DataFrame:
    """(xid, paddr, count): a missing count means 1."""
    return records.select("xid", "paddr", F.coalesce("count", F.lit(1)).cast("long").alias("count"))
