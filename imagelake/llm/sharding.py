"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.llm.shared import cut, number_rows


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. The weight of a rack or region is the sum of the weights below it."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int = 16, base: int = 16, racks_in_region: int = 2, shards_in_rack: int = 2) -> list[Shard]:
    """The first base shards fill racks and regions in turn; each further shard opens a region of its own.

    So one more shard changes no weight but that of its own new region, and the draws among the others stay: rows
    move only into the new shard.
    """
    per_region = racks_in_region * shards_in_rack
    return [
        Shard(i, f"r{i // per_region}", f"k{i % per_region // shards_in_rack}") if i < base else _further(i)
        for i in range(shards)
    ]


def _further(shard: int) -> Shard:
    return Shard(shard, f"x{shard}", "k0")


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from the key and the node's name; a node wins in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; children: name, weight, value."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("draw"), value.alias("value")) for name, weight, value in children]
    return F.least(*draws)["value"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key: a weighted draw among regions, then among that region's racks, then among that rack's shards."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs shards, all with a positive weight")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for x in tree:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    total = lambda leaves: sum(x.weight for x in leaves)
    in_region = {}
    for region, racks in regions.items():
        leaves = {
            rack: _pick(key, [(f"{region}/{rack}/{x.shard}", x.weight, F.lit(x.shard)) for x in below])
            for rack, below in racks.items()
        }
        rack = _pick(key, [(f"{region}/{rack}", total(below), F.lit(rack)) for rack, below in racks.items()])
        in_region[region] = _case(rack, leaves)
    region = _pick(key, [(r, total([x for below in racks.values() for x in below]), F.lit(r)) for r, racks in regions.items()])
    return _case(region, in_region)


def _case(on: Column, values: dict[str, Column]) -> Column:
    items = list(values.items())
    return reduce(lambda out, item: F.when(on == item[0], item[1]).otherwise(out), items[:-1], items[-1][1])


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    id_column: str = "doc_id",
    text_column: str = "text",
    tree: list[Shard] | None = None,
    grown_tree: list[Shard] | None = None,
    slot_buckets: int = 1024,
) -> DataFrame:
    """Puts every row into a shard by its id alone, and numbers the rows of each shard from 0 without gaps.

    The law is `key`: the id and the tree decide; with grown_tree (by default one more shard) rows move only into the
    new shard. Slots follow a hash bucket of the id and then the id: the rows of each bucket are counted, the
    counts are summed over the earlier buckets, and rows are ranked inside their bucket, so no shard is
    gathered in one task.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard). size is the text's UTF-8 bytes plus 1; a
    null text has none, and the CRC of the empty text. A null id hashes like any other value, so all such rows share a
    shard; rows that repeat an id share its shard and get different slots. An empty table gives no rows.
    """
    grown = grown_tree or (topology(shards + 1) if tree is None else [*tree, _further(max(x.shard for x in tree) + 1)])
    tree = tree or topology(shards)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.col("id")
    rows = cut(
        docs.select(F.col(id_column).cast("long").alias("id"), F.octet_length(text).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumns({"shard": shard_of(key, tree).cast("int"), "grown_shard": shard_of(key, grown).cast("int")})
    )
    return number_rows(rows, ["shard"], F.struct("id", "size", "text_crc32"), ["id", "size", "text_crc32"], "slot", slot_buckets).select(
        F.col("id").alias(id_column),
        (F.col("size") + 1).alias("size"),
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
