"""B-tree nodes and their records, from verified blocks to typed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.functions.scalars import extent_kind, extent_length, flags_of, key_id, key_type, length_of
from imagelake.layouts import LAYOUTS, numbers

ROOT, LEAF, FIXED = 1, 2, 4
NODE_FIELDS = ("flags", "level", "nkeys", "table_off", "table_len", "free_off", "free_len", "kfree_off", "kfree_len", "vfree_off", "vfree_len")
INFO_FIELDS = ("bt_flags", "node_size", "key_size", "val_size", "longest_key", "longest_val", "key_count", "node_count")
KEYS = ("image_id", "tier", "paddr")
#: Key and value sizes of trees with fixed records, by subtype.
FIXED_SIZES = {0x0B: (16, 16), 0x13: (8, 16), 0x09: (16, 8), 0x15: (8, 16), 0x1A: (8, 8), 0x1F: (16, 16)}
#: Record types in the upper four bits of a key.
RECORD_TYPES = {1: "snapshots", 2: "phys_extents", 3: "inodes", 4: "xattrs", 5: "sibling_links", 6: "dstream_ids", 7: "crypto_states", 8: "file_extents", 9: "dir_recs", 10: "dir_stats", 11: "snapshot_names", 12: "sibling_maps", 13: "file_hashes"}


def _arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, schema)


def btree_nodes(blocks: DataFrame) -> DataFrame:
    """blocks (image_id, tier, paddr, data) as nodes: header, areas, and a root's tree information from its last 40 bytes."""
    header = ("oid", "xid", "o_type", "o_subtype")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(3).to_pylist()
        head, node = numbers(data, "object"), numbers(data, "node")
        info = numbers([d[-40:] for d in data], "node_info")
        plain = pa.array((node["flags"] & ROOT) == 0)
        columns = [batch.column(i) for i in range(4)] + [pa.array(head[f] if f not in ("o_type", "o_subtype") else head[f] & 0xFFFF) for f in header] + [pa.array(node[f]) for f in NODE_FIELDS]
        columns += [pa.array(info[f], mask=np.asarray(plain)) for f in INFO_FIELDS]
        return pa.RecordBatch.from_arrays(columns, [*KEYS, "data", *header, *NODE_FIELDS, *INFO_FIELDS])

    schema = "image_id string, tier string, paddr long, data binary, " + ", ".join(f"{f} long" for f in (*header, *NODE_FIELDS, *INFO_FIELDS))
    return _arrow(blocks.select(*KEYS, "data"), work, schema)


def btree_records(nodes: DataFrame) -> DataFrame:
    """A row per entry of each node: (image_id, tier, paddr, oid, xid, subtype, pos, is_leaf, key, val).

    Keys lie behind the table of entries, values are counted back from the node's end, or from a root's tree information. An
    offset of 0xFFFF is a missing value. A value of an index node is the 8 bytes of a child's id.
    """

    def entries(d: bytes, flags: int, n: int, off: int, length: int, subtype: int, key_size, val_size) -> list[tuple[bytes, bytes | None]]:
        base, end = 56 + off, len(d) - (40 if flags & ROOT else 0)
        keys = base + length
        leaf = bool(flags & LEAF)
        out = []
        if flags & FIXED:
            k_n, v_n = (key_size, val_size) if flags & ROOT and key_size else FIXED_SIZES.get(subtype, (16, 16))
            toc = np.frombuffer(d, "<u2", 2 * n, base).reshape(n, 2)
            for k, v in toc.tolist():
                out.append((d[keys + k : keys + k + k_n], None if v == 0xFFFF else d[end - v : end - v + (v_n if leaf else 8)]))
        else:
            toc = np.frombuffer(d, "<u2", 4 * n, base).reshape(n, 4)
            for k, k_n, v, v_n in toc.tolist():
                out.append((d[keys + k : keys + k + k_n], None if v == 0xFFFF else d[end - v : end - v + v_n]))
        return out

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.to_pylist()
        found = [entries(r["data"], r["flags"], r["nkeys"], r["table_off"], r["table_len"], r["o_subtype"], r["key_size"], r["val_size"]) for r in rows]
        at = np.repeat(np.arange(len(rows)), [len(x) for x in found])
        take = pa.array(at)
        columns = [batch.column(batch.schema.names.index(c)).take(take) for c in (*KEYS, "oid", "xid", "o_subtype")]
        columns += [pa.array([i for x in found for i in range(len(x))], pa.int32()), pa.array([bool(rows[i]["flags"] & LEAF) for i in at], pa.bool_())]
        columns += [pa.array([e[k] for x in found for e in x], pa.binary()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, [*KEYS, "oid", "xid", "subtype", "pos", "is_leaf", "key", "val"])

    schema = "image_id string, tier string, paddr long, oid long, xid long, subtype long, pos int, is_leaf boolean, key binary, val binary"
    return _arrow(nodes.select(*KEYS, "data", "oid", "xid", "o_subtype", "flags", "nkeys", "table_off", "table_len", "key_size", "val_size"), work, schema)


def _decode(records: DataFrame, fields: dict[str, str], work: Callable[[list[bytes], list[bytes | None]], dict[str, list]]) -> DataFrame:
    """(image_id, fields) of the records' keys and values; work turns lists of both into columns."""

    def batch_work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = work(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(found[f], types[t]) for f, t in fields.items()], ["image_id", *fields])

    return _arrow(records.select("image_id", "key", "val"), batch_work, "image_id string, " + ", ".join(f"{f} {t}" for f, t in fields.items()))


def _text(data: bytes) -> str:
    """Text up to the first NUL."""
    return data.split(b"\0", 1)[0].decode("utf-8", "replace")


def omap_entries(records: DataFrame) -> DataFrame:
    """(image_id, oid, xid, flags, size, paddr) of the leaves of object maps."""
    fields = ("oid", "xid", "flags", "size", "paddr")
    return _decode(records.where("is_leaf and val is not null"), dict.fromkeys(fields, "long"), lambda k, v: numbers(k, "omap_key") | numbers(v, "omap_val"))


def route_records(records: DataFrame) -> DataFrame:
    """Leaf records with obj_id, type number and table name; keys under 8 bytes have none."""
    from imagelake.operators.blocks import le_number

    key = F.when(F.octet_length("key") >= 8, le_number(F.col("key"), 0, 8))
    kind = key_type(key)
    names = F.create_map(*[x for k, v in RECORD_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return records.where("is_leaf").select("*", key_id(key).alias("obj_id"), kind.alias("record_type"), F.try_element_at(names, kind).alias("table"))


def bad_records(routed: DataFrame) -> DataFrame:
    """Findings: keys that are too short, and unknown types."""
    kind = F.when(F.col("obj_id").isNull(), "short key").when(F.col("table").isNull(), "unknown record type")
    return routed.select(kind.alias("kind"), F.col("paddr").alias("object_id"), F.hex("key").alias("detail")).where("kind is not null")


def xfields(blob: bytes) -> dict[int, bytes]:
    """Extended fields: a count, descriptors of 4 bytes, then values that each start at a multiple of 8."""
    if len(blob) < 4:
        return {}
    n, at, out = int.from_bytes(blob[:2], "little"), 4, {}
    data = 4 + 4 * n
    for i in range(n):
        kind, size = blob[at + 4 * i], int.from_bytes(blob[at + 4 * i + 2 : at + 4 * i + 4], "little")
        out[kind] = blob[data : data + size]
        data += -(-size // 8) * 8
    return out


#: Extended fields of inodes, and the one of directory entries.
X_SNAP, X_DOCUMENT, X_NAME, X_PREVIOUS_SIZE, X_STREAM, X_SPARSE, X_RDEV, X_SIBLING = 1, 3, 4, 5, 8, 13, 14, 1


def _number(data: bytes | None) -> int | None:
    return None if data is None else int.from_bytes(data[:8], "little", signed=len(data) >= 8)


def inodes(routed: DataFrame) -> DataFrame:
    names = [f for f, _, _ in LAYOUTS["inode"][1] if f != "pad1"]
    extra = {"snap_xid": "long", "document_id": "long", "prev_fsize": "long", "ds_size": "long", "ds_alloced": "long", "ds_crypto_id": "long", "sparse_bytes": "long", "rdev": "long", "name": "string"}

    def work(keys, vals):
        out = {f: x for f, x in numbers(vals, "inode").items()}
        x = [xfields(v[92:]) for v in vals]
        part = lambda kind, at=0: [_number(d[kind][at : at + 8]) if kind in d else None for d in x]
        out |= {"ino": numbers([k + bytes(8) for k in keys], "omap_key")["oid"] & 0x0FFFFFFFFFFFFFFF, "snap_xid": part(X_SNAP), "document_id": part(X_DOCUMENT), "prev_fsize": part(X_PREVIOUS_SIZE), "ds_size": part(X_STREAM), "ds_alloced": part(X_STREAM, 8), "ds_crypto_id": part(X_STREAM, 16), "sparse_bytes": part(X_SPARSE), "rdev": part(X_RDEV), "name": [_text(d[X_NAME]) if X_NAME in d else None for d in x]}
        return out

    return _decode(routed.where("table = 'inodes' and val is not null"), {"ino": "long", **dict.fromkeys(names, "long"), **extra}, work)


def dir_recs(routed: DataFrame, hashed: bool = True) -> DataFrame:
    """Directory entries; hashed volumes keep a word of hash and length before the name, others the length alone."""

    def work(keys, vals):
        out = numbers(vals, "dir_rec")
        words = [int.from_bytes(k[8:12] if hashed else k[8:10], "little") for k in keys]
        siblings = [xfields(v[18:]) for v in vals]
        return out | {
            "parent_id": numbers([k[:8] + bytes(8) for k in keys], "omap_key")["oid"] & 0x0FFFFFFFFFFFFFFF, "name": [_text(k[12 if hashed else 10 :]) for k in keys],
            "name_hash": [w >> 10 if hashed else None for w in words], "sibling_id": [_number(s.get(X_SIBLING)) for s in siblings],
        }

    return _decode(routed.where("table = 'dir_recs' and val is not null"), {"parent_id": "long", "name": "string", "name_hash": "long", "file_id": "long", "date_added_ns": "long", "flags": "long", "sibling_id": "long"}, work)


def xattrs(routed: DataFrame) -> DataFrame:
    """Attributes with embedded bytes or a stream; the flag bit 1 means a stream."""

    def work(keys, vals):
        head = numbers(vals, "xattr")
        stream = numbers([v[4:] for v in vals], "stream")
        is_stream = (head["flags"] & 1) != 0
        pick = lambda x: [int(a) if s else None for a, s in zip(x, is_stream, strict=True)]
        return {
            "ino": numbers([k[:8] + bytes(8) for k in keys], "omap_key")["oid"] & 0x0FFFFFFFFFFFFFFF, "name": [_text(k[10:]) for k in keys], "flags": head["flags"],
            "data": [None if s else v[4 : 4 + int(n)] for v, n, s in zip(vals, head["data_len"], is_stream, strict=True)],
            "stream_id": pick(stream["stream_id"]), "stream_size": pick(stream["stream_size"]), "stream_alloced": pick(stream["stream_alloced"]),
        }

    return _decode(routed.where("table = 'xattrs' and val is not null"), {"ino": "long", "name": "string", "flags": "long", "data": "binary", "stream_id": "long", "stream_size": "long", "stream_alloced": "long"}, work)


def file_extents(routed: DataFrame) -> DataFrame:
    rows = _decode(routed.where("table = 'file_extents' and val is not null"), dict.fromkeys(("packed", "logical_addr", "len_and_flags", "phys_block", "crypto_id"), "long"), lambda k, v: numbers(v, "file_extent") | {"packed": numbers(k, "omap_key")["oid"], "logical_addr": numbers(k, "omap_key")["xid"]})
    return rows.select("image_id", key_id("packed").alias("file_id"), "logical_addr", length_of("len_and_flags").alias("length"), flags_of("len_and_flags").alias("flags"), "phys_block", "crypto_id")


def sealed_extents(records: DataFrame) -> DataFrame:
    rows = _decode(records.where("is_leaf and val is not null"), dict.fromkeys(("private_id", "logical_addr", "len_and_flags", "phys_block"), "long"), lambda k, v: numbers(k, "sealed_key") | numbers(v, "sealed_val"))
    return rows.select("image_id", "private_id", "logical_addr", length_of("len_and_flags").alias("length"), flags_of("len_and_flags").alias("flags"), "phys_block")


def phys_extents(routed: DataFrame) -> DataFrame:
    rows = _decode(routed.where("table = 'phys_extents' and val is not null"), dict.fromkeys(("packed", "len_and_kind", "owning_obj", "refcnt"), "long"), lambda k, v: numbers(v, "phys_extent") | {"packed": numbers([x + bytes(8) for x in k], "omap_key")["oid"]})
    return rows.select("image_id", key_id("packed").alias("start_block"), extent_length("len_and_kind").alias("length"), extent_kind("len_and_kind").alias("kind"), "owning_obj", "refcnt")


def snapshot_records(routed: DataFrame) -> DataFrame:
    fields = {"packed": "long", **dict.fromkeys(("extentref_oid", "sblock_paddr", "create_ns", "change_ns", "inum", "flags"), "long"), "name": "string"}
    rows = _decode(routed.where("table = 'snapshots' and val is not null"), fields, lambda k, v: numbers(v, "snapshot") | {"packed": numbers([x + bytes(8) for x in k], "omap_key")["oid"], "name": [_text(x[50:]) for x in v]})
    return rows.select("image_id", key_id("packed").alias("xid"), *[c for c in fields if c != "packed"])


def sibling_links(routed: DataFrame) -> DataFrame:
    fields = {"packed": "long", "sibling_id": "long", "parent_id": "long", "name": "string"}
    rows = _decode(routed.where("table = 'sibling_links' and val is not null"), fields, lambda k, v: numbers(v, "sibling") | {"packed": numbers(k, "omap_key")["oid"], "sibling_id": numbers(k, "omap_key")["xid"], "name": [_text(x[10:]) for x in v]})
    return rows.select("image_id", key_id("packed").alias("file_id"), "sibling_id", "parent_id", "name")


def sibling_maps(routed: DataFrame) -> DataFrame:
    rows = _decode(routed.where("table = 'sibling_maps' and val is not null"), {"packed": "long", "file_id": "long"}, lambda k, v: numbers(v, "sibling_map") | {"packed": numbers([x + bytes(8) for x in k], "omap_key")["oid"]})
    return rows.select("image_id", key_id("packed").alias("sibling_id"), "file_id")


def _ids(keys: list[bytes]) -> np.ndarray:
    return numbers([k[:8] + bytes(8) for k in keys], "omap_key")["oid"] & 0x0FFFFFFFFFFFFFFF


def _table(routed: DataFrame, table: str, key: str, fields: tuple[str, ...], layout: str, more: dict[str, str] | None = None, work: Callable | None = None) -> DataFrame:
    """The records of one table: the id of the key under the name `key`, the number fields of a layout, and what work adds."""
    rows = routed.where((F.col("table") == table) & F.col("val").isNotNull())
    types = {key: "long", **dict.fromkeys(fields, "long"), **(more or {})}
    return _decode(rows, types, lambda k, v: numbers(v, layout) | {key: _ids(k)} | (work(k, v) if work else {}))


def dstream_ids(routed: DataFrame) -> DataFrame:
    return _table(routed, "dstream_ids", "private_id", ("refcnt",), "dstream_id")


def crypto_states(routed: DataFrame) -> DataFrame:
    """States of per-file keys, with the wrapped key's bytes."""
    fields = ("refcnt", "major_version", "minor_version", "cpflags", "persistent_class", "key_os_version", "key_revision", "key_len")
    wrapped = lambda k, v: {"persistent_key": [x[24 : 24 + int.from_bytes(x[22:24], "little")] for x in v]}
    return _table(routed, "crypto_states", "crypto_id", fields, "crypto_state", {"persistent_key": "binary"}, wrapped)


def file_hashes(routed: DataFrame) -> DataFrame:
    """Hashes of stretches of a file: the logical block is the low 56 bits of the key's second word."""
    more = lambda k, v: {"lba": numbers(k, "omap_key")["xid"] & 0x00FFFFFFFFFFFFFF, "hash": [x[3 : 3 + x[2]] if len(x) > 2 else None for x in v]}
    return _table(routed, "file_hashes", "ino", ("hashed_len",), "file_hash", {"lba": "long", "hash": "binary"}, more)


def dir_stats(routed: DataFrame) -> DataFrame:
    return _table(routed, "dir_stats", "ino", ("num_children", "total_size", "chained_key", "gen_count"), "dir_stats")


def snapshot_names(routed: DataFrame) -> DataFrame:
    """(image_id, name, snap_xid): a name's key is its text."""
    rows = _decode(routed.where("table = 'snapshot_names' and val is not null"), {"name": "string", "snap_xid": "long"}, lambda k, v: numbers(v, "snap_name") | {"name": [_text(x[10:]) for x in k]})
    return rows


def omap_snapshots(records: DataFrame) -> DataFrame:
    """(image_id, xid, snap_flags, snap_oid) of the leaves of an object map's snapshot tree."""
    return _decode(records.where("is_leaf and val is not null"), dict.fromkeys(("xid", "snap_flags", "snap_oid"), "long"), lambda k, v: numbers(v, "omap_snapshot") | {"xid": numbers([x + bytes(8) for x in k], "omap_key")["oid"]})


def free_queue_entries(records: DataFrame) -> DataFrame:
    """(image_id, xid, paddr, count) of the leaves of a free queue; a missing value means one block."""
    known = lambda v: np.where([x is None for x in v], 1, numbers(v, "free_count")["count"])
    return _decode(records.where("is_leaf"), dict.fromkeys(("xid", "paddr", "count"), "long"), lambda k, v: {"xid": numbers(k, "omap_key")["oid"], "paddr": numbers(k, "omap_key")["xid"], "count": known(v)})


def block_struct(blocks: DataFrame, layout: str) -> DataFrame:
    """The number fields of a block's structure (container, volume, object_map, space_manager ...), a row per block."""
    names = list(numbers([b""], layout))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = numbers(batch.column(3).to_pylist(), layout)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(found[f]) for f in names], [*KEYS, *names])

    return _arrow(blocks.select(*KEYS, "data"), work, "image_id string, tier string, paddr long, " + ", ".join(f"{f} long" for f in names))


def chunks(chunk_blocks: DataFrame) -> DataFrame:
    """The chunks that chunk-info blocks list: (image_id, tier, cib_index, chunk_index, xid, addr, block_count, free_count, bitmap_addr)."""
    names = ("xid", "addr", "block_count", "free_count", "bitmap_addr")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(3).to_pylist()
        head = numbers(data, "chunk_block")
        n = head["chunk_info_count"]
        row, place = np.repeat(np.arange(len(data)), n), np.concatenate([np.arange(x) for x in n] or [np.zeros(0, int)])
        found = numbers([data[r][40 + 32 * p : 72 + 32 * p] for r, p in zip(row, place, strict=True)], "chunk")
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(head["cib_index"][row]), pa.array(place, pa.int64())] + [pa.array(found[f] & 0xFFFFF if f in ("block_count", "free_count") else found[f]) for f in names], ["image_id", "tier", "cib_index", "chunk_index", *names])

    return _arrow(chunk_blocks.select(*KEYS, "data"), work, "image_id string, tier string, cib_index long, chunk_index long, " + ", ".join(f"{f} long" for f in names))


def checkpoint_mappings(map_blocks: DataFrame) -> DataFrame:
    """(image_id, block, pos, xid, oid, paddr, size) of checkpoint-map blocks, for checkpoint_lookup."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column(3).to_pylist()
        head, objects = numbers(data, "checkpoint_map"), numbers(data, "object")
        n = head["cpm_count"]
        row, place = np.repeat(np.arange(len(data)), n), np.concatenate([np.arange(x) for x in n] or [np.zeros(0, int)])
        found = numbers([data[r][40 + 40 * p : 80 + 40 * p] for r, p in zip(row, place, strict=True)], "mapping")
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(place, pa.int64()), pa.array(objects["xid"][row])] + [pa.array(found[f]) for f in ("oid", "paddr", "size")], ["image_id", "block", "pos", "xid", "oid", "paddr", "size"])

    return _arrow(map_blocks.select(*KEYS, "data"), work, "image_id string, block long, pos long, xid long, oid long, paddr long, size long")
