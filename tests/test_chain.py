"""Volumes through the object map, record tables and findings, on hand-made blocks."""

import pytest
from pyspark.sql import functions as F

from imagelake.operators import blocks as B
from imagelake.operators import btree as T
from imagelake.operators import checkpoints as C
from imagelake.operators import findings as FI
from imagelake.operators import namespace as N
from imagelake.operators import resolve as R
from imagelake.sources.images import read_blocks
from tests import imagebuilder as I

SIZE = 4096


def volume(oid, xid, name, magic=b"APSB", role=0x40):
    body = bytearray(I.header(oid, xid, 13)).ljust(SIZE, b"\0")
    body[32:36] = magic
    body[56:64], body[88:96], body[184:192], body[216:224], body[264:272] = I.le(1, 8), I.le(7, 8), I.le(12, 8), I.le(1, 8), I.le(1, 8)
    body[240:256] = bytes(range(16))
    body[704 : 704 + len(name.encode())] = name.encode()
    body[900:903] = b"\xff\xfe\xfd"  # behind the name's end anything may lie
    body[964:966] = I.le(role, 2)
    return I.seal(body)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    head = bytearray(I.header(1, 9, 1)).ljust(SIZE, b"\0")
    head[32:48] = b"NXSB" + I.le(SIZE, 4) + I.le(64, 8)
    head[180:184] = I.le(8, 4)
    # slots: two states, deleted, no entry, no block, bad check sum, wrong magic; behind the last slot lies something else
    for slot, oid in enumerate((40, 41, 42, 43, 0, 44, 45, 0, 99)):
        head[184 + 8 * slot : 192 + 8 * slot] = I.le(oid, 8)
    entry = lambda oid, xid, flags, paddr: (I.le(oid, 8) + I.le(xid, 8), I.le(flags, 4) + I.le(SIZE, 4) + I.le(paddr, 8))
    omap = [entry(40, 2, 0, 2), entry(40, 8, 0, 3), entry(40, 11, 0, 90), entry(41, 3, 1, 2), entry(43, 3, 0, 700), entry(44, 4, 0, 4), entry(45, 4, 0, 5)]
    corrupt = bytearray(volume(44, 4, "broken"))
    corrupt[900] ^= 1
    records = [
        I.inode(16, 2, 16, 0x81A4, size=9, name="a", bsd=0x20), I.inode(17, 2, 17, 0x81A4, size=9, name="b", bsd=0x20), I.dir_rec(2, "a", 16, 8), I.dir_rec(2, "lost", 18, 8),
        I.xattr(16, "com.apple.decmpfs", b"fpmc" + I.le(7, 4) + I.le(1234, 8)), I.xattr(19, "com.apple.decmpfs", b"xxxx" + I.le(7, 4) + bytes(8)), I.xattr(20, "com.apple.decmpfs", b"fpmc" + I.le(99, 4) + bytes(8)), I.xattr(21, "com.apple.decmpfs", b"fp"),
        (I.key(2, 9, I.le(123 << 10 | 4, 4) + b"odd\0"), I.le(16, 8) + I.le(5, 8) + I.le(8, 2)),
        (I.key(16, 6), I.le(3, 4)), (I.key(30, 7), I.le(2, 4) + I.le(5, 2) + I.le(1, 2) + I.le(6, 4) + I.le(4, 4) + I.le(8, 4) + I.le(9, 2) + I.le(3, 2) + b"keyrest"),
        (I.key(16, 13, I.le(5 | 1 << 60, 8)), I.le(2, 2) + b"\x04HASHrest"), (I.key(16, 10), I.le(1, 8) + I.le(2, 8) + I.le(3, 8) + I.le(4, 8)), (I.key((1 << 60) - 1, 11, I.le(5, 2) + b"snap\0"), I.le(77, 8)),
    ]
    free = [(I.le(4, 8) + I.le(500, 8), I.le(3, 8)), (I.le(5, 8) + I.le(600, 8), None)]
    snaps = [(I.le(6, 8), I.le(1, 4) + I.le(0, 4) + I.le(88, 8))]
    blocks = [
        I.seal(head), bytes(SIZE), volume(40, 2, "Old"), volume(40, 8, "Data é"), bytes(corrupt), volume(45, 4, "x", magic=b"????"), I.node(50, 9, 0x0B, omap, fixed=(16, 16)),
        I.node(51, 9, 0x0E, records), I.node(52, 9, 0x09, free, fixed=(16, 8)), I.node(53, 9, 0x13, snaps, fixed=(8, 16)), I.seal(bytearray(I.header(9, 9, 0x77)).ljust(SIZE, b"\0")),
    ]
    path = tmp_path_factory.mktemp("chain") / "disk.img"
    path.write_bytes(b"".join(blocks))
    classes = B.classify(read_blocks(spark, str(path), SIZE)).cache()
    good = B.object_header(classes.where("class = 'Metadata'"))
    records = T.btree_records(T.btree_nodes(good.where("o_type in (2, 3)"))).cache()
    return {"classes": classes, "good": good, "records": records, "log": T.omap_entries(records.where("subtype = 11")), "fs": T.route_records(records.where("subtype = 14")).cache()}


def test_volumes(chain):
    heads = chain["good"].where("o_type = 1").select("image_id", "xid", "data")
    found = C.volumes(heads, chain["log"], chain["classes"])
    rows = {r.volume: r for r in found.collect()}
    assert {v: r.status for v, r in rows.items()} == {0: "ok", 1: "deleted", 2: "no map entry", 3: "no block", 5: "bad check sum", 6: "wrong magic"}
    assert (rows[0].name, rows[0].paddr, rows[0].num_files, rows[0].role) == ("Data é", 3, 12, 0x40) and rows[0].uuid == "00010203-0405-0607-0809-0A0B0C0D0E0F"
    assert rows[6].name is None
    older = C.volumes(heads, chain["log"], chain["classes"], at_xid=5).where("status = 'ok'").collect()
    assert [(r.name, r.paddr) for r in older] == [("Old", 2)]
    one = C.volume_summary(found.where("status = 'ok'"), SIZE).first()
    assert (one["name"], one.roles, one.case_sensitive, one.bytes_used, one.encrypted, one.num_snapshots) == ("Data é", "Data", False, 7 * SIZE, False, 1)


def test_record_tables(chain):
    fs, records = chain["fs"], chain["records"]
    only = lambda df: [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)[1:] for r in df.drop("").collect()]
    assert only(T.dstream_ids(fs)) == [(16, 3)]
    assert only(T.crypto_states(fs)) == [(30, 2, 5, 1, 6, 4, 8, 9, 3, b"key")]
    assert only(T.file_hashes(fs)) == [(16, 2, 5, b"HASH")]
    assert only(T.dir_stats(fs)) == [(16, 1, 2, 3, 4)]
    assert only(T.snapshot_names(fs)) == [("snap", 77)]
    assert sorted(only(T.free_queue_entries(records.where("subtype = 9")))) == [(4, 500, 3), (5, 600, 1)]
    assert only(T.omap_snapshots(records.where("subtype = 19"))) == [(6, 1, 88)]


def test_stat_of_decoded_attributes(chain):
    found = {r.ino: (r["size"], r.size_status) for r in N.stat(T.inodes(chain["fs"]), N.with_compression_header(T.xattrs(chain["fs"]))).collect()}
    assert found == {16: (1234, "ok"), 17: (None, "no size of a compressed file")}


def test_findings(chain):
    fs = chain["fs"]
    inodes, xattrs, entries = T.inodes(fs), T.xattrs(fs), T.dir_recs(fs)
    newest = R.resolve_version(chain["log"], ["image_id", "oid"], "xid", 9)
    slots = C.container_slots(chain["good"].where("o_type = 1").select("image_id", "xid", "data"))
    parts = [
        FI.map_findings(slots, newest, chain["classes"]), FI.compression_findings(inodes, xattrs), FI.type_findings(chain["good"]), FI.name_findings(entries),
        FI.reference_findings(entries, "file_id", inodes, "ino", "entry without inode"),
    ]
    assert sorted((r.kind, r.object_id) for r in FI.findings(parts).collect()) == [
        ("bad check sum", 44), ("bad compression magic", 19), ("compressed without attribute", 17), ("deleted map entry referenced", 41), ("entry without inode", 18), ("no block", 43),
        ("no map entry", 42), ("short compression header", 21), ("unknown compression method", 20), ("unknown object type", 10), ("wrong name hash", 16),
    ]
    assert FI.findings([p.where(F.lit(False)) for p in parts]).count() == 0
