"""From raw blocks to files: an image of hand-made nodes read through the block source."""

import pytest
from pyspark.sql import functions as F

from imagelake.operators import blocks as B
from imagelake.operators import btree as T
from imagelake.operators import checkpoints as C
from imagelake.operators import extents as E
from imagelake.operators import namespace as N
from imagelake.operators import resolve as R
from imagelake.operators import space as M
from imagelake.sources.images import read_blocks
from tests import imagebuilder as I


@pytest.fixture(scope="module", params=[4096, 16384])
def image(request, tmp_path_factory):
    size = request.param
    records = [
        I.inode(2, 1, 2, 0x41ED, children=2, name="root"), I.inode(16, 2, 16, 0x41ED, children=1, name="dir"), I.inode(17, 16, 27, 0x81A4, size=size + 5, name="f"), I.inode(18, 2, 18, 0x81A4, size=0, name="empty"),
        I.dir_rec(2, "dir", 16, 4), I.dir_rec(16, "f", 17, 8, sibling=70), I.dir_rec(2, "empty", 18, 8), I.dir_rec(2, "f again", 17, 8, sibling=71),
        I.xattr(17, "user.note", b"hi"), I.xattr(18, "com.apple.fs.symlink", b"dir/f\0"), I.xattr(17, "big", stream=(90, 7)),
        I.extent(27, 0, size, 8), I.extent(27, size, size, 0), I.extent(90, 0, size, 9),
        (I.key(17, 5, I.le(70, 8)), I.le(16, 8) + I.le(2, 2) + b"f\0"), (I.key(17, 5, I.le(71, 8)), I.le(2, 8) + I.le(8, 2) + b"f again\0"), (I.key(70, 12), I.le(17, 8)), (I.key(71, 12), I.le(17, 8)),
        (I.key(8, 2), I.le(1 | 1 << 60, 8) + I.le(27, 8) + I.le(2, 4)), (b"abc", b""), (I.key(5, 15), b"?"),
    ]
    omap = [(I.le(40, 8) + I.le(x, 8), I.le(f, 4) + I.le(size, 4) + I.le(p, 8)) for x, f, p in ((1, 0, 90), (5, 0, 5), (9, 1, 91))] + [(I.le(41, 8) + I.le(2, 8), None)]
    supers = [bytearray(I.header(1, x, 1)).ljust(size, b"\0") for x in (3, 5, 4)]
    for s in supers:
        s[32:44] = b"NXSB" + I.le(size, 4) + I.le(64, 4)
    cib = bytearray(I.header(60, 5, 7)).ljust(size, b"\0")
    cib[32:40] = I.le(0, 4) + I.le(2, 4)
    cib[40:104] = I.le(5, 8) + I.le(0, 8) + I.le(64, 4) + I.le(61, 4) + I.le(10, 8) + I.le(5, 8) + I.le(64, 8) + I.le(64, 4) + I.le(64, 4) + I.le(0, 8)
    cpm = bytearray(I.header(61, 5, 12)).ljust(size, b"\0")
    cpm[32:40] = I.le(1, 4) + I.le(1, 4)
    cpm[40:80] = I.le(5, 4) + I.le(0, 4) + I.le(size, 8) + I.le(0, 8) + I.le(1024, 8) + I.le(33, 8)
    corrupt = bytearray(I.seal(supers[1]))
    corrupt[200] ^= 1
    bitmap = bytes([0b1000_0101]).ljust(size, b"\0")
    blocks = [I.seal(supers[0]), bytes(corrupt), I.seal(supers[2]), bytes(size), I.node(50, 9, 0x0B, omap, fixed=(16, 16), size=size), I.node(40, 5, 0x0E, records, size=size), I.seal(cib), I.seal(cpm), b"A" * size, b"stream!".ljust(size, b"Z"), bitmap]
    path = tmp_path_factory.mktemp("image") / "disk.img"
    path.write_bytes(b"".join(blocks))
    return str(path), size


@pytest.fixture(scope="module")
def tables(spark, image):
    path, size = image
    raw = read_blocks(spark, path, size).cache()
    good = B.object_header(B.classify(raw).where("class = 'Metadata'"))
    nodes = T.btree_nodes(good.where("o_type in (2, 3)"))
    records = T.btree_records(nodes)
    fs = T.route_records(records.where("subtype = 14")).cache()
    return {"raw": raw, "good": good, "records": records, "fs": fs, "size": size}


def test_superblock_and_map(tables):
    good = tables["good"]
    assert C.latest_superblock(good.where("o_type = 1").select("image_id", "xid", "paddr"), ["image_id"]).first()[1:] == (4, 2)
    assert C.latest_superblock(good.where("o_type = 1").select("image_id", "xid", "paddr"), ["image_id"], at_xid=3).first()[1:] == (3, 0)
    head = T.block_struct(good.where("o_type = 1"), "container").where("paddr = 0").first()
    assert head.block_size == tables["size"]
    assert sorted(r.paddr for r in B.block_map(B.classify(tables["raw"])).where("class = 'Empty'").collect()) == [3]
    assert sorted(r.paddr for r in B.classify(tables["raw"]).where("class = 'Data'").collect()) == [1, 8, 9, 10]


def test_object_map(tables):
    log = T.omap_entries(tables["records"].where("subtype = 11"))
    assert log.count() == 3
    now = R.resolve_version(log, ["image_id", "oid"], "xid", 8)
    assert [(r.oid, r.paddr) for r in now.collect()] == [(40, 5)]
    gone = F.col("flags").bitwiseAND(F.lit(1).cast("long")) != 0
    assert R.drop_deleted(R.resolve_version(log, ["image_id", "oid"], "xid"), gone).count() == 0


def test_files(spark, tables):
    fs, size = tables["fs"], tables["size"]
    inodes, entries, attributes, extents = T.inodes(fs), T.dir_recs(fs), T.xattrs(fs), T.file_extents(fs)
    paths = {r.path: r.file_id for r in N.build_paths(entries, F.col("flags") == 4).collect()}
    assert paths == {"/dir": 16, "/dir/f": 17, "/empty": 18, "/f again": 17}
    stats = {r.ino: r["size"] for r in N.stat(inodes, attributes.withColumns({"algo": F.lit(None).cast("long"), "header_size": F.lit(None).cast("long")})).collect()}
    assert stats == {2: 2, 16: 1, 17: size + 5, 18: 0}
    content = {r.private_id: bytes(r.data) for r in E.file_content(inodes.where("ds_size is not null"), E.all_extents(extents), tables["raw"], size).collect()}
    assert content == {27: b"A" * size + bytes(5), 18: b""}
    from imagelake.operators.contents import xattr_values

    values = {r["name"]: bytes(r.value) for r in xattr_values(attributes, extents, tables["raw"], size).collect()}
    assert values == {"user.note": b"hi", "com.apple.fs.symlink": b"dir/f\0", "big": b"stream!"}
    assert [r.target for r in N.symlinks(attributes).collect()] == ["dir/f"]
    links = N.hardlinks(N.sibling_names(T.sibling_links(fs), T.sibling_maps(fs))).collect()
    assert [(r.file_id, r.links) for r in links] == [(17, 2)]
    assert [(r.start_block, r.length, r.kind, r.refcnt) for r in T.phys_extents(fs).collect()] == [(8, 1, 1, 2)]
    assert sorted(r.kind for r in T.bad_records(fs).collect()) == ["short key", "unknown record type"]
    found = {r["name"]: r.name_hash for r in entries.collect()}
    computed = {r["name"]: r.h for r in entries.select("name", F.shiftrightunsigned(B.filename_hash()("name"), 10).alias("h")).collect()}
    assert found == computed


def test_space(tables):
    chunks = T.chunks(tables["good"].where("o_type = 7"))
    used = M.allocated_blocks(chunks, tables["raw"])
    assert sorted(r.paddr for r in used.collect()) == [0, 2, 7]
    assert M.chunk_consistency(chunks, used).count() == 0
    assert M.space_totals(chunks, ["tier"]).first()[1:] == (128, 125)
    maps = T.checkpoint_mappings(tables["good"].where("o_type = 12"))
    assert [(r.oid, r.paddr) for r in maps.collect()] == [(1024, 33)]
