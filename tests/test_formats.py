"""Known answers of the byte-level helpers, and images written by hand."""

import bz2
import plistlib
import zlib

import numpy as np
import pytest

from imagelake import aes, kernels
from imagelake.operators import blocks as B
from imagelake.operators import contents as D
from imagelake.sources import images as S
from imagelake.sources.tables import read_tables, write_tables


def test_known_check_sums():
    assert kernels.crc32c(b"123456789") == 0x1CF96D7C
    assert zlib.crc32(b"123456789") == 0xCBF43926
    assert kernels.fletcher64_sums(np.array([[1, 2, 3]], "<u4")).tolist() == [[6, 10]]


def test_block_sums_and_empty(spark):
    body = bytes(range(256)) * 15 + bytes(248)
    good = bytearray(kernels.checksum_for(bytes(8) + body) + body)
    bad = bytearray(good)
    bad[100] ^= 1
    rows = [(0, good), (1, bad), (2, bytearray(4096)), (3, None)]
    df = spark.createDataFrame([("i", "main", i, d) for i, d in rows], "image_id string, tier string, paddr long, data binary")
    assert [r["class"] for r in B.classify(df).orderBy("paddr").collect()] == ["Metadata", "Data", "Empty", "Data"]
    map_rows = B.block_map(B.classify(df))
    assert sorted(r.paddr for r in map_rows.collect()) == [0, 1, 2, 3]


def test_xts_vectors():
    # published XTS-AES-128 vectors: all zero keys, then keys of 0x11 and 0x22 with unit 0x3333333333
    zero = aes.xts(np.zeros((1, 32), np.uint8), np.array([0], np.uint64), bytes(32), False)
    assert zero.tobytes().hex() == "917cf69ebd68b2ec9b9fe9a3eadda692cd43d2f59598ed858c02c2652fbf922e"
    two = aes.xts(np.full((1, 32), 0x44, np.uint8), np.array([0x3333333333], np.uint64), b"\x11" * 16 + b"\x22" * 16, False)
    assert two.tobytes().hex() == "c454185e6a16936e39334038acef838bfb186fff7480adc4289382ecd6d394f0"
    assert (aes.xts(two, np.array([0x3333333333], np.uint64), b"\x11" * 16 + b"\x22" * 16, True) == 0x44).all()


def test_codecs(spark):
    text = b"hello hello hello hello" * 20
    rows = [("stored", text, len(text)), ("zero", b"", 9), ("zlib", zlib.compress(text), len(text)), ("bzip2", bz2.compress(text), len(text)), ("zlib", b"junk", 4), ("zlib", zlib.compress(text), 3), ("lzvn", b"x", 1), ("adc", b"\x82abc\x00\x02", 6)]
    df = spark.createDataFrame([(i, m, bytearray(d), n) for i, (m, d, n) in enumerate(rows)], "i int, m string, d binary, n long")
    found = D.decompress_chunks(df, "m", "d", "n").orderBy("i").collect()
    assert [r.status.split(":")[0] for r in found] == ["ok", "ok", "ok", "ok", "corrupt", "wrong length", "unsupported", "ok"]
    assert bytes(found[2].data) == bytes(found[3].data) == text and bytes(found[7].data) == b"abcabc"


def test_compressed_files(spark):
    text = bytes(range(256)) * 300  # two chunks
    header = lambda algo, n: (0x636D7066).to_bytes(4, "little") + algo.to_bytes(4, "little") + n.to_bytes(8, "little")
    parts = [zlib.compress(text[:0x10000]), b"\x0f" + text[0x10000:]]
    table = len(parts).to_bytes(4, "little")
    at = 4 + 8 * len(parts)
    for p in parts:
        table += at.to_bytes(4, "little") + len(p).to_bytes(4, "little")
        at += len(p)
    data = table + b"".join(parts)
    fork = (256).to_bytes(4, "big") + bytes(252) + len(data).to_bytes(4, "big") + data
    rows = [
        (1, header(3, 5) + zlib.compress(b"hello"), None),
        (2, header(3, 5) + b"\xffhello", None),
        (3, header(9, 5) + b"\xcchello", None),
        (4, header(4, len(text)), fork),
        (5, header(3, 6) + zlib.compress(b"hello"), None),
        (6, header(99, 5), None),
        (7, header(7, 5) + b"\x01abc", None),
    ]
    df = spark.createDataFrame([(i, bytearray(h), bytearray(f) if f else None) for i, h, f in rows], "ino long, header binary, fork binary")
    found = {r.ino: r for r in D.decompress_files(df).collect()}
    assert [found[i].status for i in range(1, 8)] == ["ok", "ok", "ok", "ok", "bad chunk", "unknown method", "bad chunk"]
    assert bytes(found[1].data) == bytes(found[2].data) == bytes(found[3].data) == b"hello" and bytes(found[4].data) == text
    assert found[5].data is None


def test_raw_blocks(spark, tmp_path):
    raw = bytes(np.random.default_rng(0).integers(0, 256, 4096 * 5 + 10, dtype=np.uint8))
    (tmp_path / "a.img").write_bytes(raw)
    df = S.read_blocks(spark, str(tmp_path / "a.img"), range_bytes=8192)
    assert df.rdd.getNumPartitions() == 3
    found = sorted((r.paddr, bytes(r.data)) for r in df.collect())
    assert b"".join(d for _, d in found)[: len(raw)] == raw and [p for p, _ in found] == list(range(6))
    (tmp_path / "b.img").write_bytes(raw[: 4096 * 5])
    assert sorted(r.paddr for r in S.read_blocks_from_store(spark, f"file://{tmp_path}/b.img").collect()) == list(range(5))
    assert S.read_blocks(spark, str(tmp_path / "a.img"), offset=4096, length=8192).count() == 2


def test_partition_table(spark):
    guid = bytes(range(16))
    entry = guid + bytes(16) + (40).to_bytes(8, "little") + (49).to_bytes(8, "little") + bytes(8) + "data".encode("utf-16-le").ljust(72, b"\0")
    table = entry.ljust(128 * 4, b"\0")
    head = b"EFI PART" + bytes(4) + (92).to_bytes(4, "little") + bytes(8) + bytes(48) + (2).to_bytes(8, "little") + (4).to_bytes(4, "little") + (128).to_bytes(4, "little") + zlib.crc32(table).to_bytes(4, "little")
    head = head[:16] + zlib.crc32(head).to_bytes(4, "little") + head[20:]
    raw = bytes(512) + head.ljust(512, b"\0") + table
    images = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(raw[:600] + b"x" + raw[601:])), ("c", bytearray(2048))], "image_id string, head binary")
    rows = S.read_partition_table(images).collect()
    good = [r for r in rows if r.image_id == "a"]
    assert [(r.offset, r.size, r["name"], r.type_guid) for r in good] == [(40 * 512, 10 * 512, "data", "03020100-0504-0706-0809-0A0B0C0D0E0F")]
    assert S.first_partition(S.read_partition_table(images), good[0].type_guid).where("image_id = 'a'").count() == 1
    assert not [r for r in rows if r.image_id == "c"]


def test_compressed_image(spark, tmp_path):
    sectors = bytes(range(256)) * 16  # 8 sectors
    packed = zlib.compress(sectors)
    run = lambda kind, first, n, off, size: kind.to_bytes(4, "big") + bytes(4) + b"".join(x.to_bytes(8, "big") for x in (first, n, off, size))
    runs = [run(0x80000005, 0, 8, 0, len(packed)), run(2, 8, 8, 0, 0), run(1, 16, 8, len(packed), 4096), run(0xFFFFFFFF, 24, 0, 0, 0)]
    mish = b"mish" + bytes(4) + (0).to_bytes(8, "big") + (24).to_bytes(8, "big") + bytes(8) + bytes(168) + len(runs).to_bytes(4, "big") + b"".join(runs)
    xml = plistlib.dumps({"resource-fork": {"blkx": [{"Data": mish}]}})
    body = packed + sectors
    trailer = bytearray(512)
    trailer[:4] = b"koly"
    trailer[216:224], trailer[224:232] = len(body).to_bytes(8, "big"), len(xml).to_bytes(8, "big")
    (tmp_path / "a.dmg").write_bytes(body + xml + bytes(trailer))
    images = spark.createDataFrame([("a", str(tmp_path / "a.dmg"))], "image_id string, path string")
    chunks = S.chunk_map(images, "dmg")
    assert sorted((r.method, r.logical_off) for r in chunks.collect()) == [("stored", 8192), ("zero", 4096), ("zlib", 0)]
    found = sorted((r.paddr, bytes(r.data)) for r in S.read_mapped(chunks).collect())
    assert found == [(0, sectors), (1, bytes(4096)), (2, sectors)]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "image_id string, x int")
    write_tables({"t": df}, str(tmp_path / "out"))
    assert sorted((r.image_id, r.x) for r in read_tables(spark, str(tmp_path / "out"), ["t"])["t"].collect()) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("name,length", [("a", 2), ("é", 3), ("", 1)])
def test_name_hash_holds_the_length(name, length):
    assert kernels.name_hash(name) & 0x3FF == length
    assert kernels.name_hash("É", True) >> 10 == kernels.name_hash("é", True) >> 10


def test_sparse_image_with_two_nodes_and_a_hole():
    number = lambda n, size=4: n.to_bytes(size, "big")
    band = 8 * 512
    head = bytearray(4096)
    head[:4], head[8:12], head[20:28], head[28:36] = b"sprs", number(8), number(100_000, 8), number(8 * 4 + 3, 8)
    head[64:68], head[72:76] = number(2), number(1)  # the second band named has no number
    node = bytearray(4096)
    node[12:20], node[56:60] = number(0, 8), number(5)
    rows = S.parse_sparse(bytes(head), lambda at, n: bytes(node) if at == 100_000 and n == 4096 else b"")
    assert [(r["method"], r["logical_off"], r["logical_len"], r["file_off"], r["file_len"]) for r in rows] == [
        ("stored", 0, band, 4096 + 2 * band, band), ("stored", band, band, 4096, band), ("zero", 2 * band, band, 0, 0), ("zero", 3 * band, band, 0, 0), ("stored", 4 * band, 3 * 512, 104_096, 3 * 512),
    ]
