"""What Python workers hold, and how often work on blocks is done."""

import re
import threading
import time
from pathlib import Path

import psutil
from pyspark.sql import functions as F

from imagelake.operators import contents as D


def largest_worker_mb(work) -> float:
    """The most that one Python worker held of its own while work ran."""
    most, over = [0.0], threading.Event()

    def watch():
        while not over.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "python" in p.name():
                        most.append(int(re.search(r"Private_Dirty:\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())[1]) / 1024)
                except (OSError, psutil.Error):
                    continue
            time.sleep(0.02)

    threading.Thread(target=watch, daemon=True).start()
    work()
    over.set()
    return max(most)


def test_decryption_holds_little_beside_its_blocks(spark):
    clear = spark.range(0, 5000, 1, 1).select((F.col("id") + 1).alias("tweak"), F.rpad(F.col("id").cast("string").cast("binary"), 4096, F.lit(b"x")).alias("data"))
    took = largest_worker_mb(lambda: D.xts_blocks(clear, bytes(range(32)), "data", "tweak").agg(F.count("data")).collect())
    assert took < 130, took  # 20 MB of blocks, twice, and the modules, but no tables of all their bytes


def test_chunks_are_worked_on_once(spark):
    clear = spark.createDataFrame([(i, bytearray(b"abc" * i)) for i in range(9)], "i int, data binary")
    packed = clear.select("i", D.compress_zlib("data").alias("src"), F.lit("zlib").alias("m"), F.octet_length("data").cast("long").alias("n"))
    done = D.decompress_chunks(packed, "m", "src", "n").where("status = 'ok'").select("i", "data")
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # one packs, one unpacks
    assert {r.i: bytes(r.data) for r in done.collect()} == {i: b"abc" * i for i in range(9)}


def test_blocks_of_any_length_and_nulls(spark):
    key, rows = bytes(range(32)), [(0, b"a" * 1024, 5), (1, None, 5), (2, b"b" * 512, 0), (3, b"", 7), (4, b"c" * 512, None), (5, b"d" * 512, 1 << 60), (6, b"e" * 512, (1 << 60) + 1), (7, b"d" * 512, (1 << 60) + 1)]
    df = spark.createDataFrame([(i, d and bytearray(d), t) for i, d, t in rows], "i int, data binary, t long").coalesce(1)
    secret = D.xts_blocks(df, key, "data", "t", decrypt=False)
    found = {r.i: None if r.data is None else bytes(r.data) for r in secret.collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [None, b"b" * 512, b"", b"c" * 512]  # a tweak of 0 or null: clear text
    assert found[0] != b"a" * 1024 and found[5] != found[7]  # the whole tweak counts, beside a null too
    assert {r.i: r.data if r.data is None else bytes(r.data) for r in D.xts_blocks(secret, key, "data", "t").collect()} == {i: d for i, d, _ in rows}


def test_chunks_that_are_null(spark):
    df = spark.createDataFrame([(0, "stored", None, 1), (1, None, bytearray(b"x"), 1), (2, "stored", bytearray(b"xy"), None), (3, "zero", None, 3)], "i int, m string, d binary, n long").coalesce(1)
    found = {r.i: (r.status, r.data and bytes(r.data)) for r in D.decompress_chunks(df, "m", "d", "n").collect()}
    assert found == {0: ("missing", None), 1: ("missing", None), 2: ("ok", b"xy"), 3: ("ok", bytes(3))}
    packed = df.select("i", D.compress_zlib("d").alias("z")).collect()
    assert [r.z is None for r in sorted(packed)] == [True, False, False, True]
