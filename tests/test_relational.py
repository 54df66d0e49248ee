"""Demonstration queries against their SQL, and properties against brute force."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from imagelake.functions import scalars as X
from imagelake.operators import blocks as B
from imagelake.operators import extents as E
from imagelake.operators import namespace as N
from imagelake.operators import resolve as R
from imagelake.operators import space as M
from imagelake.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (np.generic,)):
        value = value.item()
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    return value


def rows(df):
    return sorted(repr(tuple(plain(x) for x in row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    found = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.SQL:
        want = db.execute(plans.SQL[name]).fetchdf()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)


def test_asof_equals_brute_force(spark):
    random = np.random.default_rng(3)
    log = pd.DataFrame({"k": random.integers(0, 5, 60), "v": np.arange(60), "x": random.integers(0, 9, 60)})
    probes = pd.DataFrame({"p": np.arange(80), "k": random.integers(0, 7, 80), "at": random.integers(-5, 70, 80)})
    found = R.asof_lookup(spark.createDataFrame(probes), spark.createDataFrame(log), "k", "v", "at", ["x"]).toPandas().set_index("p")["found_x"]
    for r in probes.itertuples():
        own = log[(log.k == r.k) & (log.v <= r.at)]
        assert plain(found[r.p]) == (plain(own.iloc[-1].x) if len(own) else None)


def test_deleted_only_after_resolution(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "gone"), (2, 1, "b")], "k int, v int, s string")
    assert [tuple(r) for r in R.drop_deleted(R.resolve_version(log, "k", "v"), F.col("s") == "gone").collect()] == [(2, 1, "b")]


def test_neighbours_outside_and_empty(spark):
    table = spark.createDataFrame([(10,), (20,), (None,)], "o int")
    probes = spark.createDataFrame([(5,), (10,), (15,), (20,), (25,), (None,)], "p int")
    want = {"EQ": [None, 10, None, 20, None], "LE": [None, 10, 10, 20, 20], "LT": [None, None, 10, 10, 20], "GE": [10, 10, 20, 20, None], "GT": [10, 20, 20, None, None]}
    for mode, values in want.items():
        found = {r.p: r.neighbor for r in R.neighbor_lookup(probes, table, "p", "o", mode).collect()}
        assert [found[p] for p in (5, 10, 15, 20, 25)] == values and found[None] is None, mode
    assert all(r.neighbor is None for r in R.neighbor_lookup(probes, table.where("o > 99"), "p", "o", "GE").collect())


def test_neighbours_over_many_ranges(spark):
    """Small ranges, frequent and equal probes and values, nulls, and probes of a wider type."""
    values = [None, *range(0, 200, 10)] * 3 + [50] * 300
    asked = [None] * 40 + [50.0] * 300 + [x / 2 for x in range(-20, 420, 5)]
    table, probes = spark.createDataFrame([(v,) for v in values], "o int"), spark.createDataFrame(list(enumerate(asked)), "i int, p double")
    known = sorted({v for v in values if v is not None})
    fits = {"EQ": lambda v, p: v == p, "LE": lambda v, p: v <= p, "LT": lambda v, p: v < p, "GE": lambda v, p: v >= p, "GT": lambda v, p: v > p}
    for mode, fit in fits.items():
        found = {r.i: r.neighbor for r in R.neighbor_lookup(probes, table, "p", "o", mode, range_rows=20).collect()}
        assert found == {i: None if p is None else (min if mode[0] == "G" else max)((v for v in known if fit(v, p)), default=None) for i, p in enumerate(asked)}, mode


def test_ranges_of_neighbours_do_not_grow(spark):
    """As many tasks as the rows need, each with about its share of them, though all probes are equal."""
    table, probes = spark.range(1000), spark.range(9000).select("id", F.lit(500).cast("long").alias("p"))
    for mode in ("EQ", "GE"):
        found = R.neighbor_lookup(probes, table, "p", "id", mode, range_rows=100)
        sizes = [n for n in found.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
        assert sum(sizes) == 9000 and max(sizes) <= 500, (mode, len(sizes), max(sizes))


def test_paths_of_cycles_and_orphans(spark):
    entries = spark.createDataFrame([(2, "a", 3, 4), (3, "b", 4, 4), (4, "f", 5, 8), (9, "x", 8, 4), (8, "y", 9, 4), (77, "lost", 6, 8)], "parent_id long, name string, file_id long, flags int")
    paths = N.build_paths(entries, F.col("flags") == 4)
    found = {r.file_id: r.path for r in paths.collect()}
    assert found == {3: "/a", 4: "/a/b", 5: "/a/b/f", 8: None, 9: None, 6: None}
    assert N.orphans(entries, paths).count() == 3
    back = N.resolve_paths(paths.where("path is not null").select("path"), entries)
    assert {r.path: r.file_id for r in back.collect()} == {"/a": 3, "/a/b": 4, "/a/b/f": 5}


def test_runs_in_buckets_equal_plain_runs(spark):
    df = spark.createDataFrame([(1, i, None if i % 11 == 0 else i // 3 % 2) for i in range(50)], "k int, o long, v long")
    one = B.collapse_runs(df, ["k"], "o", "v")
    many = B.collapse_runs(df, ["k"], "o", "v", F.call_function("div", F.col("o"), F.lit(7).cast("long")))
    first = lambda d: sorted(r.o for r in d.collect())
    assert set(first(many)) >= set(first(one)) - {0} and set(first(many)) - set(first(one)) <= {0}


def test_bits(spark):
    values = [0, 1, 5, -1, 1 << 62, -(1 << 63)]
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", M.bits_of("v").alias("b")).collect():
        assert r.b == [i for i in range(64) if (r.v % (1 << 64)) >> i & 1]


def test_packed_keys_keep_the_sign_bit(spark):
    df = spark.createDataFrame([(5, k) for k in range(16)], "o long, k int").select("k", X.packed_key("o", "k").alias("p"))
    assert all((r.k, r.o) == (r.t, 5) for r in df.select("k", X.key_type("p").alias("t"), X.key_id("p").alias("o")).collect())


def test_file_content_with_holes_and_ends(spark):
    inodes = spark.createDataFrame([(1, 10), (2, 0), (3, 6)], "private_id long, ds_size long")
    extents = spark.createDataFrame([(1, 0, 4, 7, 0), (1, 4, 4, 0, 0), (1, 8, 4, 9, 0), (3, 4, 4, 7, 0)], "file_id long, logical_addr long, length long, phys_block long, crypto_id long")
    blocks = spark.createDataFrame([(7, bytearray(b"abcd")), (9, bytearray(b"wxyz"))], "paddr long, data binary")
    found = {r.private_id: bytes(r.data) for r in E.file_content(inodes, extents, blocks, 4).collect()}
    assert found == {1: b"abcd\0\0\0\0wx", 2: b"", 3: b"\0\0\0\0ab"}
    pieces = sorted((r.private_id, r.part, bytes(r.data)) for r in E.file_content(inodes, extents, blocks, 4, limit=4).collect())
    assert pieces == [(1, 0, b"abcd"), (1, 1, b"\0\0\0\0"), (1, 2, b"wx"), (2, 0, b""), (3, 0, b"\0\0\0\0"), (3, 1, b"ab")]
    with pytest.raises(Exception, match="more than 3 bytes"):
        E.concat_pieces(blocks, "paddr", "paddr", "data", 3).collect()


def test_deep_chains_and_cycles(spark):
    """A chain past any fixed depth, and directories that hold themselves."""
    deep = 70
    rows = [(N.ROOT if i == 0 else 100 + i - 1, f"d{i}", 100 + i, 4) for i in range(deep)] + [(100 + deep - 1, "file", 900, 8), (100 + 2, "loop", 100, 4), (500, "x", 501, 4), (501, "y", 500, 4)]
    entries = spark.createDataFrame(rows, "parent_id long, name string, file_id long, flags int").coalesce(1)
    paths = N.build_paths(entries, F.col("flags") == 4)
    found = {r.file_id: r.path for r in paths.where("name <> 'loop'").collect()}
    want = "/" + "/".join(f"d{i}" for i in range(deep))
    assert found[100 + deep - 1] == want and found[900] == want + "/file" and found[500] is None and found[501] is None
    asked = spark.createDataFrame([(want + "/file",), ("/d0/no",)], "path string")
    assert {r.path: r.file_id for r in N.resolve_paths(asked, entries).collect()} == {want + "/file": 900, "/d0/no": None}
