"""One query per operator, over whole driver tables that play the roles of disk tables, and the same in SQL.

events is a log of versions (user_id = object, event_id = transaction, 'error' = deleted), region > nation > customer >
orders a directory tree, lineitem the extents and attributes of orders, documents the contents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from imagelake.functions import scalars as X
from imagelake.operators import blocks as B
from imagelake.operators import checkpoints as C
from imagelake.operators import extents as E
from imagelake.operators import findings as FI
from imagelake.operators import namespace as N
from imagelake.operators import resolve as R
from imagelake.operators import space as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: ids of the directory tree: each level has an offset of its own.
REGION, NATION, CUSTOMER, ORDER = 10, 100, 1000, 1_000_000_000
#: Transactions are fixed tenths of the log, so that what a query reads grows with the log.
CUT_SQL = "(SELECT max(event_id) * {} // 10 FROM events)"
EARLY, HALF, LATE = (CUT_SQL.format(tenths) for tenths in (1, 5, 9))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cuts(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The transactions after one, five and nine tenths of the log."""
    newest = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return newest // 10, newest * 5 // 10, newest * 9 // 10


def pieces(spark: SparkSession, sf_dir: str, size: int = 4096, pad: bool = True) -> DataFrame:
    """(doc_id, block, data): every whole text cut in blocks; an empty one is one block. Cut as an array, so no row repeats a text."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(data) / size).cast("int"), F.lit(1)) - 1
    part = lambda i: F.substring(data, i * size + 1, F.lit(size))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.rpad(part(i), size, F.lit(b"\0")) if pad else part(i))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("block", "data"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory entries of the tree: (parent_id, name, file_id, flags)."""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda parent, name, child, flags: [parent.cast("long").alias("parent_id"), name.alias("name"), child.cast("long").alias("file_id"), F.lit(flags).alias("flags")]
    return (
        t("region").select(row(F.lit(N.ROOT), F.col("r_name"), F.col("r_regionkey") + REGION, 4))
        .unionByName(t("nation").select(row(F.col("n_regionkey") + REGION, F.col("n_name"), F.col("n_nationkey") + NATION, 4)))
        .unionByName(t("customer").select(row(F.col("c_nationkey") + NATION, F.col("c_name"), F.col("c_custkey") + CUSTOMER, 4)))
        .unionByName(t("orders").select(row(F.col("o_custkey") + CUSTOMER, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderkey") + ORDER, 8)))
    )


TREE_SQL = """
    tree AS (
        SELECT 2::BIGINT AS parent_id, r_name AS name, (r_regionkey + 10)::BIGINT AS file_id, 4 AS flags FROM region
        UNION ALL SELECT n_regionkey + 10, n_name, n_nationkey + 100, 4 FROM nation
        UNION ALL SELECT c_nationkey + 100, c_name, c_custkey + 1000, 4 FROM customer
        UNION ALL SELECT o_custkey + 1000, 'o' || o_orderkey::VARCHAR, o_orderkey + 1000000000, 8 FROM orders)"""

PATH_SQL = """
    paths AS (
        SELECT 1 AS depth, '/' || r_name AS path, (r_regionkey + 10)::BIGINT AS file_id FROM region
        UNION ALL SELECT 2, '/' || r_name || '/' || n_name, n_nationkey + 100 FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 3, '/' || r_name || '/' || n_name || '/' || c_name, c_custkey + 1000
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 4, '/' || r_name || '/' || n_name || '/' || c_name || '/o' || o_orderkey::VARCHAR, o_orderkey + 1000000000
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as extents of a file: running sums of quantities; part 1 stands for a hole."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.sum(n).over(order) - n).alias("logical_addr"), n.alias("length"), F.when(F.col("l_partkey") % 10 == 1, 0).otherwise(F.col("l_partkey") * 100).cast("long").alias("phys_block"), (F.col("l_suppkey") * 1000).cast("long").alias("crypto_id"))


EXTENT_SQL = """
    ext AS (
        SELECT l_orderkey AS file_id,
            (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - l_quantity::BIGINT)::BIGINT AS logical_addr,
            l_quantity::BIGINT AS length, CASE WHEN l_partkey % 10 = 1 THEN 0 ELSE l_partkey * 100 END::BIGINT AS phys_block, (l_suppkey * 1000)::BIGINT AS crypto_id FROM lineitem)"""


# ---- sources, blocks


@query("""
    SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'tier2' ELSE 'main' END AS tier, count(*) AS n, sum(l_orderkey * 4096)::BIGINT AS total FROM lineitem GROUP BY 1""")
def s2_resolve_tier(spark, sf_dir):
    from imagelake.sources.images import TIER2, resolve_tier

    at = F.col("l_orderkey").cast("long") * 4096
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 1, at.bitwiseOR(F.lit(TIER2).cast("long"))).otherwise(at).alias("address"))
    return resolve_tier(rows, "address").groupBy("tier").agg(F.count("*").alias("n"), F.sum("offset").alias("total"))


@query()
def s1_read_blocks(spark, sf_dir):
    """The bytes of the lines' files as raw blocks, a task per 16 MiB, with how many are empty or hold a check sum of their own."""
    import glob
    import os

    from imagelake.sources.images import block_table, read_blocks

    path = f"{sf_dir}/lineitem.parquet".removeprefix("file:")
    local = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path] * os.path.exists(path)
    blocks = read_blocks(spark, local, range_bytes=16 << 20) if local else block_table(spark, path)
    return B.classify(blocks).groupBy("tier", "class").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("data")).alias("bytes"))


@query()
def s3_crc32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT doc_id, octet_length(encode(text)) AS n, lang = 'de' AS zeros, lang = 'de' OR text = '' AS empty FROM documents")
def b1_is_empty(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n", F.octet_length("text").cast("long")).withColumn("zeros", F.col("lang") == "de")
    data = F.when(F.col("zeros"), F.unhex(F.repeat(F.lit("00"), F.col("n").cast("int")))).otherwise(F.col("text").cast("binary"))
    return d.select("doc_id", "n", "zeros", B.is_empty(data).alias("empty"))


@query("""
    WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    b AS (SELECT doc_id, h, unnest(range(greatest(1, (length(h) + 8191) // 8192))) AS block FROM h),
    p AS (SELECT doc_id, block, rpad(substr(h, 8192*block+1, 8192), 8192, '0') AS h FROM b),
    q AS (SELECT doc_id, block, j, substr(h, 128*j+1, 128) AS h FROM p, range(64) r(j)),
    w AS (SELECT doc_id, block, 16*j + i AS i, ('0x' || substr(h, 8*i+7, 2) || substr(h, 8*i+5, 2) || substr(h, 8*i+3, 2) || substr(h, 8*i+1, 2))::BIGINT AS v FROM q, range(16) r(i))
    SELECT doc_id, block::INTEGER AS block, (sum(v) % 4294967295)::BIGINT AS s1, (sum(v * (1024 - i)) % 4294967295)::BIGINT AS s2 FROM w GROUP BY doc_id, block""")
def b2_fletcher64(spark, sf_dir):
    return pieces(spark, sf_dir).select("doc_id", "block", B.fletcher64("data").alias("s")).select("doc_id", "block", F.col("s")[0].alias("s1"), F.col("s")[1].alias("s2"))


@query("""
    SELECT o_orderkey, coalesce(list_extract([
        '0', 'Container Superblock', 'B-Tree', 'B-Tree Node', 'M-Tree', 'Spaceman', 'Spaceman CIB Address Block', 'Spaceman Chunk Info Block',
        'Spaceman Bitmap', 'Spaceman Free Queue', 'Extent List Tree', 'Object Map', 'Checkpoint Map', 'Volume Superblock', 'Filesystem Tree', 'Block Ref Tree',
        'Snap Meta Tree', 'NX Reaper', 'NX Reap List', 'OMap Snapshot', 'EFI Jumpstart', 'Fusion Middle Tree', 'Fusion WBC', 'Fusion WBC List',
        'ER State', 'G Bitmap', 'G Bitmap Tree', 'G Bitmap Block', 'ER Recovery Block', 'Snap Meta Ext', 'Integrity Meta', 'Fext Tree',
        'Reserved 20'
    ], (1 + CASE WHEN o_orderkey % 40 IN (2, 3) THEN o_custkey % 50 ELSE o_orderkey % 40 END)::INTEGER), 'Unknown') AS type_name FROM orders""")
def b4_object_type_name(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", B.object_type_name(F.col("o_orderkey") % 40, F.col("o_custkey") % 50).alias("type_name"))


@query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def b5_collapse_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return B.collapse_runs(rows, ["user_id"], "event_id", "event_type", F.call_function("div", F.col("event_id"), F.lit(2500).cast("long")))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS blocks, count(*) * 4096 AS bytes, min(l_orderkey) AS min_xid, max(l_orderkey) AS max_xid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def b6_block_census(spark, sf_dir):
    return B.block_census(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("""
    WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''),
    b AS (SELECT doc_id, h, unnest(range((length(h) + 31) // 32)) AS i FROM h),
    l AS (SELECT doc_id, i, substr(h, 32*i+1, 32) AS d FROM b)
    SELECT doc_id, (i * 16)::INTEGER AS "offset", rtrim(regexp_replace(d, '(..)', '\\1 ', 'g')) AS hex,
        array_to_string(list_transform(range(length(d) // 2), lambda j: CASE WHEN substr(d, 2*j+1, 2) >= '20' AND substr(d, 2*j+1, 2) < '7F' THEN chr(('0x' || substr(d, 2*j+1, 2))::INTEGER) ELSE '.' END), '') AS text FROM l""")
def b8_hexdump(spark, sf_dir):
    lines = pieces(spark, sf_dir, pad=False).select("doc_id", "block", F.explode(B.hexdump("data")).alias("l"))
    return lines.select("doc_id", (F.col("block") * 4096 + F.col("l.offset")).alias("offset"), "l.hex", "l.text")


# ---- checkpoints


@query(f"""
    SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS xid, 'latest' AS which FROM events GROUP BY user_id
    UNION ALL SELECT user_id, event_type, event_id, 'at' FROM events WHERE event_id = {HALF}""")
def c1_latest_superblock(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("xid"), F.col("event_id").alias("paddr"), "event_type")
    pick = lambda at, name: C.latest_superblock(rows, ["user_id"], at).select("user_id", "event_type", "xid", F.lit(name).alias("which"))
    return pick(None, "latest").unionByName(pick(cuts(spark, sf_dir)[1], "at"))


@query("""
    SELECT p_partkey, i AS slot, p_partkey + (p_size + i) % 50 AS address FROM part, range(50) r(i) WHERE i < p_size""")
def c2_ring_slots(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(50).alias("n"))
    return C.ring_slots(rows, "p_partkey", "p_size", "p_size", "n").select("p_partkey", "slot", "address")


@query("""
    WITH m AS (SELECT l_partkey AS oid, l_suppkey AS paddr, l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
    SELECT p_partkey AS oid, arg_min(paddr, block * 1000 + pos) AS paddr, min(block) AS xid FROM part LEFT JOIN m ON oid = p_partkey GROUP BY p_partkey""")
def c3_checkpoint_lookup(spark, sf_dir):
    m = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("oid"), F.col("l_suppkey").alias("paddr"), F.lit(1).alias("size"))
    maps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.array_sort(F.collect_list(m)).alias("mappings")).withColumn("xid", F.col("block"))
    return C.checkpoint_lookup(maps, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"))).select("oid", "paddr", "xid")


@query("""
    SELECT p_partkey, CASE WHEN r = 0 THEN 'No specific role' WHEN r <= 32 THEN
        concat_ws(', ', CASE WHEN r & 1 <> 0 THEN 'System' END, CASE WHEN r & 2 <> 0 THEN 'User' END, CASE WHEN r & 4 <> 0 THEN 'Recovery' END,
            CASE WHEN r & 8 <> 0 THEN 'VM' END, CASE WHEN r & 16 <> 0 THEN 'Preboot' END, CASE WHEN r & 32 <> 0 THEN 'Installer' END)
        ELSE CASE r >> 6 WHEN 1 THEN 'Data' WHEN 2 THEN 'Baseband' WHEN 3 THEN 'Update' WHEN 4 THEN 'Xart' WHEN 5 THEN 'Hardware' WHEN 6 THEN 'Backup' WHEN 7 THEN 'Reserved-7'
            WHEN 8 THEN 'Reserved-8' WHEN 9 THEN 'Enterprise' WHEN 10 THEN 'Reserved-10' WHEN 11 THEN 'Prelogin' ELSE '' END END AS roles
    FROM (SELECT p_partkey, CASE WHEN p_size <= 32 THEN p_size - 1 ELSE (p_size - 32) * 64 END::BIGINT AS r FROM part)""")
def c5_role_names(spark, sf_dir):
    role = F.when(F.col("p_size") <= 32, F.col("p_size") - 1).otherwise((F.col("p_size") - 32) * 64)
    return table(spark, sf_dir, "part").select("p_partkey", X.role_names(role).alias("roles"))


@query(f"""
    WITH s(xid, snapshot) AS (VALUES ({EARLY}, 'a'), ({HALF}, 'b'), ({LATE}, 'c')), v AS (SELECT xid, snapshot, user_id, max(event_id) AS event_id FROM events, s WHERE event_id <= xid GROUP BY ALL)
    SELECT xid::BIGINT AS xid, snapshot, v.user_id, event_id, event_type FROM v JOIN events USING (event_id) WHERE event_type <> 'error'""")
def c7_as_of_snapshot(spark, sf_dir):
    snaps = spark.createDataFrame(list(zip(cuts(spark, sf_dir), "abc", strict=True)), "xid long, snapshot string")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.as_of_snapshot(log, snaps, "user_id", "event_id", "xid", F.col("event_type") == "error")


@query(f"""
    WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS v FROM events WHERE event_id <= {EARLY} GROUP BY 1),
    b AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS v FROM events WHERE event_id <= {LATE} GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.t AS before_type, b.t AS after_type
    FROM a FULL JOIN b USING (user_id) WHERE a.v IS DISTINCT FROM b.v""")
def c8_snapshot_diff(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    state = lambda at: R.resolve_version(log, "user_id", "event_id", at)
    early, _, late = cuts(spark, sf_dir)
    return R.snapshot_diff(state(early), state(late), "user_id").select("user_id", "change", F.col("before.event_type").alias("before_type"), F.col("after.event_type").alias("after_type"))


# ---- space


@query("SELECT o_orderkey, i::INTEGER AS bit FROM orders, range(32) r(i) WHERE (o_custkey >> i) & 1 = 1")
def m2_bits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(M.bits_of("o_custkey", 32)).alias("bit"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def m3_scan_allocated(spark, sf_dir):
    allocated = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.scan_allocated(table(spark, sf_dir, "lineitem"), allocated, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@query("SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS total, sum(l_linenumber)::BIGINT AS free FROM lineitem GROUP BY 1")
def m4_space_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("block_count"), F.col("l_linenumber").cast("long").alias("free_count"))
    return M.space_totals(rows, ["l_suppkey"])


# ---- trees and keys


@query(f"WITH {PATH_SQL} SELECT depth, count(*) AS n, sum(file_id)::BIGINT AS total FROM paths GROUP BY 1")
def r3_tree_nodes(spark, sf_dir):
    from imagelake.operators.trees import reachable

    found = reachable(entries(spark, sf_dir).select(F.col("parent_id").alias("node"), F.col("file_id").alias("child")), [N.ROOT])
    return found.where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"), F.sum("node").alias("total"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 40 AND o_custkey < 50")
def r4_scan_prefix(spark, sf_dir):
    from imagelake.operators.trees import scan_range

    return scan_range(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 40, 50, ["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderkey AS oid, (o_custkey % 16)::INTEGER AS kind FROM orders")
def r5_split_key(spark, sf_dir):
    key = X.packed_key("o_orderkey", F.col("o_custkey") % 16)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.key_id(key).alias("oid"), X.key_type(key).alias("kind"))


# ---- joins


@query("""
    SELECT o_orderkey, l.event_id AS found_event_id, l.event_type AS found_event_type
    FROM (SELECT o_orderkey, o_custkey % (SELECT max(user_id) + 1 FROM events) AS user_id, o_orderkey * 7919 % (SELECT max(event_id) + 1 FROM events) AS at FROM orders) p
    ASOF LEFT JOIN events l ON p.user_id = l.user_id AND p.at >= l.event_id""")
def j1_asof_lookup(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    users, versions = log.agg(F.max("user_id") + 1, F.max("event_id") + 1).first()
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % users).alias("user_id"), (F.col("o_orderkey") * 7919 % versions).alias("at"))
    return R.asof_lookup(probes, log, "user_id", "event_id", "at", ["event_id", "event_type"]).drop("user_id", "at")


@query(f"SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_id <= {LATE} GROUP BY 1")
def j2_resolve_version(spark, sf_dir):
    return R.resolve_version(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", cuts(spark, sf_dir)[2])


@query("SELECT * FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) WHERE event_type <> 'error'")
def j3_drop_deleted(spark, sf_dir):
    resolved = R.resolve_version(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return R.drop_deleted(resolved, F.col("event_type") == "error")


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, p.event_id, (SELECT {f}(o_orderkey) FROM orders WHERE o_orderkey {op} p.event_id * 3) AS neighbor FROM events p" for m, f, op in (("EQ", "max", "="), ("LE", "max", "<="), ("LT", "max", "<"), ("GE", "min", ">="), ("GT", "min", ">"))))
def j4_neighbor_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 3).alias("at"))
    orders = table(spark, sf_dir, "orders")
    parts = [R.neighbor_lookup(probes, orders, "at", "o_orderkey", mode).select(F.lit(mode).alias("mode"), "event_id", "neighbor") for mode in R.MODES]
    return FI.findings(parts)


@query(f"WITH {TREE_SQL} SELECT parent_id, name, file_id, (flags & 15) << 12 AS mode FROM tree WHERE parent_id IN (SELECT file_id FROM tree WHERE flags = 4)")
def j5_list_directory(spark, sf_dir):
    rows = entries(spark, sf_dir)
    directories = rows.where("flags = 4").select(F.col("file_id").alias("parent_id"))
    return N.list_directory(rows, directories).select("parent_id", "name", "file_id", F.col("mode").cast("int").alias("mode"))


@query()
def j6_filename_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", B.filename_hash(True)("p_name").alias("hash"))


@query("""
    SELECT o_orderkey, 'exact' AS kind, c_custkey AS file_id FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad((o_custkey + 3)::VARCHAR, 9, '0') AND c_nationkey = o_orderkey % 25
    UNION ALL SELECT o_orderkey, 'folded', c_custkey FROM orders LEFT JOIN customer ON lower(c_name) = lower('CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0')) AND c_nationkey = o_orderkey % 25""")
def j7_lookup_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("file_id"))
    orders = table(spark, sf_dir, "orders")
    probe = lambda name: orders.select("o_orderkey", (F.col("o_orderkey") % 25).alias("parent_id"), name.alias("name"))
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    exact = N.lookup_name(probe(F.concat(F.lit("Customer#"), pad(F.col("o_custkey") + 3))), names).select("o_orderkey", F.lit("exact").alias("kind"), "file_id")
    folded = N.lookup_name(probe(F.concat(F.lit("CUSTOMER#"), pad(F.col("o_custkey")))), names, fold=True).select("o_orderkey", F.lit("folded").alias("kind"), "file_id")
    return exact.unionByName(folded)


@query(f"WITH {PATH_SQL} SELECT path, file_id FROM paths WHERE depth = 4 UNION ALL SELECT path || 'x', NULL FROM paths WHERE depth = 3")
def j8_resolve_paths(spark, sf_dir):
    rows = entries(spark, sf_dir)
    paths = N.build_paths(rows, F.col("flags") == 4)
    asked = paths.where("depth = 4").select("path").unionByName(paths.where("depth = 3").select(F.concat("path", F.lit("x")).alias("path")))
    return N.resolve_paths(asked, rows)


@query(f"WITH {PATH_SQL} SELECT file_id, depth, path FROM paths")
def j9_build_paths(spark, sf_dir):
    return N.build_paths(entries(spark, sf_dir), F.col("flags") == 4).select("file_id", "depth", "path")


@query("""
    WITH a AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_suppkey % 16 END) AS algo, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS hs, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS fs FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1)
    SELECT o_orderkey AS ino, CASE WHEN o_orderkey % 7 = 0 THEN 'directory' ELSE 'file' END AS kind,
        CASE WHEN o_orderkey % 7 = 0 THEN o_custkey WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 77 WHEN algo IN (3,4,7,8,9,10,11,12,13,14) THEN hs ELSE fs END ELSE coalesce(o_custkey, 0) END::BIGINT AS size
    FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def j10_stat(spark, sf_dir):
    key = F.col("o_orderkey")
    flag = lambda test, value: F.when(test, value).otherwise(0).cast("long")
    inodes = table(spark, sf_dir, "orders").select(key.alias("ino"), F.when(key % 7 == 0, 0x4000).otherwise(0x8000).cast("long").alias("mode"), flag(key % 2 == 0, N.COMPRESSED).alias("bsd_flags"), flag(key % 5 == 0, N.HAS_UNCOMPRESSED_SIZE).alias("internal_flags"), F.lit(77).cast("long").alias("uncompressed_size"), F.col("o_custkey").alias("nchildren_nlink"), F.col("o_custkey").cast("long").alias("ds_size"))
    first = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").withColumn("r", F.row_number().over(first)).where("r = 1")
    xattrs = lines.select(F.col("l_orderkey").alias("ino"), F.when(F.col("l_linenumber") == 1, N.COMPRESSION_ATTRIBUTE).otherwise(N.RESOURCE_FORK).alias("name"), (F.col("l_suppkey") % 16).alias("algo"), F.col("l_partkey").alias("header_size"), F.col("l_partkey").alias("stream_size"))
    return N.stat(inodes, xattrs).select("ino", "kind", F.col("size").cast("long").alias("size"))


@query("SELECT l_orderkey AS ino, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS names FROM lineitem GROUP BY 1")
def j11_list_xattrs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ino"), F.col("l_suppkey").cast("string").alias("name"))
    return N.list_xattrs(rows).select("ino", F.array_join("names", ",").alias("names"))


@query("SELECT p_name AS file_id, count(*) AS links, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS names FROM part GROUP BY 1 HAVING count(*) > 1")
def j14_hardlinks(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("file_id"), F.col("p_partkey").alias("parent_id"), F.col("p_brand").alias("name"))
    return N.hardlinks(names).select("file_id", "links", F.array_join(F.transform("names", lambda x: x["parent_id"].cast("string")), ",").alias("names"))


@query(f"""
    WITH {EXTENT_SQL}, r AS (SELECT o_orderkey AS request_id, o_orderkey AS file_id, o_custkey % 40 AS o, 1 + o_custkey % 60 AS n FROM orders)
    SELECT request_id, greatest(o, logical_addr)::BIGINT AS "offset", (least(o + n, logical_addr + length) - greatest(o, logical_addr))::BIGINT AS size,
        CASE WHEN phys_block = 0 THEN 0 ELSE phys_block + (greatest(o, logical_addr) - logical_addr) // 8 END::BIGINT AS phys_block, ((greatest(o, logical_addr) - logical_addr) % 8)::BIGINT AS skip, phys_block = 0 AS hole
    FROM r JOIN ext USING (file_id) WHERE greatest(o, logical_addr) < least(o + n, logical_addr + length)""")
def j15_read_ranges(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 40).cast("long").alias("offset"), (1 + F.col("o_custkey") % 60).cast("long").alias("size"))
    return E.read_ranges(requests, extents(spark, sf_dir), 8, bin_size=64).drop("file_id")


@query(f"""
    WITH {EXTENT_SQL} SELECT file_id, (logical_addr // 8 + i)::BIGINT AS file_block, CASE WHEN phys_block = 0 THEN 0 ELSE phys_block + i END::BIGINT AS paddr, CASE WHEN crypto_id = 0 THEN 0 ELSE crypto_id + i END::BIGINT AS crypto_unit
    FROM ext, range(10) r(i) WHERE i < ceil(length / 8.0)""")
def j16_explode_extents(spark, sf_dir):
    return E.explode_extents(extents(spark, sf_dir), 8)


@query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def j17_file_content(spark, sf_dir):
    """Each text as a file: its blocks lie in one run, whose extent and inode file_content reads."""
    stored = pieces(spark, sf_dir).select((F.col("doc_id") * 1_000_000 + 1 + F.col("block")).alias("paddr"), "data")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("private_id"), F.octet_length("text").cast("long").alias("ds_size"))
    zero = F.lit(0).cast("long")
    runs = files.select(F.col("private_id").alias("file_id"), zero.alias("logical_addr"), F.col("ds_size").alias("length"), (F.col("private_id") * 1_000_000 + 1).alias("phys_block"), zero.alias("crypto_id"))
    read = E.file_content(files, runs, stored, 4096)
    return read.select(F.col("private_id").alias("doc_id"), F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


@query("""
    SELECT doc_id, octet_length(encode(text)) <= 3804 AS embedded, md5(text) AS digest FROM documents""")
def j12_xattr_values(spark, sf_dir):
    from imagelake.operators.contents import xattr_values

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ino"), F.col("text").cast("binary").alias("data"))
    small = F.octet_length("data") <= 3804
    blocks = pieces(spark, sf_dir).select((F.col("doc_id") * 1_000_000 + 1 + F.col("block")).alias("paddr"), "data")
    size = F.octet_length("data").cast("long")
    ext = d.where(~small).select(F.col("ino").alias("file_id"), F.lit(0).cast("long").alias("logical_addr"), size.alias("length"), (F.col("ino") * 1_000_000 + 1).alias("phys_block"), F.lit(0).cast("long").alias("crypto_id"))
    xattrs = d.select("ino", F.lit("a").alias("name"), F.when(small, F.col("data")).alias("data"), F.when(~small, F.col("ino")).alias("stream_id"), F.when(~small, size).alias("stream_size"))
    return xattr_values(xattrs, ext, blocks, 4096).select(F.col("ino").alias("doc_id"), "embedded", F.md5("value").alias("digest"))


@query("SELECT md5(text) AS digest, count(*) AS owners, sum(octet_length(encode(text)))::BIGINT AS bytes, (sum(octet_length(encode(text))) - max(octet_length(encode(text))))::BIGINT AS saved FROM documents GROUP BY 1 HAVING count(*) > 1")
def j19_shared_extents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("n"))
    return E.shared_extents(d, "digest", "n")


# ---- codecs


@query("SELECT doc_id, 'ok' AS status, md5(text) AS digest FROM documents")
def d1_decompress_chunks(spark, sf_dir):
    from imagelake.operators.contents import compress_zlib, decompress_chunks

    d = table(spark, sf_dir, "documents").select("doc_id", compress_zlib(F.col("text").cast("binary")).alias("src"), F.lit("zlib").alias("method"), F.octet_length("text").cast("long").alias("dst_len"))
    return decompress_chunks(d, "method", "src", "dst_len").select("doc_id", "status", F.md5("data").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def d2_decompress_files(spark, sf_dir):
    """Texts cut in 4 KiB chunks, each compressed, then decompressed and joined again."""
    from imagelake.operators.contents import compress_zlib, decompress_chunks

    parts = pieces(spark, sf_dir, pad=False)
    packed = parts.select("doc_id", "block", compress_zlib("data").alias("src"), F.lit("zlib").alias("method"), F.octet_length("data").cast("long").alias("dst_len"))
    return E.concat_pieces(decompress_chunks(packed, "method", "src", "dst_len").where("status = 'ok'"), "doc_id", "block", "data").select("doc_id", F.md5("data").alias("digest"))


@query("SELECT doc_id, true AS same, greatest(1, (octet_length(encode(coalesce(text, ''))) + 4095) // 4096)::BIGINT AS blocks FROM documents")
def d3_decrypt_blocks(spark, sf_dir):
    """Every block of every whole text encrypted and decrypted again; same: no block kept its bytes, and all came back."""
    from imagelake.operators.contents import xts_blocks

    key = bytes(range(32))
    clear = pieces(spark, sf_dir).select("doc_id", "data", F.col("data").alias("plain"), (F.col("doc_id") * 1_000_000 + F.col("block") + 1).alias("tweak"))
    there = xts_blocks(clear, key, "data", "tweak", decrypt=False).withColumn("secret", F.col("data"))
    back = xts_blocks(there, key, "data", "tweak", decrypt=True)
    return back.groupBy("doc_id").agg(F.bool_and((F.col("data") == F.col("plain")) & (F.col("secret") != F.col("plain"))).alias("same"), F.count("*").alias("blocks"))


# ---- scalars

COLOURS = {1: "red", 2: "green", 4: "blue", 8: "cyan", 16: "pink", 32: "grey"}


def _flags_sql(value: str, names: dict[int, str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN {value} & {b} <> 0 THEN '{n}' END" for b, n in names.items()) + ")"


@query(f"SELECT p_partkey, {_flags_sql('p_size', COLOURS)} AS names FROM part")
def x1_flag_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.flag_names("p_size", COLOURS).alias("names"))


@query(f"SELECT p_partkey, CASE p_size {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in COLOURS.items())} ELSE '' END AS name FROM part")
def x2_enum_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.enum_name("p_size", COLOURS).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(((epoch_us(ts) % 1000000) * 1000 + 7)::VARCHAR, 9, '0') AS text, ts AS back FROM events")
def x3_ns_to_string(spark, sf_dir):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7
    return table(spark, sf_dir, "events").select("event_id", X.ns_to_string(ns).alias("text"), X.ns_to_timestamp(ns).cast("timestamp_ntz").alias("back"))


@query("""
    WITH h AS (SELECT doc_id, upper(md5(text)) AS h FROM documents)
    SELECT doc_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS uuid,
        concat_ws('-', h[7:8] || h[5:6] || h[3:4] || h[1:2], h[11:12] || h[9:10], h[15:16] || h[13:14], h[17:20], h[21:32]) AS guid FROM h""")
def x4_uuid_string(spark, sf_dir):
    raw = F.unhex(F.md5(F.col("text").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", X.uuid_string(raw).alias("uuid"), X.guid_string(raw).alias("guid"))


@query("SELECT doc_id, md5(hex(encode(text))) AS digest FROM documents")
def x5_hex_string(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.hex_string(F.col("text").cast("binary")).cast("binary")).alias("digest"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: unicode(c)), ',') AS points FROM part")
def x6_code_points(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.code_points("p_name"), ",").alias("points"))


@query("""
    SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS raw, CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END AS folded FROM part""")
def x7_compare_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.compare_names("p_name", "p_type").alias("raw"), X.compare_names("p_name", "p_type", True).alias("folded"))


@query("""
    SELECT p_partkey, CASE p_size % 16 WHEN 1 THEN 'fifo' WHEN 2 THEN 'character device' WHEN 4 THEN 'directory' WHEN 6 THEN 'block device' WHEN 8 THEN 'regular'
        WHEN 10 THEN 'symlink' WHEN 12 THEN 'socket' WHEN 14 THEN 'whiteout' ELSE '' END AS kind FROM part""")
def x8_mode_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.mode_type((F.col("p_size") % 16) * 4096 + 420).alias("kind"))


@query("""
    SELECT o_orderkey, o_orderkey AS length, (o_custkey % 256)::INTEGER AS flags, o_orderkey AS ext_length, (o_custkey % 16)::INTEGER AS kind, (o_custkey % 1024)::INTEGER AS name_len, (o_orderkey % 4194304)::INTEGER AS name_hash FROM orders""")
def x9_bit_fields(spark, sf_dir):
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    word = F.shiftleft(c % 256, 56).bitwiseOR(k)
    kinds = F.shiftleft(c % 16, 60).bitwiseOR(k)
    name = F.shiftleft(k % 4194304, 10).bitwiseOR(c % 1024)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.length_of(word).alias("length"), X.flags_of(word).alias("flags"), X.extent_length(kinds).alias("ext_length"), X.extent_kind(kinds).alias("kind"), X.name_length(name).alias("name_len"), X.name_hash(name).alias("name_hash"))


@query("""
    SELECT 'line without order' AS kind, l_orderkey AS object_id, l_orderkey::VARCHAR AS detail FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'customer without order', c_custkey, c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'large discount', l_orderkey, l_linenumber::VARCHAR FROM lineitem WHERE l_discount > 0.09""")
def f1_findings(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return FI.findings([
        FI.missing_reference(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'P'"), "o_orderkey", "line without order"),
        FI.missing_reference(t("customer"), "c_custkey", t("orders"), "o_custkey", "customer without order"),
        FI.failed_check(t("lineitem"), F.col("l_discount") > 0.09, "large discount", "l_orderkey", F.col("l_linenumber")),
    ])


@query("""
    WITH x AS (SELECT l_orderkey AS ino, l_partkey AS p FROM lineitem WHERE l_suppkey % 2 = 0),
    m AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS paddr FROM events GROUP BY 1),
    f AS (
        SELECT 'compressed without attribute' AS kind, o_orderkey AS object_id, '32' AS detail FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey NOT IN (SELECT ino FROM x)
        UNION ALL SELECT CASE WHEN p % 13 = 0 THEN 'short compression header' WHEN p % 11 = 0 THEN 'bad compression magic' WHEN p % 16 NOT IN (3, 4, 7, 8, 9, 10, 11, 12, 13, 14) THEN 'unknown compression method' END,
            ino, CASE WHEN p % 13 <> 0 THEN (p % 16)::VARCHAR END FROM x
        UNION ALL SELECT CASE WHEN paddr IS NULL THEN 'no map entry' WHEN t = 'error' THEN 'deleted map entry referenced' WHEN p_partkey IS NULL THEN 'no block' WHEN p_size % 2 = 1 THEN 'bad check sum' END,
            c_custkey, paddr::VARCHAR FROM customer LEFT JOIN m ON user_id = c_custkey LEFT JOIN part ON p_partkey = paddr
        UNION ALL SELECT 'unknown object type', o_orderkey, (o_orderkey % 40)::VARCHAR || '/' || (o_custkey % 50)::VARCHAR FROM orders
            WHERE CASE WHEN o_orderkey % 40 IN (2, 3) THEN o_custkey % 50 ELSE o_orderkey % 40 END > 32
        UNION ALL SELECT 'line without order', l_orderkey, l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
    SELECT 'image' AS image_id, kind, object_id::BIGINT AS object_id, detail FROM f WHERE kind IS NOT NULL""")
def f1_checks(spark, sf_dir):
    """The checks of maps, compressed files, types and references over driver tables in the shape of decoded ones."""
    t = lambda name: table(spark, sf_dir, name).withColumn("image_id", F.lit("image"))
    part = F.col("l_partkey")
    head = F.concat(F.when(part % 11 == 0, "00000000").otherwise("66706D63"), F.lpad(F.hex(part % 16), 2, "0"), F.lit("0" * 22))
    xattrs = t("lineitem").select("image_id", F.col("l_orderkey").alias("ino"), F.when(F.col("l_suppkey") % 2 == 0, N.COMPRESSION_ATTRIBUTE).otherwise("user.note").alias("name"), F.unhex(F.when(part % 13 == 0, "6670").otherwise(head)).alias("data"))
    inodes = t("orders").select("image_id", F.col("o_orderkey").alias("ino"), F.when(F.col("o_custkey") % 4 == 0, N.COMPRESSED).otherwise(0).alias("bsd_flags"))
    log = t("events").select("image_id", F.col("user_id").alias("oid"), F.col("event_id").alias("xid"), (F.col("event_type") == "error").cast("long").alias("flags"), F.col("event_id").alias("paddr"))
    stored = t("part").select("image_id", F.col("p_partkey").alias("paddr"), F.when(F.col("p_size") % 2 == 0, "Metadata").otherwise("Data").alias("class"))
    headers = t("orders").select("image_id", F.col("o_orderkey").alias("paddr"), (F.col("o_orderkey") % 40).alias("o_type"), (F.col("o_custkey") % 50).alias("o_subtype"))
    return FI.findings([
        FI.compression_findings(inodes, xattrs),
        FI.map_findings(t("customer").select("image_id", F.col("c_custkey").alias("oid")), R.resolve_version(log, ["image_id", "oid"], "xid"), stored),
        FI.type_findings(headers),
        FI.reference_findings(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus <> 'P'"), "o_orderkey", "line without order"),
    ])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each directory's path with the number and sum of what it holds at a transaction: resolve, drop deleted, paths, roll-up."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    live = R.drop_deleted(R.resolve_version(log, "user_id", "event_id", cuts(spark, sf_dir)[2]), F.col("event_type") == "error")
    paths = N.build_paths(entries(spark, sf_dir), F.col("flags") == 4)
    files = paths.where("depth = 4").select((F.col("parent_id") - CUSTOMER).alias("user_id"), F.regexp_replace("path", "/[^/]*/[^/]*$", "").alias("dir"))
    return files.join(live, "user_id").groupBy("dir").agg(F.count("*").alias("files"), F.countDistinct("user_id").alias("owners"), F.max("event_id").alias("newest"))


@query(f"""
    WITH {PATH_SQL}, live AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id <= {LATE} GROUP BY 1)
    SELECT '/' || r_name || '/' || n_name AS dir, count(*) AS files, count(DISTINCT user_id) AS owners, max(event_id) AS newest
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN live ON user_id = c_custkey WHERE t <> 'error' GROUP BY 1""")
def w2_directory_rollup(spark, sf_dir):
    return flagship(spark, sf_dir)
