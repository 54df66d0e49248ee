"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.cells import Rows, pairs_of_cells, whole_cells
from imagelake.llm.shared import broadcast_if_small, connected_components, cut
from imagelake.llm.text import LOWER, U64, chunks, mix, stream, word_hashes, words

REGISTER_BITS = 7  # 128 buckets
MANTISSA_BITS = 10
BUCKETS = 1 << REGISTER_BITS
#: Where an empty bucket looks for a full one: for each bucket, the others in a fixed random order.
_PROBES = np.stack([np.random.default_rng(j).permutation(BUCKETS) for j in range(BUCKETS)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts end to end, and each text's first (n + 1).

    Words are runs of bytes that aren't ASCII white space, A-Z in lower case. A text with fewer words than a shingle has its
    whole sequence as one; a text without words has none.
    """
    data = LOWER[data]
    starts, lengths, first = words(data, offsets)
    w = word_hashes(data, starts, lengths)
    n_words = np.diff(first)
    factors = stream(size, 21) | U64(1)
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(w) - size + 1, 0), U64)
        for k in range(size):
            rolled += w[k : k + len(rolled)] * factors[k]
        counts = np.maximum(n_words - size + 1, 0)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        counts[short] = 1
        at = np.concatenate(([0], np.cumsum(counts)))
        where = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], counts)
        long = np.repeat(n_words >= size, counts)
        hashes = np.empty(at[-1], U64)
        hashes[long] = rolled[where[long]]
        for i in short:
            own = w[first[i] : first[i + 1]]
            hashes[at[i]] = (own * factors[: len(own)]).sum(dtype=U64) + U64(len(own))
    hashes = mix(hashes)
    for i in range(n):
        hashes[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[at[:-1][counts > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return hashes[fresh], kept[at]


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) HyperMinHash registers of sorted sets: 0 if empty, else 1 + leading zeros and mantissa of the least hash.

    Empty buckets of a set that has others take the register of the first full bucket in their probe order.
    """
    n = len(at) - 1
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(n), np.diff(at))
    bucket = (hashes >> U64(64 - REGISTER_BITS)).astype(np.int64)
    place = row * BUCKETS + bucket
    lead = np.ones(len(place), bool)
    lead[1:] = place[1:] != place[:-1]  # sets are sorted, so a bucket's least hash comes first
    rest = hashes[lead] << U64(REGISTER_BITS)
    zeros = 53 - np.frexp((rest >> U64(11)).astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(zeros, 53)
    mantissa = ((rest << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA_BITS)).astype(np.int64)
    out.reshape(-1)[place[lead]] = ((zeros << MANTISSA_BITS) | mantissa) + 1
    full = out > 0
    todo, column = np.nonzero(~full & full.any(axis=1, keepdims=True))
    source = out.copy()
    for step in range(BUCKETS):
        if not len(todo):
            break
        probe = _PROBES[column, step]
        found = full[todo, probe]
        out[todo[found], column[found]] = source[todo[found], probe[found]]
        todo, column = todo[~found], column[~found]
    return out


def band_keys(regs: np.ndarray, rows_in_band: int) -> np.ndarray:
    """(texts, bands) hashes of runs of rows_in_band compressed registers."""
    bands = BUCKETS // rows_in_band
    parts = regs[:, : bands * rows_in_band].reshape(len(regs), bands, rows_in_band).astype(U64)
    factors = stream(rows_in_band, 31) | U64(1)
    with np.errstate(over="ignore"):
        return mix((parts * factors).sum(axis=2, dtype=U64) + stream(bands, 37)).view(np.int64)


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard from the number of equal registers, less the collisions expected of two unrelated sets of these sizes.

    Per bucket two sets' least hashes agree in leading zeros and mantissa by chance with probability about
    0.1699 * 2**-MANTISSA_BITS * 4q / (1 + q)**2, q the ratio of the sizes.
    """
    q = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.169919487159739 * 4 * q / (1 + q) ** 2 / (1 << MANTISSA_BITS)
    return (same / BUCKETS - chance) / (1 - chance)


def signatures(docs: DataFrame, id_column: str, text_column: str, shingle: int, rows_in_band: int) -> DataFrame:
    """(id, n, d1, d2, regs, bands): the set's size, a 128-bit digest of it, its registers and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                hashes, at = shingle_sets(data, offsets, shingle)
                n = np.diff(at)
                full = np.flatnonzero(n)
                digests = np.zeros((2, hi - lo), U64)
                for k, salt in enumerate((0x51ED270B, 0x2545F491)):
                    if len(full):
                        digests[k, full] = np.add.reduceat(mix(hashes ^ U64(salt)), at[:-1][full])
                regs = registers(hashes, at)
                keys = band_keys(regs, rows_in_band)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.reshape(-1), pa.int64())),
                    ],
                    ["id", "n", "d1", "d2", "regs", "bands"],
                )

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n long, d1 long, d2 long, regs binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, shingles array<long>) of the documents in wanted (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                hashes, at = shingle_sets(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))], ["id", "shingles"])

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.join(broadcast_if_small(wanted, n_wanted, 16), "id", "left_semi").mapInArrow(run, "id long, shingles array<long>")


def _same_registers(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b and the estimated Jaccard."""
    side = lambda k: reps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(("a", "b", "n_a", "n_b", "regs_a", "regs_b"))}
            a, b = (np.frombuffer(b"".join(columns[x].to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in ("regs_a", "regs_b"))
            n_a, n_b = (columns[x].to_numpy() for x in ("n_a", "n_b"))
            yield pa.RecordBatch.from_arrays([*(columns[x] for x in ("a", "b", "n_a", "n_b")), pa.array(estimate((a == b).sum(axis=1), n_a, n_b))], ["a", "b", "n_a", "n_b", "estimate"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, estimate double")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have a Jaccard similarity of percent / 100 or more."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s_{k}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


CELL = ("key", "i", "j")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """members (key, size, id, ...) with a cell: the pairs of blocks of about `block` members that each member takes part in."""
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")
    return (
        members.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("size", "parts", "other")
        .repartition(*CELL)
        .sortWithinPartitions(*CELL, "id")
    )


def _pairs_in_cells(percent: int, margin: float, exact: bool):
    """Pairs of each cell from different components, first met in this band, whose estimate allows the similarity.

    With exact the rows hold the full sets: pairs are verified at once, and of several links between two components one is enough.
    """
    names = (*CELL, "own", "band", "id", "component", "n", "regs", "bands", *(["shingles"] if exact else []))

    def arrays(batch: pa.RecordBatch) -> Rows:
        rows = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(names[:8])}
        rows["regs"] = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint16).reshape(-1, BUCKETS)
        rows["bands"] = batch.column(9).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        if exact:
            rows["shingles"] = np.empty(batch.num_rows, object)
            rows["shingles"][:] = [batch.column(10)[k].values.to_numpy(zero_copy_only=False).view(U64) for k in range(batch.num_rows)]  # sorted so
        return rows

    def similar(rows: Rows, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs, sorted by a, are similar on their full sets."""
        out = np.zeros(len(a), bool)
        for begin, end in _runs(a):
            one, others = rows["shingles"][a[begin]], [rows["shingles"][x] for x in b[begin:end]]
            sizes = np.array([len(x) for x in others])
            every = np.concatenate(others)
            at = np.minimum(np.searchsorted(one, every), len(one) - 1)
            both = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            out[begin:end] = 100 * both >= percent * (sizes + len(one) - both)
        return out

    def sieve(rows: Rows, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = rows["n"]
        keep = (rows["component"][a] != rows["component"][b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[keep], b[keep]
        keep = estimate((rows["regs"][a] == rows["regs"][b]).sum(axis=1), n[a], n[b]) >= percent / 100 - margin
        a, b = a[keep], b[keep]
        earlier = np.arange(rows["bands"].shape[1]) < rows["band"][a][:, None]
        keep = ~((rows["bands"][a] == rows["bands"][b]) & earlier).any(axis=1)
        a, b = a[keep], b[keep]
        if exact and len(a):
            keep = similar(rows, a, b)
            a, b = a[keep], b[keep]
            ends = np.sort(np.stack([rows["component"][a], rows["component"][b]], axis=1), axis=1)
            once = np.unique(ends, axis=0, return_index=True)[1]
            a, b = a[once], b[once]
        return rows["id"][a], rows["id"][b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, arrays, CELL):
            for a, b in pairs_of_cells(rows, CELL, 20_000):
                a, b = sieve(rows, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return names, run


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist()
    return zip(at[:-1], at[1:], strict=True)


def near_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    percent: int = 80,
    rows_in_band: int = 5,
    deviations: float = 4.0,
    block: int = 500,
    small: int = 50,
) -> DataFrame:
    """Groups of documents that links join: a link is a Jaccard similarity of shingle sets of percent / 100 or more.

    Documents with the same set are one class. Classes that share a band of compressed registers are candidates. First
    each class meets one class of each of its bands, the pairs are sieved by the collision-corrected estimate and
    verified on full sets. Bands whose classes then still lie in several components go on: all their pairs from
    different components are compared by estimate, in blocks, and verified: those of bands with more than `small` classes
    in the task that compares them, the others by joins. A pair inside a component can't
    change the groups, so it isn't compared. The sieve's margin is `deviations` standard deviations of the estimate.

    Returns (doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id that links reach, kept whether
    it is the row's own. A null or empty text, or one without words, has no shingles and is linked with nothing: its
    component is its own doc_id. Rows that repeat an id fall together; a null id is linked with nothing and not kept.
    An empty table gives no rows. Other columns are not read.
    """
    margin = deviations * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5
    rows = cut(signatures(docs, id_column, text_column, shingle, rows_in_band))
    full = rows.where("n > 0 and id is not null")
    classes = cut(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    # a class's registers are those of its representative's row; repeated ids give one row
    reps = full.join(classes.select("rep", "d1", "d2", "n"), ["d1", "d2", "n"]).where("id = rep").select("id", "n", "regs", "bands").dropDuplicates(["id"])
    reps = cut(reps)
    members = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(shared, "key").select("key", "band", "id", "pivot"))
    pairs = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    likely = cut(_same_registers(pairs, reps).where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("estimate") >= percent / 100 - margin)).select("a", "b"))
    ends = lambda x: x.select(F.col("a").alias("id")).union(x.select(F.col("b").alias("id"))).distinct()

    def verified(candidates: DataFrame) -> DataFrame:
        wanted = cut(ends(candidates))
        sets = cut(full_sets(docs, wanted, wanted.count(), id_column, text_column, shingle).dropDuplicates(["id"]))
        return cut(_verify(candidates, sets, percent))

    links = verified(likely)
    components = cut(connected_components(links))
    placed = members.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut(placed.drop("pivot"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    rest = cut(placed.join(open_keys, "key").join(reps, "id").select("key", "size", "band", "id", "component", "n", "regs", "bands"))
    # the pairs of small bands go on as rows; in large ones they are verified where they are, so that their number stays inside a task
    names, run = _pairs_in_cells(percent, margin, exact=False)
    few = _cells(rest.where(F.col("size") <= small), block).select(*names).mapInArrow(run, "a long, b long").distinct()
    few = cut(few.join(likely, ["a", "b"], "left_anti"))
    more = verified(few)
    large = rest.where(F.col("size") > small)
    wanted = cut(large.select("id").distinct())
    if not wanted.isEmpty():
        sets = full_sets(docs, wanted, wanted.count(), id_column, text_column, shingle).dropDuplicates(["id"])
        names, run = _pairs_in_cells(percent, margin, exact=True)
        more = more.union(_cells(large.join(sets, "id"), block).select(*names).mapInArrow(run, "a long, b long"))
    more = cut(more.distinct())
    if not more.isEmpty():
        components = cut(connected_components(links.union(more)))
    grouped = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "d1", "d2", "n").join(grouped, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
