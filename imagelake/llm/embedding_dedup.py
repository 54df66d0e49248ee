"""Near-duplicate embeddings by cross-polytope hashing, multiprobe buckets and verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.cells import Rows, pairs_of_cells, whole_cells
from imagelake.llm.shared import connected_components, cut


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def cross_polytope(x: np.ndarray, tables: int, hashes: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket keys per row and table: the nearest, and the one with the least certain hash at its second choice.

    A hash is the signed axis nearest to the row after three rounds of random signs and Hadamard transforms, so
    it is one of twice the (padded) width. A bucket joins `hashes` of them.
    """
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    first, second = np.zeros((n, tables), np.int64), np.zeros((n, tables), np.int64)
    for t in range(tables):
        codes, others, gaps = [], [], []
        for h in range(hashes):
            random = np.random.default_rng([seed, t, h, width])
            y = padded
            for _ in range(3):
                y = hadamard(y * random.choice((-1.0, 1.0), width))
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[np.arange(n), best]
            sign = lambda at, y=y: 2 * at + (y[np.arange(n), at] < 0)
            codes.append(sign(best))
            size[np.arange(n), best] = -1
            after = size.argmax(axis=1)
            others.append(sign(after))
            gaps.append(top - size[np.arange(n), after])
        loosest = np.stack(gaps).argmin(axis=0)
        a = b = np.zeros(n, np.int64)
        for h in range(hashes):
            a = a * (2 * width) + codes[h]
            b = b * (2 * width) + np.where(loosest == h, others[h], codes[h])
        first[:, t], second[:, t] = a, b
    return first, second


def parameters(n: int, dim: int) -> tuple[int, int]:
    """(tables, hashes): buckets of few unrelated vectors, and tables enough to find 99.9 % of pairs at cosine 0.95.

    One hash sends such a pair to one bucket with probability about 0.69, with the second probe in place of the least
    certain hash about as if one hash fewer were asked for.
    """
    width = 1 << max(1, (dim - 1).bit_length())
    hashes = min(max(1, math.ceil(math.log(max(2, 4 * n)) / math.log(2 * width))), 6)
    return math.ceil(math.log(0.001) / math.log(1 - 0.69 ** max(1.0, hashes - 0.5))), hashes


def _met(first_a, second_a, first_b, second_b):
    """Whether two vectors share a bucket in each table: that of at least one is its nearest."""
    return (first_a == first_b) | (second_a == first_b) | (first_a == second_b)


def _counted(rows: Rows, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links among pairs (a, b), as counts per class and edges that join what they join. A link counts where it is met first."""
    keep = np.einsum("ij,ij->i", rows["x"][a], rows["x"][b]) >= threshold
    a, b = a[keep], b[keep]
    table = rows["table"][a]
    earlier = np.arange(rows["first"].shape[1]) < table[:, None]
    met = _met(rows["first"][a], rows["second"][a], rows["first"][b], rows["second"][b])
    keep = ~(met & earlier).any(axis=1)
    a, b, table = a[keep], b[keep], table[keep]
    # in the first table where they meet, the smallest bucket they share
    f_a, s_a, f_b, s_b = (rows[k][x, table] for x in (a, b) for k in ("first", "second"))
    biggest = np.iinfo(np.int64).max
    place = np.where(f_a == f_b, f_a, np.minimum(np.where(f_a == s_b, f_a, biggest), np.where(s_a == f_b, f_b, biggest)))
    a, b = a[place == rows["bucket"][a]], b[place == rows["bucket"][a]]
    ids, place = np.unique(np.concatenate((rows["class"][a], rows["class"][b])), return_inverse=True)
    a_id, b_id = place[: len(a)], place[len(a) :]
    n = np.bincount(a_id, rows["copies"][b], len(ids)) + np.bincount(b_id, rows["copies"][a], len(ids))
    label = np.arange(len(ids))
    while True:  # smallest label among linked classes, until nothing changes
        new = label.copy()
        np.minimum.at(new, a_id, label[b_id])
        np.minimum.at(new, b_id, label[a_id])
        new = new[new]
        if (new == label).all():
            return ids, n.astype(np.int64), ids[label]
        label = new


def embedding_dedup(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95, block: int = 1000) -> DataFrame:
    """Groups of vectors that links join: a link is a cosine of threshold or more, in double precision.

    Equal vectors become one class first. Classes are hashed by signed axes after fast Hadamard rotations; in every table
    each looks into its own bucket and into one more. All pairs inside a bucket are verified, a large bucket in blocks,
    each in a task of its own. Only counts and joining edges leave a task, and a pair counts where it is met first.

    Returns (vec_id, n_links, component_id, kept): n_links counts the other vectors linked directly, copies included;
    component_id is the smallest vec_id that links reach. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows that repeat an id and a vector
    are copies of each other; an id with several vectors has a row for
    each. A null id has a null component and isn't kept. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = "v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('inf')) and exists(v, e -> e <> 0) and id is not null"
    classes = rows.where(good).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))  # written once, so numbers stay
    found = None
    for dim in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:  # the lengths of vectors, few
        of_dim = classes.where(F.size("v") == dim)
        links = _links(of_dim, dim, *parameters(of_dim.count(), dim), threshold, block)
        found = links if found is None else found.union(links)
    per_class = classes.select("v", F.col("copies") - 1, "rep").toDF("v", "n_links", "component_id")
    if found is not None:
        found = cut(found)
        n_links = found.groupBy("class").agg(F.sum("n").alias("n"))
        components = connected_components(found.select(F.col("class").alias("a"), F.col("to").alias("b"))).toDF("class", "component")
        placed = cut(classes.join(n_links, "class", "left").join(components, "class", "left").withColumn("component", F.coalesce("component", "class")))
        names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
        per_class = placed.join(names, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    flagged = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    per_class = per_class.withColumn("good", F.lit(True))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return flagged.join(per_class, ["v", "good"], "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def _links(classes: DataFrame, dim: int, tables: int, hashes: int, threshold: float, block: int) -> DataFrame:
    """(class, n, to) of the classes of one vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, tables), pa.int32()), pa.array(x.reshape(-1)))
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                first, second = cross_polytope(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists(first), lists(second)], ["class", "copies", "x", "first", "second"])

    hashed = cut(classes.select("class", "copies", "v").mapInArrow(run, "class long, copies long, x array<double>, first array<long>, second array<long>"))
    near = hashed.select("class", F.posexplode("first").alias("table", "bucket"), F.lit(0).alias("probe"))
    far = hashed.select("class", F.posexplode("second").alias("table", "bucket"), F.lit(1).alias("probe"))
    members = near.union(far)
    sizes = members.groupBy("table", "bucket").agg(F.count("*").alias("size"), F.min("probe").alias("least")).where("size > 1 and least = 0")
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    cells = (
        members.join(sizes.select("table", "bucket", F.ceil(F.col("size") / block).cast("int").alias("parts")), ["table", "bucket"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("class", "table", "bucket", "probe", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    names = ("table", "bucket", "i", "j", "own", "class", "copies", "x", "first", "second")
    keys = names[:4]

    def arrays(batch: pa.RecordBatch) -> Rows:
        rows = {k: batch.column(c).to_numpy(zero_copy_only=False) for c, k in enumerate(names[:7])}
        lists = {k: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c, k in enumerate(names) if c >= 7}
        lists["x"] = lists["x"] / np.linalg.norm(lists["x"], axis=1, keepdims=True)
        return rows | lists

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, arrays, keys):
            for a, b in pairs_of_cells(rows, keys):
                found = _counted(rows, a, b, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["class", "n", "to"])

    rows = cells.join(hashed, "class").select(*names).repartition(*keys).sortWithinPartitions(*keys, "class")
    return rows.mapInArrow(count, "class long, n long, to long")
