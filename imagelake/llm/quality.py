"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.shared import cut
from imagelake.llm.text import chunks, word_hashes, words

#: Features before the hashed words: the bias of interactions, then what structure() gives.
STRUCTURE = ("bytes", "words", "word_length", "upper", "digit", "symbol", "space", "line_feed", "bar", "other_bytes", "odd_words", "repeats")


def _classes() -> np.ndarray:
    table = np.zeros((256, 7), np.float32)
    for b in range(256):
        c = chr(b) if b < 128 else ""
        table[b] = [c.isupper(), c.isdigit(), bool(c) and c.isprintable() and not c.isalnum() and c not in " .,", c == " ", c == "\n", c == "|", b >= 128]
    return table


_CLASSES = _classes()
_SYMBOL = _CLASSES[:, 2] > 0


def structure(data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, starts: np.ndarray, first: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """(texts, statistics): logarithms of sizes and shares of kinds of bytes and words, all about between 0 and 1."""
    n = np.diff(offsets)
    out = np.zeros((len(n), len(STRUCTURE)), np.float32)
    full = np.flatnonzero(n)
    per = np.maximum(n, 1)
    if len(full):
        sums = np.stack([np.add.reduceat(_CLASSES[:, k][data], offsets[:-1][full], dtype=np.float64) for k in range(7)], axis=1)
        out[full, 3:10] = sums / per[full, None]
    n_words = np.diff(first)
    out[:, 0], out[:, 1] = np.log1p(n) / 12, np.log1p(n_words) / 10
    if len(starts):
        whole = np.concatenate(([0], np.cumsum(lengths)))
        out[:, 2] = np.minimum((whole[first[1:]] - whole[first[:-1]]) / np.maximum(n_words, 1) / 10, 3)
        odd = np.concatenate(([0], np.cumsum(_SYMBOL[data[starts + lengths - 1]])))
        out[:, 10] = (odd[first[1:]] - odd[first[:-1]]) / np.maximum(n_words, 1)
    out[:, 11] = 1 - distinct / np.maximum(n_words, 1)
    return out


def features(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows, a row for each text: feature numbers, values, and each row's first place (n + 1).

    Features: statistics, metadata, then 2**bits buckets of words, each log(1 + count), scaled to unit length.
    """
    n, fixed = len(offsets) - 1, len(STRUCTURE) + metadata.shape[1]
    starts, lengths, first = words(data, offsets)
    bucket = (word_hashes(data, starts, lengths) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(first))
    keys, counts = np.unique((row << bits) | bucket, return_counts=True)
    row, bucket = keys >> bits, keys & ((1 << bits) - 1)
    values = np.log1p(counts).astype(np.float32)
    distinct = np.bincount(row, minlength=n)
    values /= np.sqrt(np.maximum(np.bincount(row, values**2, n), 1e-12)).astype(np.float32)[row]
    dense = np.concatenate([structure(data, offsets, lengths, starts, first, distinct), metadata.astype(np.float32)], axis=1)
    at = np.concatenate(([0], np.cumsum(distinct + fixed)))
    ids, x = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    head = at[:-1, None] + np.arange(fixed)
    ids[head], x[head] = np.arange(fixed), dense
    place = np.arange(len(row)) + fixed * (row + 1)
    ids[place], x[place] = bucket + fixed, values
    return ids, x, at


@dataclass
class FactorisationMachine:
    """score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), the pairs in linear time."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    bits: int

    def margin(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and each row's sum of v_i x_i. The pairs' sum is half of (sum v_i x_i)^2 - sum (v_i x_i)^2."""
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, at[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at[:-1])
        return self.w0 + np.add.reduceat(self.w[ids] * x, at[:-1]) + 0.5 * ((s * s).sum(axis=1) - squares), s

    def fit(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 250, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> None:
        """Adam on the logistic loss: so many steps over small batches, in as many rounds over the rows as that takes."""
        random = np.random.default_rng(seed)
        p0, moments, t = np.zeros(3), [np.zeros_like(a) for a in (self.w, self.w, self.v, self.v)], 0
        while t < steps:
            order = random.permutation(len(y))
            for begin in range(0, len(y), batch)[: steps - t]:
                rows = order[begin : begin + batch]
                n = (at[1:] - at[:-1])[rows]
                own = np.concatenate(([0], np.cumsum(n)))
                where = np.arange(own[-1]) + np.repeat(at[:-1][rows] - own[:-1], n)
                i, v = ids[where], x[where]
                margin, s = self.margin(i, v, own)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
                gx = np.repeat(g, n) * v
                order_i = np.argsort(i, kind="stable")
                used, begins = np.unique(i[order_i], return_index=True)
                gw = np.add.reduceat(gx[order_i], begins) + decay * self.w[used]
                pull = gx[:, None] * (np.repeat(s, n, axis=0) - self.v[i] * v[:, None])
                gv = np.add.reduceat(pull[order_i], begins, axis=0) + decay * self.v[used]
                t += 1
                for target, m, q, grad in ((self.w, moments[0], moments[1], gw), (self.v, moments[2], moments[3], gv)):
                    m[used] = 0.9 * m[used] + 0.1 * grad
                    q[used] = 0.999 * q[used] + 0.001 * grad * grad
                    target[used] -= rate * (m[used] / (1 - 0.9**t)) / (np.sqrt(q[used] / (1 - 0.999**t)) + 1e-8)
                p0[0], p0[1] = 0.9 * p0[0] + 0.1 * g.sum(), 0.999 * p0[1] + 0.001 * g.sum() ** 2
                self.w0 -= rate * (p0[0] / (1 - 0.9**t)) / (np.sqrt(p0[1] / (1 - 0.999**t)) + 1e-8)


def _feature_rows(docs: DataFrame, text_column: str, metadata: tuple[str, ...]) -> DataFrame:
    """text, then the logarithm of each metadata column, a null or negative one as 0."""
    return docs.select(
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.array(*[F.coalesce(F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)) / 12 for c in metadata]).cast("array<double>").alias("meta"),
        *[c for c in ("_id", "_label") if c in docs.columns],
    )


def _metadata(batch: pa.RecordBatch, n: int) -> np.ndarray:
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(flat.reshape(n, -1)) if len(flat) else np.zeros((n, 0))


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    metadata: tuple[str, ...] = ("n_chars",),
    max_rows: int = 8_000,
    bits: int = 14,
    rank: int = 8,
    steps: int = 250,
) -> FactorisationMachine:
    """Fits on at most max_rows labelled documents, those with the smallest hash of their id: the documented bound.

    Rows with a null id or label, and labels without a document, are left out; an id with several labels counts by their
    mean. With no label at all the machine gives every text 0.5.
    """
    wanted = (
        labels.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("double").alias("_label"))
        .where("_id is not null and _label is not null")
        .groupBy("_id")
        .agg(F.avg("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    wanted = cut(wanted)  # max_rows ids: small enough to broadcast at every input size
    own = docs.withColumn("_id", F.col(id_column).cast("long")).join(F.broadcast(wanted), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = _metadata(batch, batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                ids, x, at = features(data, offsets, meta[lo:hi], bits)
                each = [(ids[a:b].astype(np.int32).tobytes(), x[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array([a for a, _ in each], pa.binary()), pa.array([b for _, b in each], pa.binary())], ["id", "label", "ids", "x"])

    rows = _feature_rows(own, text_column, metadata).mapInArrow(run, "id long, label double, ids binary, x binary").toArrow().sort_by("id")
    n_features = len(STRUCTURE) + len(metadata) + (1 << bits)
    random = np.random.default_rng(1)
    machine = FactorisationMachine(0.0, np.zeros(n_features, np.float32), random.normal(0, 0.02, (n_features, rank)).astype(np.float32), bits)
    if rows.num_rows == 0:
        machine.v[:] = 0
        return machine
    ids = [np.frombuffer(b, np.int32) for b in rows["ids"].to_pylist()]
    x = np.concatenate([np.frombuffer(b, np.float32) for b in rows["x"].to_pylist()])
    at = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    machine.fit(np.concatenate(ids).astype(np.int64), x, at, rows["label"].to_numpy(), steps)
    return machine


def score_quality(docs: DataFrame, machine: FactorisationMachine, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """(doc_id, score): how likely label 1 is for each whole text, between 0 and 1.

    The model has a fixed size and is broadcast. A null text scores as an empty one, from its metadata and the bias; rows
    that repeat an id get a score each; an empty table gives no rows. Columns other than the text and the named
    metadata are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            meta = _metadata(batch, batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                margin, _ = fm.margin(*features(data, offsets, meta[lo:hi], fm.bits))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))), pa.float64())], ["id", "score"])

    rows = _feature_rows(docs.withColumn("_id", F.col(id_column).cast("long")), text_column, metadata)
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_column)
