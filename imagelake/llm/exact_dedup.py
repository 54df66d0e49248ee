"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.shared import cut
from imagelake.llm.text import chunks, stream

GEAR = (stream(256, 11) >> np.uint64(32)).astype(np.uint32)
WINDOW = 16
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def cut_points(data: np.ndarray, average_bits: int) -> np.ndarray:
    """Where the rolling hash of the last 16 bytes has average_bits zero bits: ends of chunks, so they move with the content."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # after each step h covers twice as many bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return np.flatnonzero((h >> np.uint32(32 - average_bits)) == 0) + 1


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    return _SPACES.sub(b" ", text)


def _recipes(average_bits: int, digest_size: int, with_chunks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                raw = data.tobytes()
                recipes, shas, sizes, pieces, seen = [], [], [], [], set()
                for i in range(hi - lo):
                    text = normalise(raw[offsets[i] : offsets[i + 1]])
                    if not with_chunks:
                        shas.append(hashlib.sha256(text).hexdigest())
                        sizes.append(len(text))
                    points = cut_points(np.frombuffer(text, np.uint8), average_bits).tolist() if text else []
                    if not points or points[-1] != len(text):
                        points.append(len(text))
                    at, recipe = 0, []
                    for end in points:
                        piece = text[at:end]
                        digest = hashlib.blake2b(piece, digest_size=digest_size).digest()
                        recipe.append(digest)
                        if with_chunks and digest not in seen:
                            seen.add(digest)
                            pieces.append((digest, piece))
                        at = end
                    recipes.append(b"".join(recipe))
                if with_chunks:
                    yield pa.record_batch([pa.array([d for d, _ in pieces], pa.binary()), pa.array([p for _, p in pieces], pa.binary())], ["digest", "chunk"])
                else:
                    yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(recipes, pa.binary()), pa.array(shas, pa.string()), pa.array(sizes, pa.int64())], ["id", "recipe", "sha", "n_bytes"])

    return run


def _recipes_of(docs: DataFrame, id_column: str, text_column: str, average_bits: int, digest_size: int, kind: str) -> DataFrame:
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    if kind == "chunks":
        return narrow.mapInArrow(_recipes(average_bits, digest_size, True), "digest binary, chunk binary")
    return narrow.mapInArrow(_recipes(average_bits, digest_size, False), "id long, recipe binary, sha string, n_bytes long")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", average_bits: int = 10) -> DataFrame:
    """Groups of documents whose texts are identical once each run of white space is one space.

    Texts are cut where a rolling hash of their content says so (chunks of about 2**average_bits bytes). A chunk's
    identifier is its digest, verified against the chunks' bytes: every distinct chunk moves once from each
    run of texts, and a digest that two different chunks share makes all identifiers longer. Documents are then
    compared by their ordered lists of identifiers, about a sixtieth of their length, so long texts don't move again.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), a row for each input row. keep_id is the smallest
    doc_id of the group. Null and empty texts are equal to each other; rows that repeat a doc_id and a
    text each get a row; a null doc_id is never kept unless its group has no other, when keep_id is null too and
    kept false. An empty table gives no rows. Other columns are neither read nor returned.
    """
    for digest_size in (16, 32, 64):
        store = _recipes_of(docs, id_column, text_column, average_bits, digest_size, "chunks").distinct()
        clashes = store.groupBy("digest").count().where("count > 1")
        if clashes.isEmpty():
            break
    else:
        raise RuntimeError("different chunks share a 512-bit digest")
    recipes = cut(_recipes_of(docs, id_column, text_column, average_bits, digest_size, "recipes"))
    groups = recipes.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return recipes.join(groups, "recipe").select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
