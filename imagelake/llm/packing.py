"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from imagelake.llm.bpe import _lists, _null_free, encoder_for
from imagelake.llm.shared import cut, number_rows
from imagelake.llm.text import chunks


def pieces_of(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each count as a sum of as few powers of two up to longest as there are, the largest first: row, start and length of every piece."""
    bits = longest.bit_length() - 1
    powers = 1 << np.arange(bits - 1, -1, -1)
    rest = (counts[:, None] & powers) > 0
    whole = counts >> bits
    n = whole + rest.sum(axis=1)
    row = np.repeat(np.arange(len(counts)), n)
    lengths = np.full(len(row), longest, np.int64)
    tail = np.repeat(np.cumsum(n) - rest.sum(axis=1), rest.sum(axis=1))
    lengths[tail + (np.cumsum(rest, axis=1) - 1)[rest]] = np.broadcast_to(powers, rest.shape)[rest]
    start = np.cumsum(lengths) - lengths
    return row, start - (np.cumsum(counts) - counts)[row], lengths


def pack_powers_of_two(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int = 1,
    longest: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
    run_bytes: int = 4 << 20,
    cache_pieces: int = 400_000,
) -> DataFrame:
    """Cuts each document's ids (with end_id behind them) into pieces whose lengths are powers of two up to longest.

    Each piece is a sequence of its own, so no sequence crosses documents and none needs padding: a trainer takes
    batches of equal lengths. Sequences of one length are numbered together, the longest lengths first; the number is
    sequence_id, gapless from 0 over all lengths.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and with with_ids also ids
    array<int>. A null or empty text is one piece that holds end_id alone. Rows that repeat an id or a text are packed
    each for itself; a null doc_id is packed like others; of equal rows' pieces it is not said which comes first. An
    empty table gives no rows. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, cache_pieces)
        for batch in batches:
            texts = _null_free(batch.column(1))
            for lo, hi, _, _ in chunks(texts, run_bytes):
                ids, first = encoder.encode(texts.slice(lo, hi - lo))
                own = first + np.arange(len(first))
                out = np.empty(len(ids) + len(first) - 1, "<u4")
                ends = np.zeros(len(out), bool)
                ends[own[1:] - 1] = True
                out[ends], out[~ends] = end_id, ids
                ids, first = out, own
                row, start, length = pieces_of(np.diff(first), longest)
                raw, ends = memoryview(ids).cast("B"), 4 * np.cumsum(length)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)]
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(first)[row])]
                if with_ids:
                    columns.append(_lists(ids.view(np.int32), np.concatenate(([0], np.cumsum(length))), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    pieces = cut(narrow.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids))
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))  # a row for each power of two
    longer = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    base = lengths.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    numbered = number_rows(pieces, ["length"], F.struct("id", "start", "ids_crc32"), ["id", "start", "ids_crc32"], "place")
    return numbered.join(F.broadcast(base), "length").select(
        F.col("id").alias(id_column),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
