"""Contents: compressed chunks, attribute values, encrypted blocks."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.aes import xts
from imagelake.operators.extents import file_content

#: Bytes that are decrypted together.
PART = 1 << 17
METHODS = ("stored", "zero", "zlib", "bzip2", "adc", "lzbitmap")


def adc_decompress(data: bytes | memoryview, size: int) -> bytes:
    """Apple Data Compression: plain runs, and copies of two or three bytes' description.

    A first byte from 0x80 announces up to 128 plain bytes; from 0x40 a copy of 4 to 67 bytes from up to 64 KiB back;
    else one of 3 to 18 bytes from up to 1 KiB back.
    """
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        b = data[at]
        if b & 0x80:
            n = (b & 0x7F) + 1
            out += data[at + 1 : at + 1 + n]
            at += n + 1
            continue
        if b & 0x40:
            n, back, at = (b & 0x3F) + 4, (data[at + 1] << 8 | data[at + 2]) + 1, at + 3
        else:
            n, back, at = ((b & 0x3F) >> 2) + 3, ((b & 3) << 8 | data[at + 1]) + 1, at + 2
        if back > len(out):
            raise ValueError("a copy reaches before the start")
        for _ in range(n):
            out.append(out[-back])
    return bytes(out)


def _one(method: str | None, data: bytes | memoryview | None, size: int | None) -> tuple[str, bytes | None]:
    if method is None or data is None and method != "zero":
        return "missing", None
    try:
        if method == "stored":
            out = bytes(data)
        elif method == "zero":
            out = bytes(size)
        elif method == "zlib":
            out = zlib.decompress(data)
        elif method == "bzip2":
            out = bz2.decompress(data)
        elif method == "adc":
            out = adc_decompress(data, size)
        else:
            return "unsupported", None
    except (ValueError, OSError, zlib.error, EOFError, IndexError) as e:
        return f"corrupt: {type(e).__name__}", None
    return ("ok", out) if size is None or len(out) == size else ("wrong length", out)


def _each(data: pa.Array) -> Iterator[memoryview | None]:
    """The values of a binary array, one at a time and without a copy."""
    for x in data:
        buffer = x.as_buffer()
        yield None if buffer is None else memoryview(buffer)


def _binary(values: Iterable[bytes | None], kind: pa.DataType) -> pa.Array:
    """A binary array of values that are written to its buffer as they come, so that no more than one is held beside it."""
    out, ends, valid = pa.BufferOutputStream(), [0], []
    for x in values:
        valid.append(x is not None)
        if x:
            out.write(x)
        ends.append(ends[-1] + len(x or b""))
    if pa.types.is_binary(kind) and ends[-1] > 0x7FFFFFFF:
        raise ValueError("a batch's values are too long for one array; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = pa.py_buffer(np.array(ends, np.int64 if pa.types.is_large_binary(kind) else np.int32))
    bits = pa.py_buffer(np.packbits(np.array(valid, bool), bitorder="little"))
    return pa.Array.from_buffers(kind, len(valid), [bits, offsets, out.getvalue()])


def decompress_chunks(df: DataFrame, method: str, src: str, dst_len: str) -> DataFrame:
    """df without src, with data and status: ok, wrong length, corrupt, unsupported or missing. Chunks are independent.

    A Python worker holds a batch's chunks once, and once what they give.
    """

    @F.arrow_udf("status string, data binary")
    def run(methods: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        states = []

        def work() -> Iterator[bytes | None]:
            for m, d, n in zip(methods.to_pylist(), _each(sources), sizes.to_pylist(), strict=True):
                state, data = _one(m, d, n)
                states.append(state)
                yield data

        data = _binary(work(), sources.type)
        return pa.StructArray.from_arrays([pa.array(states, methods.type), data], ["status", "data"])

    once = run.asNondeterministic()  # or a condition on status would have all done again
    return df.withColumn("_out", once(F.col(method).cast("string"), F.col(src).cast("binary"), F.col(dst_len).cast("long"))).drop(src).select("*", "_out.status", "_out.data").drop("_out")


def compress_zlib(data: Column | str) -> Column:
    @F.arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return _binary((None if x is None else zlib.compress(x) for x in _each(data)), data.type)

    return run.asNondeterministic()(data)


#: Inline methods follow the header in the attribute, those in the fork are cut in 64 KiB chunks.
INLINE, FORK = (3, 7, 9, 11, 13), (4, 8, 10, 12, 14)
CHUNK = 0x10000
HEADER_MAGIC = 0x636D7066


def compression_header(data: Column) -> Column:
    """struct<magic, algo, size> of a compression attribute."""
    from imagelake.operators.blocks import le_number

    return F.struct(le_number(data, 0, 4).alias("magic"), le_number(data, 4, 4).alias("algo"), le_number(data, 8, 8).alias("size"))


def fork_chunks(algo: int, fork: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each chunk in a resource fork: method 4 has a big-endian header and a counted list, the others a list of offsets."""
    if algo == 4:
        start = int.from_bytes(fork[0:4], "big")
        n = int.from_bytes(fork[start + 4 : start + 8], "little")
        rows = np.frombuffer(fork, "<u4", 2 * n, start + 8).reshape(-1, 2)
        return [(start + 4 + int(a), int(b)) for a, b in rows]
    ends = np.frombuffer(fork, "<u4", int.from_bytes(fork[:4], "little") // 4)
    return [(int(a), int(b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def chunk_method(algo: int, chunk: bytes) -> tuple[str, bytes]:
    """The codec of one chunk and the bytes it works on; a marker byte says that a chunk is stored."""
    first = chunk[:1]
    if algo in (3, 4):
        stored = first == b"\xff" if algo == 3 else bool(first) and first[0] & 0x0F == 0x0F
        return ("stored", chunk[1:]) if stored else ("zlib", chunk)
    if algo in (7, 8):
        return ("stored", chunk[1:]) if first == b"\x06" else ("lzvn", chunk)
    if algo in (9, 10):
        return ("stored", chunk[1:]) if first == b"\xcc" else ("unknown", chunk)
    if algo in (13, 14):
        return ("stored", chunk[1:]) if first == b"\xff" else ("lzbitmap", chunk)
    return "lzfse", chunk


def decompress_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """(ino, size, data, status) of compressed files (ino, header binary, fork binary).

    The header attribute names method and size. Inline data is one chunk; a fork is a list of chunks of 64 KiB, which become
    rows, so that one large file's chunks are decompressed in many tasks. strict gives no data for a file with a bad chunk or
    length, otherwise what there is.
    """
    head = compression_header(F.col("header"))

    @F.pandas_udf("array<struct<pos int, method string, src binary, dst_len long>>")
    def cut(algos: pd.Series, sizes: pd.Series, headers: pd.Series, forks: pd.Series) -> pd.Series:
        out = []
        for algo, size, header, fork in zip(algos, sizes, headers, forks, strict=True):
            rows = []
            try:
                parts = [(0, header[16:])] if algo in INLINE else [(i, fork[a : a + n]) for i, (a, n) in enumerate(fork_chunks(algo, fork))]
                for i, chunk in parts:
                    method, src = chunk_method(algo, chunk) if len(chunk) <= CHUNK + 1 or algo in INLINE else ("too long", b"")
                    rows.append({"pos": i, "method": method, "src": src, "dst_len": int(size) if algo in INLINE else int(min(CHUNK, size - i * CHUNK))})
            except (ValueError, IndexError, TypeError):
                rows = [{"pos": 0, "method": "bad table", "src": b"", "dst_len": int(size)}]
            out.append(rows)
        return pd.Series(out)

    known = F.col("_h.algo").isin(*INLINE, *FORK) & (F.col("_h.magic") == HEADER_MAGIC)
    rows = files.select("ino", "header", "fork", head.alias("_h")).select("ino", F.col("_h.size").alias("size"), F.when(known & (F.col("_h.size") > 0), cut("_h.algo", "_h.size", "header", "fork")).alias("_c"), known.alias("_known"))
    chunks = rows.select("ino", F.explode("_c").alias("c")).select("ino", "c.*")
    done = decompress_chunks(chunks, "method", "src", "dst_len")
    state = F.array_sort(F.collect_list(F.struct("pos", "status", "data")))
    whole = done.groupBy("ino").agg(state.alias("p"))
    bad = F.exists("p", lambda x: x["status"] != "ok")
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(F.hex(x["data"]), F.lit(""))), ""))
    joined = rows.select("ino", "size", "_known").join(whole.select("ino", bad.alias("bad"), data.alias("data")), "ino", "left")
    status = F.when(~F.coalesce("_known", F.lit(False)), "unknown method").when(F.col("bad"), "bad chunk").when(F.octet_length(F.coalesce("data", F.lit(b""))) != F.col("size"), "wrong length").otherwise("ok")
    out = joined.withColumn("status", status)
    kept = F.when((F.col("status") == "ok") | F.lit(not strict), F.coalesce("data", F.lit(b"")))
    return out.select("ino", "size", kept.alias("data"), "status")


def xattr_values(xattrs: DataFrame, extents: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """(ino, name, embedded, value): embedded bytes, or the stream's extents read and cut to its size."""
    inside = xattrs.where(F.col("data").isNotNull()).select("ino", "name", F.lit(True).alias("embedded"), F.col("data").alias("value"))
    outside = xattrs.where(F.col("data").isNull() & F.col("stream_id").isNotNull())
    streams = outside.select(F.col("stream_id").alias("private_id"), F.col("stream_size").alias("ds_size")).distinct()
    read = file_content(streams, extents, blocks, block_size)
    one_row = F.when(F.col("part") == 0, F.col("data")).otherwise(F.raise_error(F.lit("an attribute's value is too long for a row")).cast("binary"))
    found = outside.join(read.select(F.col("private_id").alias("stream_id"), one_row.alias("value")), "stream_id", "left")
    return inside.unionByName(found.select("ino", "name", F.lit(False).alias("embedded"), "value"))


def xts_blocks(df: DataFrame, key: bytes, data: str, tweak: str, decrypt: bool = True, sector: int = 512) -> DataFrame:
    """df with data decrypted (or encrypted) by AES-XTS in sectors of 512 bytes. A tweak of 0 means clear text.

    The unit number of a sector is tweak times the sectors in the block, plus the sector's place. The key, 32 bytes for AES-128,
    is the volume's. Sectors are worked on by the PART together: a Python worker holds a batch's blocks once, and once as they
    come out, whatever the tables of the cipher take for a part.
    """

    @F.arrow_udf("binary")
    def run(blocks: pa.Array, tweaks: pa.Array) -> pa.Array:
        valid, at, raw = blocks.buffers()
        begins = np.frombuffer(at, np.int64 if pa.types.is_large_binary(blocks.type) else np.int32)[blocks.offset : blocks.offset + len(blocks) + 1].astype(np.int64)
        clear = np.frombuffer(raw or b"", np.uint8)
        out, sizes, units = clear.copy(), np.diff(begins), tweaks.fill_null(0).to_numpy().astype(np.uint64)
        chosen = (units != 0) & (sizes > 0) & blocks.is_valid().to_numpy(zero_copy_only=False)
        for n in np.unique(sizes[chosen]).tolist():
            if n % sector:
                raise ValueError("a block isn't a whole number of sectors")
            per, rows = n // sector, np.flatnonzero(chosen & (sizes == n))
            step = max(1, PART // n)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                where = begins[part][:, None] + np.arange(n)
                each = (units[part][:, None] * np.uint64(per) + np.arange(per, dtype=np.uint64)).reshape(-1)
                out[where] = xts(clear[where].reshape(-1, sector), each, key, decrypt).reshape(len(part), n)
        return pa.Array.from_buffers(blocks.type, len(blocks), [valid, at, pa.py_buffer(out)], offset=blocks.offset)  # lengths and nulls stay

    once = run.asNondeterministic()  # or each use of data would have it done again
    return df.withColumn(data, once(F.col(data).cast("binary"), F.col(tweak).cast("long")))
