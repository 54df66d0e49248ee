"""Byte-level BPE: encoding and decoding over Arrow batches with the tokenizers library.

A text is cut before each single space between two other characters and around each such line feed. The split pattern
never matches across these places, so every piece encodes on its own, each different piece of a batch is
encoded once, and ids are gathered per document with Arrow and numpy.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import threading
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from imagelake.llm.text import chunks


def byte_characters() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable Latin-1 bytes stand for themselves, the other bytes, in order, for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What a token is made of: byte pairs merged by rank, as far as the ranks below its own allow."""
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        best = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best[0] >= limit:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """The JSON of a tokenizer of the tokenizers library that has these ranks as ids and splits by this pattern."""
    chars = byte_characters()
    spell = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and len(parts := _parts(token, ranks)) == 2:
            merges.append((spell(parts[0]), spell(parts[1])))
    made = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def token_bytes(tokenizer_json: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids end to end, and where each id's begin: the byte table reversed."""
    back = {c: b for b, c in byte_characters().items()}
    spec = json.loads(tokenizer_json)
    spelled = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    spelled |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
    table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in table])))


#: A space or line feed between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Texts in which white space stands together, at an end, or isn't ASCII: a plain cut at spaces could change their split.
_ODD = r"[ \t-\r][ \t-\r]|^[ \t-\r]|[ \t-\r]$|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces of a space and then no white space at either end: between two of them is a place to cut.
_APART = r"^ [!-~]$|^ [!-~][^\t]*[!-~]$|^ \pL[^\t]*[!-~]$|^ [!-~\pL][^\t]*\pL$"


class PieceEncoder:
    """Encodes texts piece by piece. Pieces seen before come from a cache that starts anew after cache_pieces entries."""

    def __init__(self, tokenizer_json: str, cache_pieces: int = 1_000_000, longest: int = 100):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.model._resize_cache(0)  # what it is given is new to it, so its own cache would only cost
        self.cache_pieces, self.longest = cache_pieces, longest
        self.token_sizes = np.diff(token_bytes(tokenizer_json)[1])
        self.separators = {x: self.tokenizer.encode(x, add_special_tokens=False).ids[0] for x in "\n\t"}
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids, self.sizes, self.n, self.n_ids = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), 0, 0
        self.begins = np.zeros(1 << 14, np.int64)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts end to end, and each text's first piece (n + 1). Joined, they are the texts."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        at_odd = np.flatnonzero(odd)
        order = np.concatenate((np.flatnonzero(~odd), at_odd))
        plain, begin = self._plain(texts.filter(pa.array(~odd)))
        careful, begin_odd = self._careful(texts.take(pa.array(at_odd)))
        lists = pa.LargeListArray.from_arrays(np.concatenate((begin, begin_odd[1:] + begin[-1])), pa.concat_arrays([plain, careful]))
        lists = lists.take(pa.array(np.argsort(order, kind="stable")))
        return lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))

    def _plain(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        # each line feed becomes a piece of its own, and what follows it is a piece that other lines begin with too
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        at = at - at[0]
        spaced = np.ones(len(flat) + 1, bool)
        spaced[at] = False
        feeds = np.flatnonzero(pc.equal(flat, "\n").to_numpy(zero_copy_only=False))
        spaced[feeds] = spaced[feeds + 1] = False
        return pc.binary_join_element_wise(pc.if_else(pa.array(spaced[:-1]), pa.scalar(" ", flat.type), pa.scalar("", flat.type)), flat, pa.scalar("", flat.type)), at

    def _careful(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        out, at = [], [0]
        for text in texts.to_pylist():
            begin = 0
            for m in _CUT.finditer(text):
                out.append(text[begin : m.start()])
                begin = m.start()
                if text[begin] == "\n":
                    out.append("\n")
                    begin += 1
            if begin < len(text):
                out.append(text[begin:])
            at.append(len(out))
        return pa.array(out, texts.type), np.asarray(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each text's first id (n + 1)."""
        flat, at = self.pieces(texts)
        if len(flat) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        coded = pc.dictionary_encode(flat)
        which, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if self.n + len(distinct) > self.cache_pieces:
            self._forget()
        known = np.fromiter(map(self.cache.get, distinct, repeat(-1)), np.int64, len(distinct))
        at_new = np.flatnonzero(known < 0)
        if len(at_new):
            some = coded.dictionary.take(pa.array(at_new))
            new = some.to_pylist()
            self._learn(new, pc.binary_length(some).to_numpy(zero_copy_only=False), pc.match_substring_regex(some, _APART).to_numpy(zero_copy_only=False))
            known[at_new] = np.fromiter(map(self.cache.__getitem__, new), np.int64, len(new))
        known = known[which]
        for x in [x for x in distinct if len(x) > self.longest]:
            del self.cache[x]
        n = self.sizes[known]
        ends = np.cumsum(n, dtype=np.int64)
        where = np.repeat(self.begins[known] - (ends - n), n)
        where += np.arange(len(where))
        return self.ids[where], np.concatenate(([0], ends))[at]

    def _add(self, some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(some) > len(self.sizes):
            self.sizes, self.begins = np.concatenate((self.sizes, self.sizes)), np.concatenate((self.begins, self.begins))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        to = slice(self.n, self.n + len(some))
        self.sizes[to], self.begins[to] = sizes, self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.cache.update(zip(some, range(self.n, self.n + len(some)), strict=True))
        self.n, self.n_ids = self.n + len(some), self.n_ids + len(ids)

    def _learn(self, new: list[str], n_bytes: np.ndarray, apart: np.ndarray) -> None:
        """Encodes new pieces. Those that keep apart by themselves go end to end into longer texts and are told apart by the bytes of
        their ids, those that a line feed or a tab keeps apart go with these, the others go alone."""
        alone, together = [], {"\n": [], "\t": []}
        for x in compress(new, ~apart):
            body = x[1:] if x[:1] == " " else x
            if not body or body[0].isspace() or body[-1].isspace() or "\t" in body:
                alone.append(x)
            else:
                together["\t" if "\n" in body else "\n"].append(x)
        plain, sizes = list(compress(new, apart)), n_bytes[apart].astype(np.int64)
        for begin in range(0, len(plain), 20_000):
            part, ends = plain[begin : begin + 20_000], np.cumsum(sizes[begin : begin + 20_000])
            found = self.tokenizer.encode_batch_fast(["".join(part[i : i + 100]) for i in range(0, len(part), 100)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(x.ids for x in found)), np.uint32)
            after = np.cumsum(self.token_sizes[ids])
            last = np.searchsorted(after, ends)
            if not len(after) or after[-1] != ends[-1] or (after[last] != ends).any():
                alone += part
                continue
            self._add(part, ids, np.diff(last, prepend=-1))
        for separator, some in together.items():
            for begin in range(0, len(some), 50_000):
                part = some[begin : begin + 50_000]
                runs = [part[i : i + 500] for i in range(0, len(part), 500)]
                found = self.tokenizer.encode_batch_fast([separator.join(run) + separator for run in runs], add_special_tokens=False)
                ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
                ends = np.flatnonzero(ids == self.separators[separator])
                if len(ends) != len(part):
                    alone += part
                    continue
                self._add(part, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)
        for begin in range(0, len(alone), 10_000):
            part = alone[begin : begin + 10_000]
            each = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int32))


_encoders: dict[str, PieceEncoder] = {}
_lock = threading.Lock()


def encoder_for(tokenizer_json: str, cache_pieces: int = 1_000_000) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker, so that its cache lasts from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core; threads of our own only cost memory
    key = hashlib.md5(tokenizer_json.encode()).hexdigest()
    with _lock:
        if key not in _encoders:
            _encoders[key] = PieceEncoder(tokenizer_json, cache_pieces)
        return _encoders[key]


def _null_free(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def character_starts(ids: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each id of one text, the character that holds its first byte; lengths: bytes of each id; data: the text's bytes."""
    first = np.cumsum(lengths[ids]) - lengths[ids]
    characters = np.cumsum((data & 0xC0) != 0x80) - 1
    return characters[first] if len(ids) else first


def bpe_encode(docs: DataFrame, tokenizer_json: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False, run_bytes: int = 2 << 20, cache_pieces: int = 400_000) -> DataFrame:
    """Each document's token ids: (doc_id, ids array<int>), and with offsets also (starts array<int>).

    starts has, for each id, the place of the character that its first byte belongs to; ids that split a character
    share its place. Null and empty texts have no ids. Texts are encoded whole, in runs of about run_bytes; ids
    may repeat or be null. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, cache_pieces)
        lengths = np.diff(token_bytes(shared.value)[1]) if offsets else None
        for batch in batches:
            texts = _null_free(batch.column(1))
            for lo, hi, data, at in chunks(texts, run_bytes):
                ids, first = encoder.encode(texts.slice(lo, hi - lo))
                columns = [batch.column(0).slice(lo, hi - lo), _lists(ids.view(np.int32), first, pa.int32())]
                if offsets:
                    each = [character_starts(ids[a:b], lengths, data[c:d]) for a, b, c, d in zip(first[:-1], first[1:], at[:-1], at[1:], strict=True)]
                    columns.append(_lists(np.concatenate(each), first, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "starts"][: len(columns)])

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = narrow.mapInArrow(run, "id long, ids array<int>" + ", starts array<int>" * offsets)
    return out.withColumnRenamed("id", id_column)


def bpe_decode(encoded: DataFrame, tokenizer_json: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The bytes of token ids: (doc_id, ids, decoded binary, whole boolean).

    The byte table is read backwards, so ids that hold parts of a character give its bytes as they are. whole says
    whether the bytes are valid UTF-8; a list that ends inside a character isn't. Null ids count as none, ids
    outside the vocabulary raise an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = token_bytes(shared.value)
        lengths = np.diff(begins)
        for batch in batches:
            lists = batch.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            for row in range(0, len(lists), 200):
                part = lists.slice(row, 200)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths)):
                    raise ValueError("an id is outside the vocabulary")
                counts = part.value_lengths().to_numpy(zero_copy_only=False)
                n = lengths[ids]
                ends = np.cumsum(n)
                data = table[np.arange(int(n.sum())) + np.repeat(begins[ids] - ends + n, n)]
                at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
                raw = data.tobytes()
                each = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 200), part, pa.array(each, pa.binary()), pa.array([_valid(x) for x in each])], ["id", "ids", "decoded", "whole"])

    narrow = encoded.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).alias("ids"))
    return narrow.mapInArrow(run, "id long, ids array<int>, decoded binary, whole boolean").withColumnRenamed("id", id_column)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True
