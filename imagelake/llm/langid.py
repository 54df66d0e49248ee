"""Language identification by multilingual mixture inference."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imagelake.llm.text import LOWER, chunks

UNKNOWN = "und"
#: Bytes that part words: ASCII that isn't a letter. Bytes of other characters stay.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
_LETTER = re.compile(r"[^\W\d_]")


def gram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """The hash bucket of each run of four bytes, folded to lower case with one sign for all that isn't a letter.

    The i-th stands for the bytes of its text up to the i-th; a text's first three are padded with that sign.
    """
    x = _FOLD[data].astype(np.uint32)
    h = x.copy()
    begins = offsets[:-1][np.diff(offsets) > 0]
    near = np.zeros(len(x), bool)
    for back in (1, 2, 3):
        at = begins + back - 1
        near[at[at < len(x)]] = True  # fewer than `back` bytes of the text lie before
        before = np.full(len(x), 32, np.uint32)
        before[back:] = x[:-back]
        before[near] = 32
        h += before << np.uint32(8 * back)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether it holds a letter of any script."""
    sums = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def gram_counts(docs: DataFrame, text_column: str, language_column: str, bits: int) -> DataFrame:
    """(lang, bucket, n) over all given documents; each run of texts is counted before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                buckets, own = gram_buckets(data, offsets, bits), languages[lo:hi]
                for lang in set(own):
                    mask = np.repeat(own == lang, np.diff(offsets))
                    counts[lang] = counts.get(lang, 0) + np.bincount(buckets[mask], minlength=1 << bits)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    narrow = docs.select(F.col(text_column).cast("string").alias("text"), F.col(language_column).cast("string").alias("lang"))
    found = narrow.where("text is not null and lang is not null").mapInArrow(run, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """log p(gram | language) with additive smoothing: at most max_languages rows of 2**bits buckets."""

    def __init__(self, languages: list[str], log_p: np.ndarray, bits: int):
        self.languages, self.log_p, self.bits = languages, log_p, bits

    @classmethod
    def learn(cls, docs: DataFrame, text_column: str = "text", language_column: str = "lang", bits: int = 15, smoothing: float = 0.5, max_languages: int = 256) -> LanguageModel:
        """From every row of docs that has a text and a language. The driver gets at most max_languages * 2**bits counts."""
        counts = gram_counts(docs, text_column, language_column, bits)
        languages = sorted(r[0] for r in docs.where(F.col(text_column).isNotNull() & F.col(language_column).isNotNull()).select(F.col(language_column).cast("string")).distinct().limit(max_languages + 1).collect())
        if len(languages) > max_languages:
            raise ValueError(f"more than {max_languages} languages")
        n = np.zeros((len(languages), 1 << bits))
        found = counts.toArrow()
        index = {x: i for i, x in enumerate(languages)}
        rows = np.array([index[x] for x in found["lang"].to_pylist()], int)
        n[rows, found["bucket"].to_numpy()] = found["n"].to_numpy()
        n += smoothing
        return cls(languages, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32) if languages else n, bits)


def _mixture(ll: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """EM over segments: the proportions of the languages in ll (segments, languages), and the log-likelihood."""
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    share = np.full(ll.shape[1], 1 / ll.shape[1])
    for _ in range(steps):
        r = p * share
        r /= r.sum(axis=1, keepdims=True)
        new = r.mean(axis=0)
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    return share, float(np.log(np.maximum(p @ share, 1e-300)).sum() + top.sum())


def infer(ll: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Each language's proportion in a document, given its segments' log-likelihoods (segments, languages).

    Starts from the likeliest single language and adds the language that raises the mixture's likelihood most,
    as long as that outweighs the penalty per language, which grows with the logarithm of the number of segments.
    """
    n, k = ll.shape
    proportions = np.zeros(k)
    chosen = [int(ll.sum(axis=0).argmax())]
    share, best = np.ones(1), float(ll[:, chosen[0]].sum())
    cost = penalty * (1 + math.log(n)) / 2
    # no set of languages explains a segment better than its own best language
    bound = float(ll.max(axis=1).sum())
    while len(chosen) < k and bound - best > cost:
        tried = [(_mixture(ll[:, [*chosen, j]], steps), j) for j in range(k) if j not in chosen]
        (new, value), j = max(tried, key=lambda x: x[0][1])
        if value - best <= cost:
            break
        chosen, share, best = [*chosen, j], new, value
    proportions[chosen] = share
    return proportions


def _segment_sums(table: np.ndarray, buckets: np.ndarray, begins: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """(segments, languages): the summed rows of the table, so many segments at once that long texts need no table of their bytes."""
    ends = np.append(begins[1:], len(buckets))
    out = np.empty((len(begins), table.shape[1]))
    for a in range(0, len(begins), at_once):
        b = min(a + at_once, len(begins))
        out[a:b] = np.add.reduceat(table[buckets[begins[a] : ends[b - 1]]], begins[a:b] - begins[a], axis=0)
    return out


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", segment: int = 64, penalty: float = 8.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, languages, carried columns): the language with the largest proportion of each whole text.

    A text is cut into segments of `segment` bytes; a segment's likelihood under a language comes from its four-byte
    grams, and expectation-maximisation estimates the proportions. score is the winner's proportion; languages
    maps the chosen languages to theirs. A row depends on its own text only, not on the rows beside it. A null text, or one without a letter, is `und` with score 0; so
    is every text when the model knows no language. Ties go to the language first in order. Ids may repeat or be
    null. Columns named in carry are passed on as they are; others are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p, bits = shared.value
        table = np.ascontiguousarray(log_p.T) if languages else None
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                lettered = has_letter(data, offsets) if languages else np.zeros(hi - lo, bool)
                names, scores, maps = [UNKNOWN] * (hi - lo), [0.0] * (hi - lo), [[]] * (hi - lo)
                if lettered.any():
                    sizes = np.diff(offsets)
                    per = -(-sizes // segment)
                    first = np.concatenate(([0], np.cumsum(per)))
                    begins = (np.arange(first[-1]) - np.repeat(first[:-1], per)) * segment + np.repeat(offsets[:-1], per)
                    ll = _segment_sums(table, gram_buckets(data, offsets, bits), begins)
                    for i in np.flatnonzero(lettered):
                        shares = infer(ll[first[i] : first[i + 1]], penalty)
                        j = int(shares.argmax())
                        names[i], scores[i] = languages[j], min(1.0, float(shares[j]))
                        maps[i] = [(languages[k], float(shares[k])) for k in np.flatnonzero(shares)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))]
                    + [batch.column(2 + k).slice(lo, hi - lo) for k in range(len(carry))],
                    ["id", "lang_pred", "score", "languages", *(f"carried_{k}" for k in range(len(carry)))],
                )

    carried = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), *carried)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())), *narrow.schema.fields[2:]])
    return narrow.mapInArrow(run, schema).toDF(id_column, "lang_pred", "score", "languages", *carry)
