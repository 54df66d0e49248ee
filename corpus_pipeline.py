"""A corpus pipeline in five stages, each one operator of imagelake.llm.

run(spark, sf_dir) applies STAGES to the documents table: each stage's result is written as Parquet in the cluster's
shared folder and read again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.llm.langid import LanguageModel, identify
from imagelake.llm.line_dedup import line_dedup
from imagelake.llm.near_dedup import near_dedup
from imagelake.llm.packing import pack_powers_of_two
from imagelake.llm.pii import mask_documents
from imagelake.llm.queries import packing_tokenizer
from imagelake.llm.shared import broadcast_if_small, cut


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs from changed, whose text is new; n_chars follows the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the documents and drops those without a letter; all stay where no language is known."""
    model = LanguageModel.learn(docs)
    if not model.languages:
        return docs
    others = tuple(c for c in docs.columns if c != "doc_id")
    # a letterless text has no languages; `und` may be the name of a language learned
    return identify(docs, model, carry=others).where(F.size("languages") > 0).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines similar to earlier ones. A document that loses lines and has no word left goes: a copy of others."""
    lines = line_dedup(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    return _with_text(docs, lines.where(~F.coalesce(emptied, F.lit(False))))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    gone = cut(near_dedup(docs, shingle=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct())
    return docs.join(broadcast_if_small(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <KIND> in place of personal data."""
    return _with_text(docs, mask_documents(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids whose lengths are powers of two up to 2048."""
    return pack_powers_of_two(docs, packing_tokenizer(), with_ids=True, run_bytes=1 << 20, cache_pieces=150_000)  # Spark's heap is large by now


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the language model, the masking of discovered identifiers or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
