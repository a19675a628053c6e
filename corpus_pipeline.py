"""From raw documents to training sequences: five stages, each one operator of relish.llm.

Every stage works on all rows that the one before kept and returns the columns
of documents, the last one the packed sequences.  ``run`` writes each stage's
result as Parquet to the shared folder and reads it back.

Null and empty texts are clean, similar to nothing and without passages; they
have no words to mix, so the mix leaves them out.  Long texts are read whole.
Repeated rows are near copies of each other; null ids and null sources are
values of their own.  Columns besides doc_id, text and source pass through
untouched, whatever their names; only n_chars follows the text.  An empty
table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relish.llm import jaccard, mixing, packing, substring, toxicity
from relish.session import stage


READ = ("doc_id", "text", "source")  # what the stages read; other columns are carried along


def _carried(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns under numbered names, which no operator uses itself."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"carried_{i}") for i, c in enumerate(docs.columns)])


def _given_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``rows``, under their own names."""
    return rows.select(*[F.col(c if c in READ else f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below 0.5."""
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return _given_back(toxicity.score(_carried(docs), model).filter("score < 0.5"), docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by similar sets of five-word shingles."""
    return _given_back(jaccard.keep_one(_carried(docs)), docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of runs of 20 that occur earlier; texts without such runs stay as they are."""
    cut = substring.remove_repeats(_carried(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_length(_given_back(cut.withColumn("text", text), docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated or left out so that each source has its share of words; the last copy of a source is cut."""
    return _with_length(_given_back(mixing.mixed_documents(_carried(docs)), docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, each of one document."""
    pieces = packing.pack(_carried(docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
