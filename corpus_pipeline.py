"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Defined cases, for every stage: an empty table gives an empty one of the same columns; further columns
are carried by all stages but the last, whatever their names; equal rows are treated alike; very long
texts are read whole. Null and empty texts have no language and go in the first stage; later stages,
used alone, keep them. Rows without a doc_id are never near copies of another, and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import contamination, jaccard, language, pieces, pii
from attest.llm.shared import shared_folder, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from the rows that have one; rows that it rejects go, as do those without letters.

    Where no row has a language none can be learned, and every row goes.
    """
    model = language.fit(docs, "text", "lang", "doc_id")
    found = language.identify(docs, model)
    return found.where(~F.col("rejected")).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with five-word shingle sets linked by a similarity of 0.8, the least doc_id stays.

    Texts that differ under one doc_id are one document and stay together; equal rows become one.
    """
    return jaccard.without_near_copies(docs, jaccard.Settings(words=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; without items none does."""
    return contamination.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows the text, null for a null one."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, as count and checksum, and whether decoding gives the text back.

    A null text counts as empty, of no ids, and comes back as empty.
    """
    import public_tokenizers

    return pieces.encoded_digest(docs, pieces.Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", encoded),
]

#: Learned models and hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"{folder}/{i}-{name}")
    return docs
