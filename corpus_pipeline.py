"""A corpus pipeline of five stages, each written and read again before the next.

Stages: documents that the quality classifier rejects go; repeated line chunks go; of near-duplicates (word
5-shingles, Jaccard similarity 0.8 or more) one document stays; sources are mixed to their target weights; the mix is
packed into sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import jaccard, linededup, mixing, packing, quality, simhash
from lexiloom.llm.common import materialize
from lexiloom.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on the labels of ``sf_dir``, predicts good. Null texts score as empty ones."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the chunks of lines that occur elsewhere; null texts stay null."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of word 5-shingles with similarity 0.8 or more: that of the smallest doc_id.

    Documents meet by their SimHash fingerprints of these shingles and op2's covering masks, and by MinHash bands where
    similar documents differ in more bits; their shingle sets then decide.
    """
    return simhash.keep_one(docs, jaccard.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources ask; null is a source, null texts have no words."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null text is one piece of one token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learnt weights, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; an empty table gives an empty one, of the last stage's columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
