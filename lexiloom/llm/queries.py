"""Queries over the driver's tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import ann, lcp, licenses, linededup, mixing, packing, prefixtrie, quality, sharding, simhash, toxicity, warc, whitening


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies: LEXILOOM_TOKENIZERS, or the installed package of public tokenizers."""
    if folder := os.environ.get("LEXILOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clean = linededup.dedup_lines(docs.select("doc_id", "text", F.length("text").alias("was")), report=True)
    removed = F.coalesce(F.col("was") - F.length("text"), F.lit(0)).cast("long")
    return clean.select("doc_id", "n_chunks", "removed_chunks", removed.alias("removed_chars"), "kept_doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draws(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = F.aggregate("drawn.draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return drawn.select("doc_id", "drawn.size", "drawn.source_size", "drawn.target", taken.alias("taken"), "source", "drawn.quota", "drawn.draws")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations")).drop("digest")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages"))))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mixing_to_weights": op6_mixing_to_weights,
    "op7_fingerprints": op7_fingerprints,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_warc": op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op12_prefix_trie": prefixtrie.ORACLE,
    "op13_warc": warc.ORACLE,
}
