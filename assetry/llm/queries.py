"""Registered queries of the corpus operators, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetry.llm import (
    bpe,
    conversations,
    merkle,
    minhash,
    packing,
    pii,
    quality,
    rules,
    sql,
    substring,
    topk,
    toxicity,
    warc,
    wavelet,
)
from assetry.llm.common import documents, labels, ship_package


def op1_wavelet(spark, sf_dir):
    shards = wavelet.write(documents(spark, sf_dir))
    return wavelet.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir))


def op3_toxicity(spark, sf_dir):
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir)).drop("clauses")


def op4_topk(spark, sf_dir):
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_minhash(spark, sf_dir):
    found = minhash.near_duplicates(documents(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring(spark, sf_dir):
    return substring.dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_warc(spark, sf_dir):
    ship_package(spark)
    archives = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return (
        warc.read(archives, payload=False)
        .where("last")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def op8_rules(spark, sf_dir):
    return rules.apply_policy(rules.ledger(documents(spark, sf_dir))).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_quality(spark, sf_dir):
    """`source` stands for the host and `lang` for its path: documents have neither."""
    scored = quality.score(documents(spark, sf_dir), labels(spark, sf_dir), keep_text=False)
    return scored.select(
        "doc_id",
        F.col("quality_evidence").alias("evidence"),
        "host_mean",
        "path_mean",
        F.col("quality_score").alias("score"),
        F.col("quality_kept").alias("kept"),
    )


def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op11_pii(spark, sf_dir):
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op12_merkle(spark, sf_dir):
    return merkle.prove(merkle.build(documents(spark, sf_dir)))


def op13_conversations(spark, sf_dir):
    ship_package(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    told = conversations.summaries(conversations.damaged(rows))
    return conversations.of_every(rows, told)


QUERIES = {
    "op1_wavelet": op1_wavelet,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_topk": op4_topk,
    "op5_minhash": op5_minhash,
    "op6_substring": op6_substring,
    "op7_warc": op7_warc,
    "op8_rules": op8_rules,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_pii": op11_pii,
    "op12_merkle": op12_merkle,
    "op13_conversations": op13_conversations,
}

ORACLE = {
    "op8_rules": rules.LEDGER_SQL,
    "op12_merkle": sql.MERKLE,
    "op13_conversations": sql.CONVERSATIONS,
}
