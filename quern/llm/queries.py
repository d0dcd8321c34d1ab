"""The operN queries on the driver's tables, each a thin digest of its operator's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import circulant_minhash, divergence, hnsw, interpolation, line_runs, mixing, oracles, packing, suffix_dedup, token_counts, url_rules

#: The rules of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents committed to a ledger in four batches, one of them twice, then totals."""
    from quern.llm.common import Work

    work = Work(spark, "token-counts")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = work.save(token_counts.count_tokens(docs, vocabulary(), "byte_bpe_50k"), "counts")
    ledger = token_counts.TokenLedger(spark, f"{work.path}/ledger")
    for k in (0, 1, 2, 3, 1):
        ledger.commit(f"insert-{k}", token_counts.inserts(counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k)))
    return ledger.totals()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), 2048)


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return circulant_minhash.near_duplicates(docs, size=3, percent=85)


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return divergence.judge_quality(docs).select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"), F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat").alias("n_repeat_words"), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.rules_table(spark, URL_RULES))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_runs.dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts, "op2_packing": op2_packing, "op3_circulant_minhash": op3_circulant_minhash, "op4_hnsw": op4_hnsw, "op5_mixing": op5_mixing,
        "op6_interpolation": op6_interpolation, "op7_divergence": op7_divergence, "op8_suffix_dedup": op8_suffix_dedup, "op9_url_rules": op9_url_rules, "op10_line_runs": op10_line_runs,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
