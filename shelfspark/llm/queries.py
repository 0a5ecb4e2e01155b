"""The corpus operators' queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, linededup, mixing, packing, secrets, simhash, sql, substrings, tokenfile, topk


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the base rules; the ledger itself adds no spans of its own."""
    found = secrets.scan(_documents(spark, sf_dir), path="doc_id")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    listed = secrets.named(F.col("spans"))
    return found.select("doc_id", *(number(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.RULES)), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and links of at most two differing bits."""
    found = simhash.components(_documents(spark, sf_dir), shingle=3)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_documents(spark, sf_dir)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_documents(spark, sf_dir), _tokenizer(), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what is left of each text (null: null)."""
    out = linededup.remove_spread_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer(), end_id=1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = langid.predict(docs, langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_simhash": op2_simhash,
        "op3_source_mix": op3_source_mix,
        "op4_token_files": op4_token_files,
        "op5_exact_topk": op5_exact_topk,
        "op6_line_dedup": op6_line_dedup,
        "op7_one_bit_ann": op7_one_bit_ann,
        "op8_packing": op8_packing,
        "op9_language_id": op9_language_id,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
