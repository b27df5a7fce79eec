"""The contract queries ``opN_<name>`` and their SQL, for the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import sql
from lodestrata.llm.bpe import BpeParams, token_digests
from lodestrata.llm.decontamination import contamination_report
from lodestrata.llm.html import extract_pages
from lodestrata.llm.knn import top_k
from lodestrata.llm.langid import identify_languages
from lodestrata.llm.minhash import NearDuplicateParams, near_duplicates
from lodestrata.llm.pii import find_personal_data
from lodestrata.llm.sharding import ShardParams, ShardStore
from lodestrata.llm.substring import remove_repeats
from lodestrata.llm.toxicity import toxicity
from lodestrata.runtime import scratch_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in four parts, compacted as they come, and read back through the last manifest.

    Returns per row its doc_id, bytes and digest, and whether its shard keeps to the target size.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch_path(spark, "shards"), ShardParams(target=32 << 20, arrival=4 << 20))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for arrival in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)) == arrival), size // 8)
    for everything in (False, True):
        store.compact(everything)
        store.vacuum(older_than=0)  # this store has no other writer
    rows = store.read()
    if not store.manifest()[1]["shards"]:
        held = F.lit(True)
    else:
        held = rows.metadataColumn("_metadata")["file_size"] <= int(store.params.target * 1.25)
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
        held.alias("within_target"),
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary of the contract; only its path is known here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), BpeParams(tokenizer_path()))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDuplicateParams(shingle=2))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sql.SHARDED,
    "op3_benchmark_decontamination": sql.CONTAMINATION,
    "op6_substring_dedup": sql.SUBSTRINGS,
    "op7_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op9_exact_top_k": sql.TOP_K,
}
