"""The operators applied to the whole given tables, with their production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph, decontaminate, mixing, nbsvm, pages, phrases, pii, quality, repair, secrets, sharding, simhash, tokens
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@_query("op1_quality_rules", quality.JUDGE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


@_query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(documents(spark, sf_dir)))


@_query("op4_mixing", mixing.MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@_query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal")


@_query("op6_secrets", secrets.SCAN_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    return secrets.digests(secrets.findings(versions, secrets.scan(versions))).withColumnRenamed("path", "doc_id")


@_query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), _model_file("piece_bpe_32k.model"))


@_query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@_query("op9_main_text", pages.SIMPLE_PAGES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@_query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query("op11_collocations", phrases.COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


@_query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_neighbours(documents(spark, sf_dir))


@_query("op13_conversation_repair", repair.REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def _model_file(name: str) -> bytes:
    """A tokenizer's file, read where the driver runs; it belongs to the installed library, not to the input."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()
