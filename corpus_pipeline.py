"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix and shard.

In every stage null and empty texts are texts without words, repeated rows are
rows of their own unless the stage says otherwise, a null doc_id names nothing,
further columns pass through whatever their names, and an empty table gives an
empty result. Texts are read whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postledger.llm import decontaminate, mixing, nbsvm, sharding, simhash
from postledger.llm.common import cut_lineage, documents, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, judged by their text alone, so copies share their fate.

    A text without words has the score of the machine's bias. Without any labels all documents stay.
    """
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Texts without words are one group. Of rows that repeat a doc_id one stays; rows without a doc_id all stay.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Items without words, null or empty, are in no document."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target rates, in a global random order. Null sources are one source."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each remaining row, shards of nearly equal bytes; equal texts share a shard. Null texts have no bytes."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first stage fits a model, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next.

    Gives the rows of the last stage (doc_id, size, text_crc32, law, shard, slot, grown_shard). Reruns give the same rows.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
