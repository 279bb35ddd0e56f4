"""documents, stage by stage, to shards of a training mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkfields.llm import decontamination, language_id, mixing, sharding, simhash_dedup
from sparkfields.llm.common import folder, table

#: A document stays if its language is known and has at least this share of its letters.
LEAST_SHARE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one main language; null texts and texts without letters go, repeated rows stay, no rows give none."""
    return language_id.keep_known(docs, language_id.train(docs), LEAST_SHARE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id, null last; of equal rows one stays; texts without words are one group."""
    return simhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts stay, and so do repeated rows."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null source is a source, empty texts have no words, equal rows share their copies."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; null text is empty, equal rows have slots of their own."""
    return sharding.place(docs)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language models, components and random rounding aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
