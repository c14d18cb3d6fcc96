"""A training corpus from raw documents in five stages, each on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulyze.llm.decontaminate import without_items
from tabulyze.llm.jaccard_join import one_of_each
from tabulyze.llm.mixing import mixed_rows
from tabulyze.llm.sharding import with_shard
from tabulyze.llm.stores import stored
from tabulyze.llm.toxicity import fit_toxicity, without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_items(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_shard(docs, [1.0] * 16)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_similar), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", assign_shards)]
# a learned score and exact joins of shingle sets: tested against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
