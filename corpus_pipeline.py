"""From raw documents to shuffled training shards, in five stages.

Each stage takes all that its predecessor kept. Near-duplicates are texts that
share 80 % of their five-word shingles. Stages take nulls in any column, empty
texts, repeated rows and empty tables, and return the columns they were given;
the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontam, ngram_join, sharding, source_mix, toxicity
from verdigris.llm.scratch import dropped, written

WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts predicted toxic; one without words is clean."""
    return toxicity.clean_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, that of least doc_id; rows without words all stay."""
    return ngram_join.one_of_each(docs, WORDS, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents a twentieth or more of whose words stand in benchmark windows; one without words is clean."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by its source's target; one of size 0 is taken like others of its source."""
    return source_mix.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each with its shard and its slot there."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix),
    ("sharding", shard),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
