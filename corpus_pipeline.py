"""A corpus pipeline of five stages over `documents`; each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilframe.llm import common, stages

#: (name, function of spark, docs and sf_dir), in order.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_benchmark),
    ("mixing", stages.mix),
    ("sharding", stages.shard),
]

#: Trained models and fingerprints have no SQL form; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What every stage but the last returns is written to the shared folder and read back."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else common.materialize(out)
    return docs
