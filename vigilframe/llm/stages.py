"""Pipeline stages: each takes (spark, docs, sf_dir), applies one operator's decisions and returns documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, sharding, simhash, toxicity
from .common import materialize_seen, packed
from .queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, score 0.7 or more. The model is learned from the source tables.

    Null and empty texts score as texts without words and stay. Repeated rows are judged each, alike; ids and other
    columns play no part, so ties, null ids and clashing names do not matter. An empty table gives an empty table.
    """
    return toxicity.score_documents(docs, toxicity_model(spark, sf_dir), docs.columns, keep_below=0.7).select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id, null last, and of several rows with that id one.

    Near duplicates have five-word shingles of Jaccard similarity 0.8 or more (simhash.near_copies). Groups are found on
    ids, hashes and shingles. The documents are then joined once with the id and text hash of the rows that stay. Rows
    that repeat both are combined before a shuffle, and only where some group keeps such a row. Null, empty and blank
    texts are copies of each other. Columns are carried as one struct. An empty table gives an empty table.
    """
    each = simhash.near_copies(docs).groupBy("__group", "__id", "__raw").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__raw", "__n")).alias("m")
    stay = each.groupBy("__group").agg(first).select(F.col("m.__id").alias("__id"), F.col("m.__raw").alias("__raw"), F.col("m.__n").alias("__n"))
    stay, seen = materialize_seen(stay, repeated=F.count_if(F.col("__n") > 1))
    rows = docs.select(packed(docs), F.col("doc_id").alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"))
    kept = rows.join(stay, F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__raw")))
    if seen["repeated"]:
        kept = kept.groupBy("__d", "__t").agg(F.first("__row").alias("__row"))
    return kept.select("__row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item.

    Null and empty texts contain none and stay; repeated rows are judged each, alike; a document goes if any of its
    windows matches, so ties play no part. Only the text column is read by name. An empty table gives an empty table.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a document that it takes twice is there twice.

    Rows lie as the splitting tree deals them: partitions by shard, rows in the shard's order. A null source is a source;
    null and empty texts have no words and are taken with their block. Repeated rows are taken alike. Columns are carried
    as one struct. An empty table gives an empty table.
    """
    drawn = mixing.draw(mixing.mix_sources(docs, shards=8, seed=9))
    return mixing.shuffled(drawn, shards=8).select("__row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, by law `rows`. Nulls, empty texts and repeated rows are numbered like others;
    rows that agree in id and text are interchangeable. An empty table gives an empty table."""
    out = sharding.shard_documents(docs, shards=8, seed=10)
    return out.select("__row.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
