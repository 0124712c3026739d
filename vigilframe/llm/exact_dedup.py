"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, without_spaces


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key tuple occurs more than once.

    Counting combines on the map side. The join key is an expression over the grouping key, so that both sides get an
    exchange of their own and adaptive execution can split a hot key's rows.
    """
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    many = many.select(F.concat_ws("/", *keys).alias("__k"))
    return rows.withColumn("__k", F.concat_ws("/", *keys)).join(many, "__k", "left_semi").drop("__k")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_all: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without characters of [\\x20\\x09-\\x0D]; null counts as empty, so null, empty and
    blank texts form one group. The row with the most code points stays, then the smallest id; a null id comes last. Of
    several rows with the id that stays, all those of that length are marked kept. Whatever other columns the input has
    is ignored. An empty table gives an empty result.

    A first scan takes lengths and prefix hashes. Only rows that share a length are grouped by prefix, and only rows that
    share length and prefix are grouped by full hash. With hash_all every row's hash is wanted, so the first scan takes it
    along; without, full content is read in a second scan, for those rows alone, and the hash of all others is null.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), F.length(text).alias("__points"), without_spaces(text).alias("__norm"))
    base = base.withColumns({"__len": F.length("__norm"), "__prefix": F.xxhash64(F.substring("__norm", 1, prefix_chars))})
    full = F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha")
    slim = ["__id", "__points", "__len", "__prefix"]
    narrow = materialize(base.select(*slim, *([full] if hash_all else [])))
    survivors = _shared(_shared(narrow, ["__len"]), ["__len", "__prefix"])
    if hash_all:
        rows, alone = narrow, None
    else:
        keys = materialize(survivors.select("__len", "__prefix").distinct())
        rows = materialize(base.join(keys, ["__len", "__prefix"], "left_semi").select(*slim, full))
        survivors, alone = rows, narrow.join(keys, ["__len", "__prefix"], "left_anti")
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("z"), F.col("__id").alias("i")))
    groups = survivors.groupBy("__sha").agg(F.count(F.lit(1)).alias("__n"), best.alias("__b")).filter("__n > 1")
    groups = groups.select(F.concat(F.lit("g"), "__sha").alias("__g"), "__n", "__b")
    out = rows.withColumn("__g", F.concat(F.lit("g"), "__sha")).join(groups, "__g", "left").select("__id", "__points", "__sha", "__n", "__b")
    if alone is not None:
        types = {f.name: f.dataType for f in out.schema}
        out = out.unionByName(alone.select("__id", "__points", *[F.lit(None).cast(types[c]).alias(c) for c in ("__sha", "__n", "__b")]))
    own = F.col("__n").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.when(own, F.col("__id")).otherwise(F.col("__b.i")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("__id").eqNullSafe(F.col("__b.i")) & (-F.col("__points") == F.col("__b.p")))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
