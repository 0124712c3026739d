"""Partitions with the same contents keep blocks of their own."""

import shutil
from collections import Counter
from pathlib import Path

from vigilframe.llm import lm_score


def test_repeated_part_files_are_scored_each(spark, tmp_path):
    rows = [(i, f"a b{i % 7} c d{i % 3} e", "en", "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/d")
    part = next(Path(f"{tmp_path}/d").glob("*.parquet"))
    shutil.copy(part, part.with_name("copy.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert docs.rdd.getNumPartitions() == 2
    out = lm_score.lm_scores(docs, block_tokens=100, bucket_hashes=7).collect()
    assert Counter(r["doc_id"] for r in out) == {i: 2 for i in range(60)}
    assert len({(r["doc_id"], r["score"], r["n_tokens"]) for r in out}) == 60
