"""The pipeline's stages against brute force over what each stage was given."""

from collections import Counter

from vigilframe.llm import decontaminate, queries

from .test_near_copies import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == COLUMNS
    toxic = {r["doc_id"] for r in queries.op7_toxicity(spark, sf).filter("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in inputs[1]) == sorted(r["doc_id"] for r in inputs[0] if r["doc_id"] not in toxic)

    given = sorted(inputs[1], key=lambda r: r["doc_id"])
    stay = {given[i]["doc_id"] for i in brute([r["text"] for r in given])}
    assert sorted(r["doc_id"] for r in inputs[2]) == sorted(stay)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.BenchmarkIndex(items, 5, 0.8, decontaminate.RADIUS)
    assert sorted(r["doc_id"] for r in inputs[3]) == sorted(r["doc_id"] for r in inputs[2] if not index.search(r["text"]))

    copies = Counter(r["doc_id"] for r in inputs[4])
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in inputs[3]}
    out = docs.collect()
    assert Counter(r["doc_id"] for r in out) == copies
    shards = Counter(r["shard"] for r in out)
    assert max(shards.values()) - min(shards.values()) <= 1


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    import corpus_pipeline

    rows = [(None, None, None, None, None), (None, "same text here now", "en", "a", 3), (1, "same text here now", "en", "a", 3), (1, "same text here now", "en", "a", 3), (2, "", "fr", None, 0), (3, "quite other words stand in this one", "en", "b", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for some in (docs, docs.limit(0)):
        at = some
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{some is docs}/{i}"
            stage(spark, at, sf).write.parquet(path)
            at = spark.read.parquet(path)
            if name == "simhash_dedup" and some is docs:
                assert sorted(str(r["doc_id"]) for r in at.collect()) == ["1", "2", "3"]
        assert some is docs or at.count() == 0
