"""The dealt shards reach op9 and the pipeline's mix stage."""

from collections import Counter

from pyspark.sql import functions as F

from vigilframe.llm import mixing, queries, stages


def test_op9_rows_come_from_the_tree(spark, sf):
    rows = queries.op9_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    assert len(rows) == docs.count()
    drawn = Counter((r["__row"]["doc_id"], r["__shard"], r["__order"]) for r in mixing.draw(mixing.mix_sources(docs, shards=8, seed=9)).collect())
    assert drawn == Counter((r["doc_id"], s, o) for r in rows for s, o in zip(r["shards"], r["orders"], strict=True))
    assert all(r["copies"] == len(r["shards"]) and r["taken"] == r["size"] * r["copies"] for r in rows)


def test_splitting_tree_decides_shards(spark, sf, monkeypatch):
    """With all blocks dealt to the last shard, every copy is there."""

    def last(blocks, shards, seed):
        out = mixing.np.zeros((len(blocks), shards), dtype=mixing.np.int64)
        out[:, -1] = blocks
        return out

    monkeypatch.setattr(mixing, "splitting_tree", last)
    assert {s for r in queries.op9_mixing(spark, sf).collect() for s in r["shards"]} == {7}


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    """Another seed of the tree, or all blocks in one shard, changes which rows a partial pass takes; totals stay near the targets."""
    docs = many(spark)
    taken, sums = {}, {}
    dealt, seeds = mixing.splitting_tree, mixing.leaf_seeds
    for name in ("as is", "other seed", "one shard", "half"):
        if name == "other seed":
            monkeypatch.setattr(mixing, "splitting_tree", lambda blocks, shards, seed: dealt(blocks, shards, seed + 77))
            monkeypatch.setattr(mixing, "leaf_seeds", lambda shards, seed: seeds(shards, seed + 77))
        elif name == "one shard":
            monkeypatch.setattr(mixing, "leaf_seeds", seeds)
            monkeypatch.setattr(mixing, "splitting_tree", lambda blocks, shards, seed: mixing.np.c_[blocks[:, None], mixing.np.zeros((len(blocks), shards - 1), dtype=int)])
        elif name == "half":
            monkeypatch.setattr(mixing, "splitting_tree", lambda blocks, shards, seed: dealt(blocks // 2, shards, seed))
        rows = mixing.mix_sources(docs, shards=4, seed=3, block_rows=4).rows.collect()
        taken[name] = sorted((r["__id"], len(r["__dealt"])) for r in rows)
        sums[name] = {t: sum(r["__size"] * len(r["__dealt"]) for r in rows if r["__target"] == t) for t in {r["__target"] for r in rows}}
    assert len({str(taken[x]) for x in ("as is", "other seed", "one shard")}) == 3
    for name in ("as is", "other seed", "one shard"):
        assert all(abs(got - t) <= 12 for t, got in sums[name].items())
    assert sum(sums["half"].values()) < 0.8 * sum(sums["as is"].values())


def many(spark):
    rng = mixing.np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 12))), [None, "a", "b", "c"][i * i % 7 % 4]) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_copies_match_a_plain_reconstruction(spark):
    """All copies of all rows again, from the plan, the tree and the hashes of rows, in loops."""
    shards, seed, block_rows = 4, 3, 8
    mix = mixing.mix_sources(many(spark), shards=shards, seed=seed, block_rows=block_rows)
    plan, np = {p["__s"]: p for p in mix.plan}, mixing.np
    whole = mixing.splitting_tree(np.array([p["quota"] for p in mix.plan]), shards, seed).cumsum(axis=1)
    last = mixing.splitting_tree(np.array([p["last"] for p in mix.plan]), shards, seed + 1)
    own = mix.docs.select("doc_id", F.size(F.split(F.trim("text"), "w")).alias("x"), *mix.keys).withColumn("h", F.xxhash64("__u", F.lit(seed + 1)))
    rows = [(r["doc_id"], r["__s"], r["__u"], r["h"] % plan[r["__s"]]["blocks"], r["x"] - 1 if r["x"] > 1 else 0) for r in own.collect()]
    marks = {(b, k): h for b, k, h in spark.range(200).selectExpr("id AS b", "explode(sequence(0, 3)) AS k").withColumn("h", F.xxhash64("b", F.element_at(F.array(*[F.lit(x) for x in mixing.leaf_seeds(shards, seed + 1)]), F.col("k") + 1))).collect()}
    want = {}
    for i, p in enumerate(mix.plan):
        mine = [r for r in rows if r[1] == p["__s"]]
        words = Counter()
        for r in mine:
            words[r[3]] += r[4]
        blocks, ends = {r[3] for r in mine}, last[i].cumsum()
        leaf = {b: int((ends <= b * p["last_step"] % p["last"]).sum()) for b in blocks} if p["last"] else {}
        turns = []
        for k in range(shards):
            for n, b in enumerate(sorted((b for b in leaf if leaf[b] == k), key=lambda b: marks[b, k])):
                turns.append(((n + 0.5) / last[i][k], k, b))
        left, fits, edge = p["left"], set(), None
        for _, _, b in sorted(turns):
            if left <= 0:
                break
            if words[b] <= left:
                fits.add(b)
            else:
                edge = (b, left)
            left -= words[b]
        some = set()
        if edge:
            gap = edge[1]
            order = sorted((r for r in mine if r[3] == edge[0] and r[4] > 0), key=lambda r: r[2])
            for r in order:
                if r[4] <= gap:
                    some.add(r[0])
                    gap -= r[4]
            rest = [r for r in order if r[0] not in some]
            if rest and min(r[4] for r in rest) - gap < gap:
                some.add(min(rest, key=lambda r: r[4])[0])
        for r in mine:
            copies = [int((whole[i] <= (c * p["blocks"] + r[3]) * p["step"] % p["quota"]).sum()) for c in range(p["passes"])]
            if r[3] in fits or r[0] in some:
                copies.append(leaf[r[3]])
            want[r[0]] = copies
    got = {r["__id"]: [d["__shard"] for d in r["__dealt"]] for r in mix.rows.collect()}
    assert got == want and len({len(c) for c in want.values()}) > 2


def test_shards_draw_disjoint_blocks(spark, sf):
    """Each copy of a row is in one shard, and a source's blocks are dealt as the tree says."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix = mixing.mix_sources(docs, shards=4, seed=3, block_rows=4)
    drawn = mixing.draw(mix).collect()
    assert len({(r["__order"], r["__row"]["doc_id"]) for r in drawn}) == len(drawn)
    for column, seed in (("quota", 3), ("last", 4)):
        quota = mixing.splitting_tree(mixing.np.array([p[column] for p in mix.plan]), 4, seed)
        assert quota.sum(axis=0).max() - quota.sum(axis=0).min() <= 1
    share = Counter(r["__shard"] for r in drawn)
    assert max(share.values()) < 2 * min(share.values())


def test_mix_stage_lies_in_shards_and_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stages.mix(spark, docs, sf).select("doc_id", "text", F.spark_partition_id().alias("part")).collect()
    drawn = mixing.draw(mixing.mix_sources(docs, shards=8, seed=9)).collect()
    drawn.sort(key=lambda r: (r["__shard"], r["__order"]))
    assert [(r["doc_id"], r["text"]) for r in out] == [(r["__row"]["doc_id"], r["__row"]["text"]) for r in drawn]
    parts = {}
    for r, d in zip(out, drawn, strict=True):
        parts.setdefault(r["part"], set()).add(d["__shard"])
    assert all(len(s) == 1 for s in parts.values())


def test_shards_in_several_partitions(spark):
    drawn = spark.range(2000).select("id", (F.col("id") % 3).cast("int").alias("__shard"), F.xxhash64("id").alias("__order"))
    out = mixing.shuffled(drawn, 3).withColumn("part", F.spark_partition_id()).collect()
    assert [(r["__shard"], r["__order"]) for r in out] == sorted((r["__shard"], r["__order"]) for r in drawn.collect())
    assert len({r["part"] for r in out}) == 6
