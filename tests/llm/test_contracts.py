"""Samples of bounded size, ids of any kind, clashing names, and brute force for decoding and scoring parts."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import common, decontaminate, exact_dedup, language_id, lm_score, mixing, pii, sharding, simhash, stages, token_counts, toxicity

NAMES = ["__id", "__text", "__size", "__k", "__s", "__h", "__u", "__row", "__fp", "__hash", "__raw", "__group", "__shard", "__order", "__slot", "key", "root", "held", "block"]


def clashing(spark):
    rows = [(1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"), (3, None, None, None), (4, "un deux trois 1.2.3.4", "fr", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_clashing_names(spark, sf):
    docs = clashing(spark)
    model = language_id.train(["the cat and", "le chat et"] * 30, ["en", "fr"] * 30)
    for out in (
        language_id.identify(docs, model, docs.columns), toxicity.score_documents(docs, toxicity.train([], []), docs.columns), mixing.draw(mixing.mix_sources(docs)), sharding.shard_documents(docs),
    ):
        for r in out.collect():
            assert all(r["__row"][n] == f"own {n}" for n in NAMES)
    for stage in (stages.drop_near_copies, stages.drop_benchmark, stages.mix, stages.shard):
        for r in stage(spark, docs, sf).collect():
            assert all(r[n] == f"own {n}" for n in NAMES)
    assert pii.detect(docs, None).count() == token_counts.count_tokens(docs).count() == exact_dedup.exact_dedup(docs).count() == lm_score.lm_scores(docs).count() == 4
    assert simhash.near_groups(docs).count() == simhash.near_copies(docs).count() == 4


def test_samples_are_bounded(spark):
    same = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("call 1.2.3.4 now").alias("text"), F.lit("en").alias("lang"))
    assert len(language_id.sample_rows(same, F.lit(True), 50)) <= 100
    taken = []
    train, pii.train = pii.train, lambda samples, seed: taken.extend(samples)
    try:
        pii.train_from(same, most_texts=40)
    finally:
        pii.train = train
    assert len(taken) <= 80
    labels = spark.createDataFrame([(7, 1)], "doc_id int, toxic int")
    fit, toxicity.train = toxicity.train, lambda texts, y, *a, **k: taken.append(len(texts)) or fit(texts, y)
    try:
        toxicity.train_from(same, labels, F.lit(True), most_rows=30)
    finally:
        toxicity.train = fit
    assert taken[-1] <= 60


def test_one_long_text_does_not_end_the_fit(spark):
    """Texts that do not fit are passed over wherever the hash puts them; where none fits, that is an error."""
    rows = [(i, ("bad words here " if i % 2 else "fine words there ") * (5000 if i in (3, 8, 20) else 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    taken = []
    fit, toxicity.train = toxicity.train, lambda texts, y, *a, **k: taken.append((texts, y)) or fit(texts, y)
    try:
        toxicity.train_from(docs, labels, F.lit(True), most_bytes=20_000)
        with pytest.raises(ValueError, match="no labelled text fits"):
            toxicity.train_from(docs, labels, F.lit(True), most_bytes=10)
    finally:
        toxicity.train = fit
    texts, y = taken[0]
    assert len(texts) > 35 and max(map(len, texts)) < 100 and len(set(y)) == 2


def test_text_ids(spark):
    rows = [("", "mail a@b.co or 10 20", "en", "s"), (None, "le chat 12", "fr", "s"), ("x", "the cat 1", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    assert len(language_id.sample_rows(docs, F.lit(True), 50)) == 3
    assert pii.detect(docs, pii.train_from(docs)).count() == 3
    bench = spark.createDataFrame([("", "a b c d e f"), ("k", "g h i j k l"), (None, None)], "item_id string, text string")
    assert decontaminate.find_contamination(docs, bench).count() == 0
    assert toxicity.train_from(docs, spark.createDataFrame([("", 1), ("x", 0)], "doc_id string, toxic int"), F.lit(True)).score(["a"]).shape == (1,)


def test_scratch_folder_is_shared_or_an_error(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())


def test_viterbi_is_the_best_of_all_paths():
    net = pii.BiLstmCrf(dim=3, hidden=4, seed=2)
    net.p["trans"] = np.random.default_rng(0).normal(0, 1, (pii.LABELS, pii.LABELS)).astype(np.float32)
    ids = np.random.default_rng(1).integers(0, 99, (3, 4))
    path, _ = net.decode(ids)
    e, _ = net.emissions(ids)
    t = net.p["trans"] + net.block
    for row in range(3):
        every = {y: e[row, 0, y[0]] + net.block[0][y[0]] + sum(t[a, b] + e[row, k + 1, b] for k, (a, b) in enumerate(itertools.pairwise(y))) for y in itertools.product(range(pii.LABELS), repeat=4)}
        assert tuple(path[row]) == max(every, key=every.get)


def test_reconcile_is_the_best_of_all_sets():
    rng = np.random.default_rng(3)
    text = "1.2.3.4 " * 20
    for _ in range(60):
        found = []
        for _ in range(7):
            s = int(rng.integers(0, 19)) * 8
            found.append((("ip", s, s + 7), float(rng.uniform(0.9, 1))))
            if rng.random() < 0.5:
                found.append((("phone", s + int(rng.integers(0, 4)), s + 8 + int(rng.integers(3, 8))), 0.95))
        ok = [(x, p) for x, p in found if pii.plausible(x[0], text[x[1] : x[2]])]
        weight = {}
        for x, p in ok:
            weight[x] = max(p, weight.get(x, 0))
        best = 0.0
        spans = list(weight)
        for mask in range(1 << len(spans)):
            take = sorted((spans[i] for i in range(len(spans)) if mask >> i & 1), key=lambda x: x[1])
            if all(a[2] <= b[1] for a, b in itertools.pairwise(take)):
                best = max(best, sum(weight[x] * (x[2] - x[1]) for x in take))
        got = pii.reconcile(found, [], text, 0.9)
        assert math.isclose(sum(weight[x] * (x[2] - x[1]) for x in got), best)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(got))


class Ideal:
    """Labels every run of characters but ~ as one address."""

    def decode(self, ids):
        on = (ids != pii.char_ids("~")[0]) & (ids != 0)
        begin = on & ~np.pad(on, ((0, 0), (1, 0)))[:, :-1]
        return np.where(begin, 1, np.where(on, 2, 0)), np.ones(ids.shape)


@pytest.mark.parametrize("length", range(22, 62, 6))
def test_spans_of_any_length_at_any_offset(length):
    address = "a" * (length - 18) + " [at] " + "b" * 4 + " [dot] c"
    assert len(address) in (length, length - 1, length + 1)
    for at in range(96):
        text = "~" * at + address + "~" * 100
        assert pii.find_spans([text], Ideal()) == [([], [("email", at, at + len(address))])]


def test_subwords_match_a_plain_loop():
    texts = ["The cat, le chat!", "", "123", "È vero?  a"]
    grams, starts, letters = language_id.subwords(texts, 1 << 12, (2, 3))
    for k, t in enumerate(texts):
        low = t.lower()
        assert letters[k] == sum(c.isalpha() for c in low)
        for order, g in zip((2, 3), grams, strict=True):
            end = starts[k + 1] if k + 1 < len(texts) else len(g)
            padded = "   " + low + "   "
            got = [int(x) for x in g[starts[k] : end]][: len(low) + 3]
            unit = [ord(c) if c.isalpha() else 32 for c in padded]
            want = []
            for i in range(len(low) + 3):
                piece = padded[i : i + order]
                inside = (piece[0].isalpha() or piece[-1].isalpha()) and all(c.isalpha() for c in piece[1:-1])
                h = unit[i]
                for j in range(1, order):
                    h = (h * 0x01000193 + unit[i + j]) & 0xFFFFFFFF
                h = ((h ^ order) * 2654435761 & 0xFFFFFFFF) >> (32 - 12)
                want.append(max(h, 1) if inside else 0)
            assert got == want


def test_language_logits_match_a_plain_loop():
    model = language_id.train(["the cat and the dog", "le chat et le chien"] * 30, ["en", "fr"] * 30, buckets=1 << 10)
    texts = ["the chat", "1 2", "le dog est là"]
    z, _ = model.logits(texts)
    for k, t in enumerate(texts):
        grams, _, _ = language_id.subwords([t], 1 << 10, model.orders)
        used = [int(x) for g in grams for x in g if x > 0]
        want = np.mean([model.table[x] for x in used], axis=0) + model.bias if used else model.bias
        assert np.allclose(z[k], want, atol=1e-5)


def test_convolution_matches_a_plain_loop():
    model = toxicity.train(["bad awful thing here now", "good nice thing here now"] * 40, [1, 0] * 40, least_steps=20)
    texts = ["bad thing", "", "nice here now awful unheard"]
    for t, z in zip(texts, model.logits(texts), strict=True):
        ids = [*model.ids([t])[0]]
        x = [model.emb[i] for i in ids]
        top = []
        for f in model.filters:
            acts = [sum(x[i + j] @ f[j] for j in range(len(f))) for i in range(len(x) - len(f) + 1)]
            top.append(np.max(acts, axis=0))
        want = np.maximum(np.concatenate(top) + model.shift, 0) @ model.out + model.bias
        assert math.isclose(z, want, rel_tol=1e-4, abs_tol=1e-4)


def edits(rng, words):
    """An item with a few words changed, put in or left out, or one of its ends cut off."""
    own = list(words)
    for _ in range(int(rng.integers(len(words) > 8, 4))):  # shorter items match whole or not at all
        kind, at = int(rng.integers(0, 4)), int(rng.integers(0, len(own)))
        if kind == 0:
            own[at] = f"q{rng.integers(0, 999)}"
        elif kind == 1:
            own.insert(at, f"q{rng.integers(0, 999)}")
        elif kind == 2:
            own.pop(at)
        else:
            own = own[1:] if rng.random() < 0.5 else own[:-1]
    return own


@pytest.mark.parametrize("length", [6, 9, 12, 16, 24, 40, 80])
def test_decontamination_recall_at_the_threshold(length):
    """Of copies with edits whose best window has similarity 0.8 or more, found by the fingerprints: 0.9 at least."""
    rng = np.random.default_rng(length)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, length))) for k in range(60)]
    index = decontaminate.BenchmarkIndex(items, 5, 0.8, decontaminate.RADIUS)
    there = found = 0
    for _ in range(6):
        for k, item in items:
            words = [f"z{x}" for x in rng.integers(0, 3000, 30)] + edits(rng, item.split()) + [f"z{x}" for x in rng.integers(0, 3000, 30)]
            bag = Counter(tuple(item.split()[j : j + 5]) for j in range(length - 4))
            best = 0.0
            for s in range(len(words) - length + 1):
                mine = Counter(tuple(words[s + j : s + j + 5]) for j in range(length - 4))
                best = max(best, 2 * (bag & mine).total() / (bag.total() + mine.total()))
            if best >= 0.8:
                there += 1
                found += k in [h[0] for h in index.search(" ".join(words))]
    assert there > 20 and found >= 0.9 * there


def test_index_returns_a_small_share():
    rng = np.random.default_rng(9)
    stored = [int(x) for x in rng.integers(0, 1 << 63, 400)]
    blocks = decontaminate.HammingBlocks(stored, decontaminate.RADIUS)
    share = np.mean([len(blocks.reached(int(x))) for x in rng.integers(0, 1 << 63, 200)]) / len(stored)
    assert share < 0.3
