"""b-bit MinHash groups against brute force; estimates, bands, large buckets and large groups on their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import minhash, set_links


def texts_of(rng, groups, copies, length, changes):
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 4000, length)]
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, length, int(rng.integers(0, changes + 1))):
                words[at] = f"v{rng.integers(0, 4000)}"
            out.append(" ".join(words))
    return out


def shingles(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts):
    """Size and smallest row of the group, for each text."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(1)
    texts = [t for length, changes in ((400, 8), (200, 6), (90, 2), (40, 1)) for t in texts_of(rng, 4, 12, length, changes)]
    texts += [None, "", " \n", "One", "one", "two words", "Two  WORDS", "a b c", "É a b", "é a b", "x " * 30_000, texts[0].upper(), texts[0]]
    return texts


@pytest.mark.parametrize(("block_bytes", "hot"), [(16 << 20, 4096), (6000, 5), (1, 2)])
def test_groups_match_brute_force(spark, corpus, block_bytes, hot):
    """Small limits force every level of splitting and blocks of pairs of parts; the groups stay the same."""
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(3)
    got = sorted((r["__id"], r["__size"], r["__component"]) for r in minhash.near_duplicates(docs, block_bytes=block_bytes, hot=hot).collect())
    assert got == brute(corpus)


def test_repeated_rows_null_ids_and_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (None, text), (3, text + " more"), (None, "alone in here"), (None, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("__id", "__raw", "key", "root", "uid", "sig", "bands", "n", "i", "r")})
    got = sorted(((r["__id"], r["__size"], r["__component"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 48, 3), (5, 48, 3), (None, 48, 3), (3, 49, 3), (None, 1, None), (None, 0, None), (8, 0, 8), (9, 0, 9)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_are_corrected_for_chance():
    """Over pairs of known similarity the mean estimate is near it for every number of bits; unlike lanes match a plain count."""
    rng = np.random.default_rng(2)
    for bits in (1, 2, 4, 8):
        scheme, wrong = minhash.Scheme(bits=bits), []
        for _ in range(40):
            both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))
            low = [scheme.minima(np.unique(np.r_[both, x])) for x in (one, two)]
            words = scheme.words([scheme.pack(x) for x in low])
            unlike = int(scheme.unlike(words[0], words[1:])[0])
            assert unlike == int(((low[0] ^ low[1]) & np.uint64((1 << bits) - 1) > 0).sum())
            wrong.append(float(scheme.estimate(unlike)) - 0.85)
        assert abs(np.mean(wrong)) < 0.015


def test_pairs_at_the_threshold_become_candidates():
    """Of 3000 pairs at similarity 0.85 every one shares a band and stays within the unlike lanes allowed."""
    scheme, rng = minhash.Scheme(), np.random.default_rng(3)
    for _ in range(3000):
        both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (34, 3, 3))
        low = [scheme.minima(np.r_[both, x]) for x in (one, two)]
        bands = [np.frombuffer(scheme.band_keys(x), dtype=np.uint64) for x in low]
        words = scheme.words([scheme.pack(x) for x in low])
        assert (bands[0] == bands[1]).any() and scheme.unlike(words[0], words[1:])[0] <= scheme.unlike_at_most


def test_forest_of_sets_connects_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, int(rng.integers(40, 60)), replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 4)), dtype=np.uint64)]) for _ in range(80)]
    for at_once in (1, 100, 1 << 19):
        links = set_links.jaccard_links(sets, (80, 100), at_once=at_once)
        label = list(range(len(sets)))
        for pairs in (links, [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]):
            label = list(range(len(sets)))
            for _ in range(len(sets)):
                for x, y in pairs:
                    label[x] = label[y] = min(label[x], label[y])
            first = label if pairs is links else first
        assert first == label and len(links) < len(sets)
