"""The near-copy stage against brute force on texts that the masks reach, and large groups and buckets."""

from collections import defaultdict

import numpy as np
import pytest

from vigilframe.llm import simhash


def variants(rng, n, length, changes):
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, length, changes):
            words[at] = f"v{rng.integers(0, 5000)}"
        yield " ".join(words)


def grouped(n, linked):
    """The smallest row of each group, for all rows; linked(i, j) is asked for every pair."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def brute(texts):
    """Groups of texts at Jaccard 0.8 of five-word shingles inside the groups that fingerprints within 5 bits form."""
    lines = [" ".join((t or "").lower().split()) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split() for x in lines)]
    prints = [[simhash.fingerprint(x.encode(), 2, seed) for seed in (42, 43, 44, 45)] for x in lines]
    near = grouped(len(texts), lambda i, j: any((p ^ q).bit_count() <= 5 for p, q in zip(prints[i], prints[j], strict=True)))
    return grouped(len(texts), lambda i, j: near[i] == near[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))


def groups_of(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in simhash.near_copies(docs, **kw).collect():
        got[r["__group"]].add(r["__id"])
    return sorted(map(sorted, got.values()))


def sets_of_roots(roots):
    want = defaultdict(set)
    for i, r in enumerate(roots):
        want[r].add(i)
    return sorted(map(sorted, want.values()))


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000, 1])
def test_near_copies_match_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    texts = [t for length, changes in ((300, 2), (200, 4), (120, 1), (60, 1)) for _ in range(3) for t in variants(rng, 6, length, changes)]
    texts += [None, "", " \n", "One", "one", "two words", texts[0].upper(), "long " * 20_000, "long " * 20_001]
    assert groups_of(spark, texts, block_bytes=block_bytes) == sets_of_roots(brute(texts))
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 100])
def test_one_rule_for_groups_of_any_size(spark, block_bytes):
    """A and C are near copies far apart in fingerprints; only B, which is no near copy of either, joins their candidates."""
    rng = np.random.default_rng(8)
    far = lambda a, b: (simhash.fingerprint(a.encode(), 2) ^ simhash.fingerprint(b.encode(), 2)).bit_count() > 5
    same = lambda a, b: grouped(2, lambda i, j: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)))[1] == 0
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    while True:
        a, c = variants(rng, 2, 110, 1)
        if not (same(a, c) and far(a, c)):
            continue
        for _ in range(300):
            words = [x if rng.random() < 0.5 else y for x, y in zip(a.split(), c.split(), strict=True)]
            for at in rng.integers(0, len(words), 5):
                words[at] = f"u{rng.integers(0, 99)}"
            b = " ".join(words)
            if not (same(a, b) or same(b, c) or far(a, b) or far(b, c)):
                assert groups_of(spark, [a, b, c], seeds=(42,), block_bytes=block_bytes) == [[0, 2], [1]]
                return


def test_recall_of_pairs_at_the_threshold():
    """Pairs at Jaccard 0.8 and above of which a family of fingerprints of two-word shingles comes within 5 bits."""
    rng = np.random.default_rng(4)
    near = seen = 0
    for _ in range(400):
        length = int(rng.integers(80, 500))
        a, b = variants(rng, 2, length, max(1, length // 130))
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            seen += 1
            near += any((simhash.fingerprint(a.encode(), 2, s) ^ simhash.fingerprint(b.encode(), 2, s)).bit_count() <= 5 for s in (42, 43, 44, 45))
    assert seen > 300 and near >= 0.9 * seen


def test_large_buckets_are_split_and_streamed(spark):
    """Prints that differ in three neighbouring bits share buckets; small limits force every level of splitting."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a in range(40) for b in range(a)} | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    from vigilframe.llm.components import components

    for hot in (4096, 30, 3):
        got = {r["node"]: r["root"] for r in components(simhash.near_links(df, 3, hot=hot)).collect()}
        root = {p: p for p in prints}

        def find(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for i, p in enumerate(prints):
            for q in prints[:i]:
                if (p ^ q).bit_count() <= 3:
                    a, b = sorted((find(p), find(q)))
                    root[b] = a
        assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_a_large_group_has_few_links_a_print(spark):
    """Buckets choose the same links where they can: a few for each print, not up to one for each of the 63 masks."""
    from vigilframe.llm.components import components

    rng = np.random.default_rng(6)
    base, prints = int(rng.integers(0, 1 << 62)), set()
    while len(prints) < 1000:
        p = base
        for bit in rng.integers(0, 62, rng.integers(1, 9)):
            p ^= 1 << int(bit)
        prints.add(p)
    prints = np.array(sorted(prints), dtype=np.uint64)
    links = simhash.near_links(spark.createDataFrame([(int(p),) for p in prints], "fp long"), 5)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links.collect()}
    assert len(got) < 6 * len(prints)
    assert all((a ^ b).bit_count() <= 5 for a, b in got)
    root = np.arange(len(prints))
    while True:  # the smallest index in reach, until nothing changes
        low = np.array([root[np.bitwise_count(prints ^ p) <= 5].min() for p in prints])
        if (low == root).all():
            break
        root = low
    node = {r["node"]: r["root"] for r in components(links).collect()}
    assert [node.get(int(p), int(p)) for p in prints] == [int(prints[i]) for i in root]


def test_least_forest_is_the_same_in_every_bucket():
    """A bucket's forest holds every link of the whole forest whose ends it has, and connects what pairs connect."""
    rng = np.random.default_rng(7)
    prints = np.unique(np.array([int(x) for x in rng.integers(0, 1 << 10, 300)], dtype=np.uint64) << np.uint64(54))
    whole = {frozenset(map(int, x)) for x in simhash.spanning_links(prints, 3)}
    assert len(whole) == len(prints) - 1
    for _ in range(5):
        some = prints[rng.random(len(prints)) < 0.3]
        ends = set(map(int, some))
        assert {x for x in whole if x <= ends} <= {frozenset(map(int, x)) for x in simhash.spanning_links(some, 3)}
    apart = np.array([0, 1, 1 << 20, (1 << 20) + 3, (1 << 40) - 1], dtype=np.uint64)
    assert {frozenset(map(int, x)) for x in simhash.spanning_links(apart, 2)} == {frozenset({0, 1}), frozenset({1 << 20, (1 << 20) + 3}), frozenset({0, 1 << 20})}
    assert simhash.spanning_links(apart[:1], 3) == []
