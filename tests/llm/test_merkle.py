"""Merkle manifests against a plain recursive tree, for many shapes of groups, partitions and rounds."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilframe.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """Counter-like list of (id, leaf, subroot, root, proof) for rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        own = sorted(((r[0] is not None, r[0] or 0, digest(r)), r[0]) for r in groups[g])
        trees[g] = (own, plain_levels([k[2] for k, _ in own]))
    top = plain_levels([trees[g][1][-1][0] for g in langs])
    out = []
    for i, g in enumerate(langs):
        own, levels = trees[g]
        for pos, (key, doc_id) in enumerate(own):
            proof = []
            for p, tree in ((pos, levels), (i, top)):
                for level in tree[:-1]:
                    if p ^ 1 < len(level):
                        proof.append(level[p ^ 1])
                    p >>= 1
            out.append((doc_id, key[2], levels[-1][0], top[-1][0], "".join(proof)))
    return sorted(out, key=str)


def made(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs, FIELDS, "lang", "doc_id", **kw)
    return m, sorted(((r["__id"], r["__leaf"], r["__subroot"], r["__root"], r["__proof"]) for r in m.proofs.collect()), key=str)


@pytest.mark.parametrize("rows_per_part", [3, 50, 100_000])
def test_proofs_match_a_plain_tree(spark, rows_per_part):
    rng = np.random.default_rng(rows_per_part)
    sizes = {"en": 133, "de": 64, None: 17, "fr": 1, "": 2, "é": 7, "z": 33}
    rows = []
    for g, n in sizes.items():
        rows += [(int(rng.integers(0, 500)) if rng.random() < 0.9 else None, None if rng.random() < 0.1 else "web", g, None if rng.random() < 0.2 else int(rng.integers(0, 99)), rng.choice([None, "", "a b", "ü" * 3000, f"t{rng.integers(5)}"])) for _ in range(n)]
    rows += rows[:3]
    rows = [tuple(None if v is None else v if isinstance(v, int) else str(v) for v in r) for r in rows]
    m, got = made(spark, rows, rows_per_part=rows_per_part)
    want = plain(rows)
    assert got == want
    assert [r["__root"] for r in m.root.collect()] == [want[0][3]]
    assert sorted((r["__group"] or "-", r["__leaves"]) for r in m.groups.collect()) == sorted((g or ("-" if g is None else ""), n) if g != "" else ("-", n) for g, n in ({**sizes, "en": 136}).items())


def test_rounds_of_few_levels(spark):
    """Steps of two levels force several rounds; the roots and all paths agree with one round."""
    leaves = [sha(str(i)) for i in range(77)]
    nodes = spark.createDataFrame([(t, 77 - t, 0, i, leaves[i]) for t in (0, 1, 76) for i in range(77 - t)], "tree long, leaves long, level int, pos long, digest string")
    for step in (1, 2, 3, 10):
        roots, paths = merkle.finish(nodes, step)
        assert {r["tree"]: r["root"] for r in roots.collect()} == {t: plain_levels(leaves[: 77 - t])[-1][0] for t in (0, 1, 76)}
        given = paths.filter("level = 0")  # the others lead from the nodes that rounds made
        for r in given.collect():
            assert merkle.fold_proof(leaves[r["pos"]].encode(), r["path"].encode(), [(r["pos"], 77 - r["tree"])]).decode() == plain_levels(leaves[: 77 - r["tree"]])[-1][0]
        assert given.count() == 77 + 76


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70), st.data())
def test_pieces_cover_a_tree(n, data):
    """However leaves are cut into pieces, their ragged nodes cover all leaves once and are nodes of the plain tree."""
    cuts = sorted(data.draw(st.sets(st.integers(0, n), max_size=6)) | {0, n})
    leaves = [sha(str(i)).encode() for i in range(n)]
    levels, covered = plain_levels([x.decode() for x in leaves]), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for level, pos, h in merkle.ragged(merkle.build_up(leaves[a:b], a, n)):
            assert levels[level][pos] == h.decode()
            covered += range(pos << level, min((pos + 1) << level, n))
    assert sorted(covered) == list(range(n))


def test_tampered_records_do_not_verify(spark):
    docs = spark.createDataFrame([(i, "s", f"l{i % 3}", i, f"text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({c: F.lit("own") for c in ("__id", "grp", "digest", "claim", "part", "tree", "a", "b")})
    claim = merkle.record_digest([F.col(c) if c != "text" else F.when(F.col("doc_id") % 2 == 0, "other").otherwise(F.col("text")) for c in FIELDS])
    out = merkle.folded(merkle.manifest(docs, FIELDS, "lang", "doc_id", claim).proofs).collect()
    assert len(out) == 40 and all((r["__folded"] == r["__root"]) == (r["__id"] % 2 == 1) for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs, FIELDS, "lang", "doc_id")
    assert merkle.folded(m.proofs).count() == m.root.count() == m.groups.count() == 0
