"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilframe.llm import components, decontaminate, exact_dedup, language_id, lm_score, mixing, pii, queries, sharding, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, size long, kept boolean, __x int"


def table(spark, rows):
    """documents with columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, True, 2) for r in rows], SCHEMA)


ODD = [
    (1, "the cat sat on the mat", "en", "a"),
    (2, "the cat  sat on\tthe mat ", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n", "fr", "b"),
    (None, "the cat sat on the mat", "en", "a"),
    (7, "le chat est là sur la table", "fr", "a"),
    (7, "le chat est là sur la table", "fr", "a"),
    (8, "x" * 50_000 + " " + "lang wort " * 5_000, "de", None),
    (9, "12345 !!!", "en", "c"),
]


def test_exact_dedup(spark):
    got = [tuple(r) for r in exact_dedup.exact_dedup(table(spark, ODD)).collect()]
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t, *_ in ODD:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        want.append((i, best[3], len(groups[norm]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    some = [tuple(r) for r in exact_dedup.exact_dedup(table(spark, ODD), hash_all=False).collect()]
    assert sorted(str(r[:4]) for r in some) == sorted(str(r[:4]) for r in want)
    assert {r[4] for r in some if r[2] > 1} == {r[4] for r in want if r[2] > 1}
    assert exact_dedup.exact_dedup(table(spark, []), hash_all=False).count() == 0


def test_exact_dedup_same_length_and_prefix(spark):
    rows = [(1, "a" * 300 + "b", "en", "s"), (2, "a" * 300 + "c", "en", "s"), (3, "a" * 300 + "b", "en", "s")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_edges():
    for t in ["", " \t", "One", "one TWO", "a b c", "a b c d", "É é A", "w " * 1000]:
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_simhash_groups(spark):
    rows = [(r[0], r[1], "en", "s") for r in ODD]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 12
    rows += [(100 + k, base + f"tail{k}", "en", "s") for k in range(12)]
    got = simhash.near_groups(table(spark, rows)).collect()
    prints = [brute_print(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], prints, brute_components([r[0] for r in rows], prints), strict=True))
    assert sorted(str((r["__id"], r["__fp"] % (1 << 64), r["__component"])) for r in got) == sorted(map(str, want))
    assert simhash.near_groups(table(spark, [])).count() == 0


def test_covering_masks_leave_out_any_three_bits():
    from itertools import combinations

    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in combinations(range(64), 3))
    rng = np.random.default_rng(2)
    for radius, least in ((3, 32), (5, 32), (7, 22)):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= least
        for _ in range(500):
            x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & x for m in masks)


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_links_connect_what_pairs_connect(spark, hot):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            prints.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash.near_links(df, 3, hot=hot)
    roots = {r["node"] % (1 << 64): r["root"] for r in components.components(links).collect()}
    want = brute_components(list(range(len(prints))), prints)
    mine = defaultdict(set)
    for p, c in zip(prints, want, strict=True):
        mine[c].add(roots.get(p, ("alone", p)))
    assert all(len(v) == 1 for v in mine.values())
    assert len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}


def brute_leaks(docs, items, threshold=0.8):
    out = set()
    for i, t in docs:
        words = decontaminate.words_of(t)
        for k, item in items:
            w = decontaminate.words_of(item)
            if not w or not words:
                continue
            span, width = min(len(w), len(words)), min(5, len(w))
            bag = Counter(tuple(w[j : j + width]) for j in range(len(w) - width + 1))
            best = 0.0
            for s in range(len(words) - span + 1):
                win = words[s : s + span]
                mine = Counter(tuple(win[j : j + width]) for j in range(max(1, len(win) - width + 1)))
                best = max(best, 2 * sum((bag & mine).values()) / (sum(bag.values()) + sum(mine.values())))
            if best >= threshold:
                out.add((i, k, round(best, 9)))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefg"), 3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 18, 45, 3, 30])] + [(9, None), (10, " ! ")]
    docs = []
    for i in range(40):
        body = [word() for _ in range(int(rng.integers(20, 120)))]
        if i % 3 == 0:
            own = items[int(rng.integers(0, 5))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = word()
            at = int(rng.integers(0, len(body)))
            body[at:at] = own
        docs.append((i, " ".join(body).upper() if i % 4 == 0 else ", ".join(body), "en", "s"))
    docs += [(90, None, "en", "s"), (91, "", "en", "s"), (None, items[0][1], "en", "s"), (92, items[1][1] + ".", "en", "s"), (92, items[1][1] + ".", "en", "s")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for block_bytes in (16 << 20, 150):
        got = decontaminate.find_contamination(table(spark, docs), bench, block_bytes=block_bytes).collect()
        assert sorted(map(str, {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got})) == sorted(map(str, brute_leaks([d[:2] for d in docs], items)))
    leaked = {d for d, *_ in brute_leaks([d[:2] for d in docs], items)}
    kept = [r["doc_id"] for r in decontaminate.drop_contaminated(table(spark, docs), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(d[0]) for d in docs if d[0] not in leaked)
    assert decontaminate.find_contamination(table(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(table(spark, docs), bench.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [15, 23])
def test_hamming_blocks_find_all_in_radius(radius):
    rng = np.random.default_rng(1)
    stored = [int(x) for x in rng.integers(0, 1 << 63, 50)]
    index = decontaminate.HammingBlocks(stored, radius)
    for q in [int(x) for x in rng.integers(0, 1 << 63, 50)] + stored:
        assert sorted(index.near(q)) == [i for i, s in enumerate(stored) if (s ^ q).bit_count() <= radius]


def test_language_id(spark, sf):
    got = queries.op1_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    right = held.filter(F.col("lang_pred") == F.col("lang")).count()
    assert right >= 0.9 * held.count() and got.count() == docs.count()
    model = language_id.train(["the cat and the dog are here", "le chat et le chien sont là"] * 20, ["en", "fr"] * 20)
    for r in language_id.identify(table(spark, ODD), model, ["doc_id", "text"]).collect():
        no_letter = not any(c.isalpha() for c in r["__row"]["text"] or "")
        assert (r["__lang"] == "und") == no_letter and 0 <= r["__score"] <= 1
    assert language_id.identify(table(spark, []), model, ["doc_id"]).count() == 0
    nothing = language_id.train_from(table(spark, []), F.lit(True))
    assert {r["__lang"] for r in language_id.identify(table(spark, ODD), nothing, ["doc_id"]).collect()} == {"und"}


def patterns(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_patterns():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(rng.choice(list("a1.@+ -()9.bé"), size=40))
        assert pii.base_spans(t) == patterns(t)
    for t in ["a@b@c.com", "4867410821218232", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (555) 123-4567", "1" * 5000, "a" * 5000 + "@x.y", "0000001.2.3.4"]:
        assert pii.base_spans(t) == patterns(t)


def test_pii_gradients():
    net = pii.BiLstmCrf(dim=3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, y = rng.integers(0, 99, (2, 6)), np.array([[0, 1, 2, 2, 0, 3], [0, 0, 5, 6, 0, 0]])
    _, g = net.loss_and_grads(ids, y)
    for k, p in net.p.items():
        i = (ids[0, 1], 0) if k == "emb" else (0, 1) if k == "trans" else tuple(0 for _ in p.shape)
        old = p[i]
        p[i] = old + 1e-4
        up = net.loss_and_grads(ids, y)[0]
        p[i] = old - 1e-4
        down = net.loss_and_grads(ids, y)[0]
        p[i] = old
        assert math.isclose((up - down) / 2e-4, g[k][i], rel_tol=1e-2, abs_tol=1e-4)


def test_pii_query(spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base, row = patterns(r["text"] or ""), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row["spans"].split(",") if x)]
        assert set(base) <= set(spans)
        for k, s, e in set(spans) - set(base):
            assert pii.plausible(k, r["text"][s:e])
    odd = pii.detect(table(spark, ODD), None).collect()
    assert len(odd) == len(ODD) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in odd)
    assert pii.detect(table(spark, []), None).count() == 0


def test_lm_scores_match_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["a", "B", "c", "d", "e", "f"], int(rng.integers(0, 30)))), "en", "s") for i in range(120)] + [(200, None, "en", "s"), (None, "a b zz", "en", "s"), (5, "a b", "en", "s")]
    got = lm_score.lm_scores(table(spark, docs), block_tokens=100, bucket_hashes=7, spare_bits=40).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    toks = [(i, [None, None, *re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]) for i, t, *_ in docs]
    grams = {part: [Counter(), Counter(), Counter()] for part in (0, 1)}
    for i, w in toks:
        if fold(i):
            for part in (0,) if fold(i) == 9 else (0, 1):
                for j in range(2, len(w)):
                    for k in range(3):
                        grams[part][k][tuple(w[j - k : j + 1])] += 1

    def terms(w, part):
        """For each token the (count, context count) of its word, bigram and trigram."""
        uni, big, tri = grams[part]
        n = sum(uni.values())
        for j in range(2, len(w)):
            ends = uni[(None,)]
            yield (uni[w[j],], n), (big[tuple(w[j - 1 : j + 1])], ends if j == 2 else uni[w[j - 1],]), (tri[tuple(w[j - 2 : j + 1])], ends if j == 2 else big[tuple(w[j - 2 : j])])

    def bucket(c):
        return int(math.log2(c)) + 1 if c else 0

    def mixed(t, part, weights):
        p = 1 / (len(grams[part][0]) + 1)
        for (c, h), w in zip(t, weights, strict=False):
            p = w[bucket(h)] * (c / h if h else 0) + (1 - w[bucket(h)]) * p
        return p

    weights = []
    for k in range(3):
        counts = np.zeros((lm_score.CONTEXTS, lm_score.BINS + 1))
        for i, w in toks:
            if fold(i) == 9:
                for t in terms(w, 1):
                    c, h = t[k]
                    place = int(np.clip((math.log(c / h / mixed(t, 1, weights)) - lm_score.LOW) * lm_score.BINS / (lm_score.HIGH - lm_score.LOW), 0, lm_score.BINS - 1)) if c and h else lm_score.BINS
                    counts[bucket(h), place] += 1
        weights.append(lm_score.learn_weights(counts))
    want = []
    n, v = sum(grams[0][0].values()), len(grams[0][0])
    for i, w in toks:
        t = list(terms(w, 0))
        want.append((str(i), len(t), sum(x[0][0] > 0 for x in t), n, round(sum(math.log10((x[0][0] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6), round(sum(math.log10(mixed(x, 0, weights)) for x in t), 6)))
    mine = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(mine) == sorted(want)
    assert lm_score.lm_scores(table(spark, [])).count() == 0
    assert {round(r["score"], 9) for r in lm_score.lm_scores(table(spark, [(1, "a", "en", "s")]), F.lit(False), F.lit(False)).collect()} == {0.0}


def test_lm_probabilities_sum_to_one(spark):
    """The mixture is a distribution over the vocabulary and one unknown word, whatever the context."""
    w = [np.full(lm_score.CONTEXTS, x) for x in (0.9, 0.6, 0.7)]
    for x in w:
        x[0] = 0
    seen = [np.array([5, 3, 2, 0]), np.array([2, 1, 0, 0]), np.array([1, 0, 0, 0])]  # words a, b, c, unknown after one history
    context = [np.full(4, 10), np.full(4, 3), np.full(4, 1)]
    assert lm_score.estimate(seen, context, 3, w).sum() == pytest.approx(1)
    assert lm_score.estimate(seen[:2], [context[0], np.zeros(4, dtype=int)], 3, w[:2]).sum() == pytest.approx(1)


def test_lm_keeps_ids_and_repeated_rows(spark):
    big = (1 << 60) + 1
    docs = table(spark, [(big, "a b c", "en", "s"), (None, "a b", "en", "s"), (3, "c", "en", "s")])
    got = lm_score.lm_scores(docs.unionAll(docs)).collect()
    assert Counter(r["doc_id"] for r in got) == {big: 2, None: 2, 3: 2}
    assert len({(r["doc_id"], r["n_tokens"], r["train_tokens"], round(r["score"], 9)) for r in got}) == 3
    words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert sorted(str(r["doc_id"]) for r in lm_score.lm_scores(words).collect()) == sorted(["3", str(big), "None"])


def test_lm_held_out_gain(spark, sf):
    r = queries.op6_lm_score(spark, sf).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_toxicity(spark, sf):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 2))
    texts, y = [], []
    for i in range(600):
        w = [word() for _ in range(int(rng.integers(3, 60)))]
        if i % 3 == 0:
            w.insert(int(rng.integers(0, len(w))), ["nasty", "vile", "rotten"][i % 9 // 3])
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    model = toxicity.train(texts, y)
    fresh = " ".join(word() for _ in range(50))
    s = model.score([fresh, fresh + " vile", "", "nasty", "unheard words alone"])
    assert (s >= 0.7).tolist() == [False, True, False, True, False]
    out = toxicity.score_documents(table(spark, ODD), model, ["doc_id"]).collect()
    assert len(out) == len(ODD) and all(0 <= r["__toxicity"] <= 1 for r in out)
    assert toxicity.score_documents(table(spark, []), model, ["doc_id"]).count() == 0
    nothing = toxicity.train_from(table(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert all(s < 0.7 for s in nothing.score(["", "any text"]))
    got = queries.op7_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_token_counts_equal_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["hello <|endoftext|>world<|startoftext|>  I'm it's ΣΑΣ İ", "\x1c a\x85b c　 ", "é 日本語 123 ½ ² 👍🏽 'LL", "<|EndOfText|> <|endoftext|", "a" * 3000, "é ﬁ Å ẞ", "\x00\x01", "ſ 'S", None, ""]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a b", "en", "s")]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048), t
    assert token_counts.count_tokens(table(spark, [])).count() == 0


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    t = mixing.water_fill([1000, 10, 10], [1, 2, 3])
    assert t == pytest.approx([960, 30, 30])
    assert mixing.water_fill([0, 50], [1, 2]) == pytest.approx([0, 50])
    assert mixing.water_fill([], []) == []


def test_splitting_tree_is_exact():
    blocks = np.array([5, 0, 17, 100])
    tree = mixing.splitting_tree(blocks, 8, 1)
    assert (tree.sum(axis=1) == blocks).all() and tree.sum(axis=0).max() - tree.sum(axis=0).min() <= 1
    assert (tree == mixing.splitting_tree(blocks, 8, 1)).all()


@pytest.mark.parametrize("block_rows", [4096, 10])
def test_mixing(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", str(rng.choice(["a", "b", "B", "c", "d"], p=[0.6, 0.2, 0.1, 0.05, 0.05]))) for i in range(400)]
    rows += [(500, None, "en", None), (501, "one two", "en", None), (None, "x y z", "en", "a"), (7, "rep rep", "en", "c"), (7, "rep rep", "en", "c")]
    mix = mixing.mix_sources(table(spark, rows), shards=4, seed=3, block_rows=block_rows)
    got = [(r["__id"], r["__size"], r["__words"], r["__target"], len(r["__dealt"])) for r in mix.rows.collect()]
    assert len(got) == len(rows)
    words = Counter()
    for _, t, _, s in rows:
        words[s] += len((t or "").split())
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, mixing.water_fill([words[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    assert sorted((n, round(t, 6)) for _, n, w, t, _ in got for n in [w]) == sorted((words[s], round(target[s], 6)) for *_, s in rows)
    assert all(0 <= copies <= 3 for *_, copies in got)
    assert Counter(str(g[:2]) for g in got) == Counter(str((i, len((t or "").split()))) for i, t, *_ in rows)
    drawn = mixing.draw(mix).collect()
    taken = Counter()
    for r in drawn:
        taken[r["__row"]["source"]] += len((r["__row"]["text"] or "").split())
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s])
    again = mixing.mix_sources(table(spark, rows[::-1]).repartition(3), shards=4, seed=3, block_rows=block_rows)
    assert sorted(str((r["__id"], r["__dealt"])) for r in again.rows.collect()) == sorted(str((r["__id"], r["__dealt"])) for r in mix.rows.collect())
    assert len(drawn) == sum(g[4] for g in got) and {r["__shard"] for r in drawn} <= set(range(4))
    empty = mixing.mix_sources(table(spark, []))
    assert empty.rows.count() == 0 and mixing.draw(empty).count() == 0


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 8, 1000, 1025):
        at = sharding.permute(np.arange(n), n, 7)
        assert sorted(at.tolist()) == list(range(n))
        assert (sharding.permute(at, n, 7, inverse=True) == np.arange(n)).all()
        shard, slot = sharding.locate(np.arange(n), n, 8, 7)
        assert (sharding.row_at(shard, slot, n, 8, 7) == np.arange(n)).all()


def test_sharding(spark):
    rows = ODD + [(i, f"text {i}", "en", "s") for i in range(50, 150)]
    got = sharding.shard_documents(table(spark, rows), seed=1).collect()
    counts = Counter(r["__shard"] for r in got)
    assert len(got) == len(rows) and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["__slot"] for r in got if r["__shard"] == s) == list(range(counts[s]))
    for r in got:
        text = r["__row"]["text"] or ""
        assert r["__size"] == len(text.encode()) + 1 and r["__crc"] == zlib.crc32(text.encode())
    again = sharding.shard_documents(table(spark, rows[::-1]).repartition(5), seed=1).collect()
    key = lambda r: str((r["__row"]["doc_id"], r["__row"]["text"], r["__shard"], r["__slot"]))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sharding.shard_documents(table(spark, [])).count() == 0
