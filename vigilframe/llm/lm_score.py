"""Language-model scores by deleted interpolation: maximum-likelihood n-gram estimates mixed by context-frequency buckets.

The model mixes, from the uniform estimate 1 / (V + 1) up, the maximum-likelihood estimates of words, bigrams and trigrams:
P_k = w_k P_ml,k + (1 - w_k) P_(k-1). The weight w_k depends on how often the context was seen (buckets of powers of two);
weights are learned order by order by expectation-maximisation on the counts of a held-out tenth of the texts, deleted from
the counts they are mixed over.

How it runs: texts are tokenised once into blocks of a bounded number of tokens, which are written as a table of packed
arrays. Each block asks for the counts of its distinct n-grams: sorted hashes, cut by hash range into buckets. A bucket adds
up what all blocks know and answers each block in the order it asked, so an answer needs no keys. A frequent n-gram is one
entry per block, however often it occurs, so no key is hot. Ids stay in Arrow arrays throughout, never numbers of pandas.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bound_batches, discard, fold, materialize, pieces, raw_texts, shuffle_parts

END = np.uint64(0x5EED0E0D5EED0E0D)  # the token that ends every text, and the context of every first word
BINS, LOW, HIGH = 800, -12.0, 28.0  # of the logarithm of the higher over the lower estimate
CONTEXTS = 64


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack(blob: bytes, dtype, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, n * np.dtype(dtype).itemsize)), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


def _pack_sorted(a: np.ndarray, shift: int = 0) -> bytes:
    return _pack(np.diff(a >> np.uint64(shift), prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes, n: int, shift: int = 0) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64, n), dtype=np.uint64) << np.uint64(shift)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def chained(before: np.ndarray, now: np.ndarray, first: np.ndarray, start: np.uint64) -> np.ndarray:
    """A hash of each token `now` with the n-gram that ends one place earlier; `start` stands before each text's first token."""
    prior = np.empty_like(before)
    prior[1:] = before[:-1]
    prior[first] = start
    h = (prior * np.uint64(0x9E3779B97F4A7C15)) ^ (prior >> np.uint64(29))
    h = (h + now) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class _Block:
    lens: np.ndarray
    train: np.ndarray
    hashes: np.ndarray  # sorted distinct words
    tokens: np.ndarray  # places in `hashes`

    @property
    def first(self) -> np.ndarray:
        """Where each text begins."""
        return np.cumsum(self.lens) - self.lens


def tokenize_blocks(docs: DataFrame, id_col: str, text_col: str, trained, held, block_tokens: int) -> DataFrame:
    """Rows of packed blocks, numbered by task and place in it. Held-out texts have blocks of their own, so that learning weights reads those alone."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number = _Hashes(), TaskContext.get().partitionId() << 32

        def emit(ids, train, words, held_block):
            nonlocal number
            lens = np.array([len(w) for w in words], dtype=np.int64)
            flat = np.concatenate(words)
            hashes, tokens = np.unique(flat, return_inverse=True)
            ids = pa.concat_arrays(ids)
            number += 1
            row = {
                "block": pa.array([number]), "held": pa.array([held_block]), "n_tokens": pa.array([len(flat)]), "n_train": pa.array([int(lens[np.array(train)].sum())]), "n_words": pa.array([len(hashes)]),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lens": pa.array([lens.tobytes()]), "train": pa.array([np.array(train, dtype=bool).tobytes()]),
                "hashes": pa.array([_pack_sorted(hashes)]), "tokens": pa.array([_pack(tokens.astype(np.uint32))]),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        open_: dict[bool, tuple[list, list, list, int]] = {False: ([], [], [], 0), True: ([], [], [], 0)}
        for batch in batches:
            for part in pieces(batch, "__text"):
                rows = zip(part.column("__train").to_pylist(), part.column("__held").to_pylist(), raw_texts(part, "__text"), strict=True)
                for k, (is_train, is_held, raw) in enumerate(rows):
                    words = raw.translate(LOWER).split()
                    coded = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
                    ids, train, toks, n = open_[is_held]
                    ids.append(part.column("__id").slice(k, 1))
                    train.append(is_train)
                    toks.append(np.append(coded, END))
                    n += len(coded) + 1
                    open_[is_held] = (ids, train, toks, n)
                    if n >= block_tokens:
                        open_[is_held] = ([], [], [], 0)
                        yield emit(ids, train, toks, is_held)
                for k, (ids, *rest) in open_.items():  # slices hold their whole batch: copy the ids out
                    if ids:
                        open_[k] = ([pa.concat_arrays(ids)] if len(ids) > 1 else ids, *rest)
        for k, (ids, train, toks, n) in open_.items():
            if n:
                yield emit(ids, train, toks, k)

    schema = f"block bigint, held boolean, n_tokens bigint, n_train bigint, n_words bigint, ids array<{id_type}>, lens binary, train binary, hashes binary, tokens binary"
    no = F.lit(False)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(trained, no).alias("__train"), F.coalesce(held, no).alias("__held"))
    return rows.mapInArrow(run, schema)


def _open(row: dict) -> _Block:
    return _Block(np.frombuffer(row["lens"], dtype=np.int64), np.frombuffer(row["train"], dtype=bool), _unpack_sorted(row["hashes"], row["n_words"]), _unpack(row["tokens"], np.uint32, row["n_tokens"]))


def _asked(b: _Block, orders: int, shift: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(order, its shift, sorted distinct hashes, place of each token's hash). Hashes of words are whole; of longer n-grams the low `shift` bits are left out."""
    yield 1, 0, b.hashes, b.tokens
    now, first = b.hashes[b.tokens], b.first
    gram, start = now, END
    for order in range(2, orders + 1):
        gram = chained(gram, now, first, start)
        start = chained(np.array([start]), np.array([END]), np.array([0]), start)[0]
        known, place = np.unique(gram >> np.uint64(shift), return_inverse=True)
        yield order, shift, known << np.uint64(shift), place


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes begins in a sorted array."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64)) // buckets
    return np.append(np.searchsorted(hashes, edges[:-1].astype(np.uint64)), len(hashes))


def _requests(blocks: DataFrame, buckets: int, orders: int, shift: int) -> DataFrame:
    names = ["block", "held", "order", "bucket", "n", "hashes", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                b = _open(row)
                weight = np.repeat(b.train, b.lens)
                for order, low, hashes, place in _asked(b, orders, shift):
                    counts = np.bincount(place[weight], minlength=len(hashes))
                    cut = _cuts(hashes, buckets)
                    out = [(row["block"], row["held"], order, j, int(e - s), _pack_sorted(hashes[s:e], low), _pack(counts[s:e].astype(np.uint32))) for j, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if e > s]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=names)

    slim = blocks.select("block", "held", "n_tokens", "n_words", "lens", "train", "hashes", "tokens")
    return slim.mapInArrow(run, "block bigint, held boolean, order bigint, bucket bigint, n bigint, hashes binary, counts binary")


def _answers(requests: DataFrame, shift: int) -> DataFrame:
    """Counts over all blocks for each request, as in its order; and one row (block -1) per word bucket with its distinct words."""

    def answer(group: pa.Table) -> pa.Table:
        order, bucket = group.column("order")[0].as_py(), group.column("bucket")[0].as_py()
        n = group.column("n").to_pylist()
        low = shift if order > 1 else 0
        hashes = np.concatenate([_unpack_sorted(h, k, low) for h, k in zip(group.column("hashes").to_pylist(), n, strict=True)])
        mine = np.concatenate([_unpack(c, np.uint32, k) for c, k in zip(group.column("counts").to_pylist(), n, strict=True)])
        is_held = group.column("held").to_pylist()
        held = np.repeat(np.array(is_held, dtype=bool), n)
        known, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, weights=mine, minlength=len(known)).astype(np.int64)
        aside = np.bincount(place[held], weights=mine[held], minlength=len(known)).astype(np.int64)
        rows, ends = [], np.cumsum(n)
        for block, h, s, e in zip(group.column("block").to_pylist(), is_held, (ends - n).tolist(), ends.tolist(), strict=True):
            at = place[s:e]
            rows.append((block, order, bucket, e - s, _pack(total[at].astype(np.uint64)), _pack(aside[at].astype(np.uint64)) if h else b""))
        if order == 1:
            rows.append((-1, int((total > 0).sum()), bucket, int((total > aside).sum()), b"", b""))
        return pa.table([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["block", "order", "bucket", "n", "total", "aside"])

    return requests.groupBy("bucket", "order").applyInArrow(answer, "block bigint, order bigint, bucket bigint, n bigint, total binary, aside binary")


def _filled(answers: list[dict], order: int, column: str) -> np.ndarray:
    rows = sorted((r for r in answers if r["order"] == order), key=lambda r: r["bucket"])
    return np.concatenate([_unpack(r[column], np.uint64, r["n"]) for r in rows]).astype(np.int64)


def token_counts(b: _Block, orders: int, shift: int, counts) -> list[np.ndarray]:
    """For each order the count of the n-gram that ends at each token; counts(order): those of the distinct n-grams."""
    return [counts(order)[place] for order, _, _, place in _asked(b, orders, shift)]


def contexts(b: _Block, seen: list[np.ndarray], ends: int, total: int) -> list[np.ndarray]:
    """For each order the count of each token's context: all tokens, then the n-gram before it, `ends` before a text's first."""
    out = [np.full(len(b.tokens), total)]
    for c in seen[:-1]:
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[b.first] = ends
        out.append(before)
    return out


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole logarithm of its count to base 2."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0), CONTEXTS - 1)


def estimate(seen: list[np.ndarray], context: list[np.ndarray], v: int, weights: list[np.ndarray]) -> np.ndarray:
    """Probability of each token under the orders that have weights."""
    p = np.full(len(seen[0]), 1 / (v + 1))
    for c, h, w in zip(seen, context, weights, strict=False):
        take = w[context_bucket(h)]
        p = take * np.divide(c, h, out=np.zeros(len(c)), where=h > 0) + (1 - take) * p
    return p


def learn_weights(counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weight of the higher estimate by context bucket; counts: context bucket x bin of log ratio, last bin for a ratio of 0.

    Both components' posteriors depend on the ratio alone, so the counts say all that EM needs. An unseen context has
    weight 0; another bucket without held-out counts takes the weight of the nearest below that has some, 0.5 at first.
    """
    ratio = np.append(np.exp(LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS), 0.0)
    weights, last = np.zeros(CONTEXTS), 0.5
    for k in range(1, CONTEXTS):
        total = counts[k].sum()
        if total:
            w = 0.5
            for _ in range(rounds):
                w = float((counts[k] * (w * ratio / (w * ratio + 1 - w))).sum() / total)
                w = min(max(w, 1e-6), 1 - 1e-6)
            last = w
        weights[k] = last
    return weights


def ratio_cells(seen: list[np.ndarray], context: list[np.ndarray], v: int, weights: list[np.ndarray]) -> np.ndarray:
    """Context bucket * (BINS + 1) + bin of log ratio of each token, for the order that comes after those that have weights."""
    k = len(weights)
    c, h = seen[k], context[k]
    with np.errstate(divide="ignore"):
        log = np.log(np.divide(c, h, out=np.zeros(len(c)), where=h > 0)) - np.log(estimate(seen, context, v, weights))
    bin_ = np.where(c * (h > 0) > 0, np.clip((log - LOW) * BINS / (HIGH - LOW), 0, BINS - 1), BINS).astype(np.int64)
    return context_bucket(h) * (BINS + 1) + bin_


def lm_scores(docs: DataFrame, trained=None, held=None, id_col: str = "doc_id", text_col: str = "text", orders: int = 3, block_tokens: int = 1_000_000, bucket_hashes: int = 1_000_000, spare_bits: int = 18) -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score, score for every row and whole text.

    trained, held: boolean columns, null as false; by default the texts whose id's crc32 mod 10 is not 0 train, and those
    where it is 9 are the held-out part of training. Words are runs of characters outside [\\x20\\x09-\\x0D], A-Z
    lower-cased; every text ends with one end token, so null and blank texts have one token. base_score: sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))). score: log10 probability under the mixture. Without training texts every count is
    0 and both scores are uniform. Repeated rows are scored each, and count each; null ids stay null and ids of any type
    come back unchanged. Only id and text are read, so other columns' names do not matter. Very long texts are one text in
    one block. An empty table gives an empty result.

    Word counts are exact. Hashes of bigrams and trigrams have log2(tokens) + spare_bits bits, 64 at most, so that an
    n-gram's count includes another's with a chance of 2 ** -spare_bits. Rows of requests are blocks x buckets x orders.
    """
    trained = fold(id_col, 10) != 0 if trained is None else trained
    held = (fold(id_col, 10) == 9) if held is None else held
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(tokenize_blocks(docs, id_col, text_col, trained, held & trained, block_tokens))
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("held"), F.col("n_train"))), F.lit(0))).first()
    tokens, n_train, n_held = int(size[0]), int(size[1]), int(size[2])
    buckets = max(3 * shuffle_parts(docs.sparkSession), tokens // bucket_hashes)
    shift = max(0, 64 - max(tokens, 2).bit_length() - spare_bits)
    answers = materialize(_answers(_requests(blocks, buckets, orders, shift), shift))
    v = answers.filter("block = -1").agg(F.coalesce(F.sum("order"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v_all, v_main = int(v[0]), int(v[1])
    replies = answers.filter("block <> -1")

    def known(b: _Block, got: list[dict], deleted: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of each token's n-grams and contexts, with or without the held-out part."""
        each = {k: _filled(got, k, "total") - (_filled(got, k, "aside") if deleted else 0) for k in range(1, orders + 1)}
        seen = token_counts(b, orders, shift, each.__getitem__)
        ends = int(each[1][np.searchsorted(b.hashes, END)])
        return seen, contexts(b, seen, ends, n_train - n_held if deleted else n_train)

    def deleted_counts(block: pa.Table, got: pa.Table) -> pa.Table:
        """Counts and context counts of a held-out block's tokens, without the held-out part."""
        b = _open(block.select(["lens", "train", "hashes", "tokens", "n_words", "n_tokens"]).to_pylist()[0])
        seen, context = known(b, got.to_pylist(), True)
        return pa.table({"n": pa.array([len(seen[0])]), "counts": pa.array([_pack(np.concatenate([*seen, *context]).astype(np.int64))])})

    asked = blocks.filter("held")
    mine = replies.join(asked.select("block"), "block", "left_semi")
    cells = materialize(asked.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(deleted_counts, "n bigint, counts binary"))
    weights: list[np.ndarray] = []
    for _ in range(orders):

        def ratios(batches: Iterator[pa.RecordBatch], sofar=tuple(weights)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    at = _unpack(row["counts"], np.int64, row["n"] * 2 * orders).reshape(2 * orders, row["n"])
                    cell, n = np.unique(ratio_cells(list(at[:orders]), list(at[orders:]), v_main, list(sofar)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

        counts = np.zeros(CONTEXTS * (BINS + 1))
        for r in cells.mapInArrow(ratios, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]  # at most CONTEXTS * (BINS + 1) cells
        weights.append(learn_weights(counts.reshape(CONTEXTS, BINS + 1)))
    discard(cells)

    def score(block: pa.Table, got: pa.Table) -> pa.Table:
        b = _open(block.select(["lens", "train", "hashes", "tokens", "n_words", "n_tokens"]).to_pylist()[0])
        seen, context = known(b, got.to_pylist(), False)
        total = lambda x: np.add.reduceat(x, b.first)
        base = np.log10((seen[0] + 0.1) / (n_train + 0.1 * (v_all + 1)))
        cols = {
            id_col: block.column("ids").combine_chunks().flatten(), "trained": b.train, "n_tokens": b.lens, "n_known": total((seen[0] > 0).astype(np.int64)),
            "train_tokens": np.full(len(b.lens), n_train), "base_score": total(base), "score": total(np.log10(estimate(seen, context, v_all, weights))),
        }
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))

    schema = f"`{id_col}` {id_type}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)
