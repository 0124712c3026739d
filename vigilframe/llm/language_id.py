"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, packed, pieces

UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str], buckets: int, orders: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of each character n-gram inside words and their edges, one array per order; text starts, with the blanks before; letters per text.

    Anything but a letter is an edge. n-grams that cross an edge are in bucket 0, which has no weight.
    """
    low = [t.lower() for t in texts]
    pad = " " * max(orders)
    codes = np.frombuffer((pad + pad.join(low) + pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(low), dtype=np.int64)
    np.cumsum([len(t) + len(pad) for t in low[:-1]], out=starts[1:])
    letter = _letters()[codes]
    unit = np.where(letter, codes, np.uint32(32))
    n_letters = np.add.reduceat(letter.astype(np.int64), starts)
    out, n = [], len(codes)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for order in orders:
        h = unit[: n - order + 1].copy()
        for j in range(1, order):
            h = h * np.uint32(0x01000193) + unit[j : n - order + 1 + j]
        h = ((h ^ np.uint32(order)) * np.uint32(2654435761)) >> shift
        np.maximum(h, 1, out=h)
        inside = letter[: n - order + 1] | letter[order - 1 :]
        for j in range(1, order - 1):
            inside = inside & letter[j : n - order + 1 + j]
        out.append(np.where(inside, h, 0))
    return out, starts, n_letters


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embeddings times output weights, all that a prediction needs
    bias: np.ndarray
    orders: tuple[int, ...]
    temperature: float = 1.0
    reject_below: float = 0.0
    held_accuracy: float = field(default=0.0)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits of each text (mean over its n-grams), and its number of letters."""
        grams, starts, letters = subwords(texts, len(self.table), self.orders)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for g in grams:
            at = np.minimum(starts, len(g) - 1)
            for k in range(len(self.languages)):
                total[:, k] += np.add.reduceat(self.table[:, k][g], at)
            count += np.add.reduceat((g > 0).astype(np.float32), at)
        return total / np.maximum(count, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1 without a letter), its calibrated probability, and whether that is too low to trust."""
        z, letters = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(texts)), best]
        best[letters == 0] = -1
        score[letters == 0] = 0.0
        return best, score, score < self.reject_below


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 16, dim: int = 16, orders: tuple[int, ...] = (2, 3, 4), least_steps: int = 16_000, rate: float = 0.5, target_accuracy: float = 0.99, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent, one text a step, as many epochs as least_steps takes; a fifth of the texts calibrates temperature and rejection.

    The rejection threshold is the lowest at which the accepted calibration texts reach target_accuracy.
    """
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in langs])
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    emb[0] = 0
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(texts))
    aside = order[: len(texts) // 5] if len(texts) >= 50 else order[:0]
    fit = np.setdiff1d(order, aside)
    bags = {}
    for i in fit:
        grams, _, _ = subwords([texts[i]], buckets, orders)
        ids, n = np.unique(np.concatenate(grams), return_counts=True)
        n = n[ids > 0].astype(np.float32)
        ids = ids[ids > 0]
        if len(ids):
            bags[i] = (ids, n / n.sum())
    epochs = -(-least_steps // max(1, len(bags)))
    steps, t = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(list(bags)):
            ids, share = bags[i]
            lr = rate * (1 - t / steps)
            t += 1
            x = share @ emb[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            emb[ids] -= (lr * 20) * share[:, None] * back[None, :]
    model = LanguageModel(languages, (emb @ out).astype(np.float32), bias.astype(np.float64), orders)
    if len(aside):
        z, letters = model.logits([texts[i] for i in aside])
        z, gold = z[letters > 0], y[aside][letters > 0]
        if len(gold):
            grid = np.geomspace(0.05, 20, 60)
            loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in grid]
            model.temperature = float(grid[int(np.argmin(loss))])
            p = _softmax(z / model.temperature)
            right, top = p.argmax(axis=1) == gold, p.max(axis=1)
            model.held_accuracy = float(right.mean())
            by = np.argsort(-top)
            good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= target_accuracy)
            model.reject_below = float(top[by][good[-1]]) if len(good) else 1.0
    return model


def sample_rows(docs: DataFrame, usable, per_language: int, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most_chars: int = 3000) -> list[tuple[str, str]]:
    """About per_language (text, language) pairs of each language for training, twice as many in all at most.

    Rows are drawn by a hash of id and text. Of a text longer than most_chars that many characters are taken, from a place
    that the hash sets. One pass counts the languages, one takes each language's share, so the driver gets a bounded sample
    whatever the size, repeated rows included.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    hashed = F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(11))
    draw = F.pmod(hashed, F.lit(1_000_000)) / 1e6
    start = 1 + F.pmod(F.shiftrightunsigned(hashed, 20), F.greatest(F.length(text_col) - most_chars + 1, F.lit(1)))
    drawn = rows.filter(draw < share[F.col(lang_col)]).select(hashed.alias("h"), F.substring(F.col(text_col), start.cast("int"), F.lit(most_chars)).alias("t"), F.col(lang_col).alias("l"))
    got = drawn.orderBy("h").limit(2 * per_language * len(counts)).collect()
    return sorted((r["t"], r["l"]) for r in got)


def train_from(docs: DataFrame, usable, per_language: int = 1500, seed: int = 0, **names) -> LanguageModel:
    """A model from a bounded sample of the rows where `usable` holds and the language is known."""
    sample = sample_rows(docs, usable, per_language, **names)
    return train([t for t, _ in sample], [x for _, x in sample], seed=seed)


def identify(docs: DataFrame, model: LanguageModel, columns: list[str], text_col: str = "text") -> DataFrame:
    """__row, a struct of the given columns, with __lang, __score and __rejected for every row and whole text; nothing is shuffled.

    `und` with score 0 where the text is null, empty or has no letter, or no language was learned. __rejected marks
    scores below the calibrated threshold. Of languages with equal probability the first in order wins. Very long texts
    are read whole; repeated rows are answered each, alike. The caller's columns are in a struct, so their names cannot
    clash. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs, columns), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in pieces(batch, "__text", 1 << 20):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                if m.languages:
                    best, score, low = m.predict(texts)
                else:
                    best, score, low = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(names[best]), pa.array(score.astype(np.float64)), pa.array(low)], names=["__row", "__lang", "__score", "__rejected"])

    return rows.mapInArrow(run, rows.select("__row").schema.add("__lang", "string").add("__score", "double").add("__rejected", "boolean"))
