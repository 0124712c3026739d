"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds by language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id
from .common import bound_batches, packed, pieces

WORDS = re.compile(r"\w+").findall


#: Lengths of the word beginnings that stand in for words not met in training, tried in this order.
STEMS = (5, 4)


class _Buckets(dict):
    """Bucket of a word: its own where training met it often enough, else that of its known beginning, else 0."""

    def __init__(self, known: dict[str, int], most: int = 200_000):
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, word: str) -> int:
        found = self.known.get(word) or next((b for n in STEMS if (b := self.known.get("^" + word[:n]))), 0)
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


@dataclass
class ToxicityModel:
    """known: bucket of each word met in training often enough and, after a ^, of each beginning; all others share bucket 0."""

    known: dict[str, int]
    emb: np.ndarray
    filters: list[np.ndarray]  # one (width, dim, n) array per width
    shift: np.ndarray
    out: np.ndarray
    bias: float
    language: language_id.LanguageModel | None = None
    slope: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)  # logit at which the decision flips, "" for any other language
    cut: float = 0.7

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_look"}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words, and where each text starts. Texts are kept apart by as many blanks as the widest filter."""
        look, gap = self.__dict__.setdefault("_look", _Buckets(self.known)), [0] * len(self.filters)
        flat: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(flat))
            flat += [look[w] for w in WORDS(t.lower())]
            flat += gap
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)

    def ends(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Behind the last window of each text."""
        return np.append(starts[1:], len(ids)) - len(self.filters) + 1

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max over each text of every filter's activation, and the activations. Windows begin at a word or the blank after the last, so none reaches the next text."""
        x = self.emb[np.append(ids, 0)]
        tops, acts = [], []
        bounds = np.stack([starts, self.ends(ids, starts)], axis=1).ravel()
        for f in self.filters:
            n = len(x) - len(f) + 1
            a = x[:n] @ f[0]
            for j in range(1, len(f)):
                a += x[j : n + j] @ f[j]
            acts.append(a)
            tops.append(np.maximum.reduceat(a, bounds, axis=0)[::2])
        return np.concatenate(tops, axis=1), acts

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        top, _ = self.pooled(*self.ids(texts))
        return np.maximum(top + self.shift, 0) @ self.out + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated scores: `cut` exactly where the logit is the threshold of the text's predicted language."""
        z = self.logits(texts)
        if self.language and self.language.languages:
            best, _, _ = self.language.predict(texts)
            names = [*self.language.languages, ""]
            at = np.array([self.thresholds.get(names[b], self.thresholds.get("", 0.0)) for b in best])
        else:
            at = np.full(len(texts), self.thresholds.get("", 0.0))
        v = np.clip(self.slope * (z - at) + np.log(self.cut / (1 - self.cut)), -30, 30)
        return 1 / (1 + np.exp(-v))


def _best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, floor: float) -> float:
    """The middle of the range of cuts whose weighted F1 is within 2 % of the best, but no less than the logit of even odds.

    Labels that no word explains would otherwise pull the cut down to where clean texts lie.
    """
    order = np.argsort(-z)
    z, y, weight = z[order], y[order], weight[order]
    hit, said = np.cumsum(y * weight), np.cumsum(weight)
    f1 = 2 * hit / (said + (y * weight).sum())
    good = z[f1 >= 0.98 * f1.max()]
    return max(floor, float(good.max() + good.min()) / 2)


def calibrate(model: ToxicityModel, lang: np.ndarray, z: np.ndarray, gold: np.ndarray, weight: np.ndarray, floor: float, least_positives: int = 20) -> None:
    """Sets the thresholds, one for each language with least_positives positives, and the slope from scored labelled texts.

    lang: place in the language model's list, -1 for none. weight: how many texts a row stands for.
    """
    hits = (gold * weight).sum()
    model.thresholds = {"": _best_threshold(z, gold, weight, floor) if hits else 0.0}
    if model.language:
        for k, name in enumerate(model.language.languages):
            own = lang == k
            if (gold[own] * weight[own]).sum() >= least_positives:
                model.thresholds[name] = _best_threshold(z[own], gold[own], weight[own], floor)
    if len(z):
        lean = z - model.thresholds[""]
        grid = np.geomspace(0.1, 10, 40)
        base = np.log(model.cut / (1 - model.cut))
        loss = [(weight * np.logaddexp(0, -(2 * gold - 1) * (s * lean + base))).sum() for s in grid]
        model.slope = float(grid[int(np.argmin(loss))])


def train(
    texts: list[str], toxic: list[int], language: language_id.LanguageModel | None = None, buckets: int = 1 << 18, dim: int = 16, widths: tuple[int, ...] = (1, 2, 3),
    n_filters: int = 8, least_steps: int = 700, rate: float = 0.01, least_texts: int = 3, hold_out: bool = True, seed: int = 0,
) -> ToxicityModel:
    """Adam on the logistic loss, as many epochs as least_steps takes; with hold_out, a fifth of the texts sets slope and thresholds.

    Words in fewer than least_texts training texts are known by their beginning only, like unseen ones, so that unseen
    endings of a telling word still tell; words with an unknown beginning share one bucket, so that the endless tail of
    rare words cannot collide with a telling one. In training a part of the words is replaced by their beginnings.
    """
    rng = np.random.default_rng(seed)
    seen: Counter[str] = Counter()
    for t in texts:
        words = set(WORDS(t.lower()))
        seen.update(words | {"^" + w[:n] for w in words for n in STEMS})
    known = {w: 1 + crc32(w.encode()) % (buckets - 1) for w, n in seen.items() if n >= least_texts}
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    emb[0] = 0
    model = ToxicityModel(known, emb, [rng.normal(0, 0.3, (w, dim, n_filters)).astype(np.float32) for w in widths], np.zeros(n_filters * len(widths), np.float32), rng.normal(0, 0.3, n_filters * len(widths)).astype(np.float32), -1.0, language)
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.thresholds = {"": 0.0 if len(y) and y.max() else 8.0}
        return model
    order = rng.permutation(len(texts))
    cut = len(texts) // 5 if hold_out else 0
    aside, fit = order[:cut], order[cut:]
    params = [model.emb, *model.filters, model.shift, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size, spans = 0, 32, np.cumsum([0] + [n_filters] * len(widths))
    coded = {i: model.ids([texts[i]])[0] for i in fit}
    stems = [np.zeros(buckets, dtype=np.int64) for _ in STEMS]
    for w, b in sorted(known.items()):  # in one order whatever the process hashes strings to, for buckets are shared
        if not w.startswith("^"):
            for to, n in zip(stems, STEMS, strict=True):
                to[b] = known.get("^" + w[:n], b)
    # short cuts of clean texts, empty ones too, so that having few words is no sign of anything
    for k, i in enumerate(i for i in fit[y[fit] == 0][::4]):
        words = WORDS(texts[i].lower())
        at, n = int(rng.integers(0, len(words) + 1)), int(rng.integers(0, 9))
        coded[len(texts) + k] = model.ids([" ".join(words[at : at + n])])[0]
    truth = np.append(y, np.zeros(len(coded)))
    fit = np.array(list(coded))
    for _ in range(-(-least_steps * size // len(fit))):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), size):
            pick = fit[at : at + size]
            parts = []
            for i in pick:
                ids, chance = coded[i], rng.random(len(coded[i]))
                ids = np.where((chance < 0.15) & (stems[0][ids] > 0), stems[0][ids], ids)
                parts.append(np.where((chance > 0.85) & (stems[1][ids] > 0), stems[1][ids], ids))
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            ids = np.concatenate(parts)
            top, acts = model.pooled(ids, starts)
            live = np.maximum(top + model.shift, 0)
            p = 1 / (1 + np.exp(-np.clip(live @ model.out + model.bias, -30, 30)))
            g = ((p - truth[pick]) / len(pick)).astype(np.float32)
            d_live = np.outer(g, model.out) * (live > 0)
            grads = [None, *[np.zeros_like(f) for f in model.filters], d_live.sum(axis=0), live.T @ g]
            rows, deltas = [], []
            ends = model.ends(ids, starts).tolist()
            for k, f in enumerate(model.filters):
                dk = d_live[:, spans[k] : spans[k + 1]]
                for d, (s, e) in enumerate(zip(starts.tolist(), ends, strict=True)):
                    if not dk[d].any():
                        continue
                    where = acts[k][s:e].argmax(axis=0) + s
                    for j in range(len(f)):
                        x = ids[where + j]
                        grads[1 + k][j] += model.emb[x].T * dk[d]
                        rows.append(x)
                        deltas.append((f[j] * dk[d]).T)
            step += 1
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in range(1, len(params)):
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                params[k] -= scale * first[k] / (np.sqrt(second[k]) + 1e-8)
            model.bias -= rate * float(g.sum())
            if rows:  # only the rows that a maximum touched move
                u, inv = np.unique(np.concatenate(rows), return_inverse=True)
                ge = np.zeros((len(u), dim), np.float32)
                np.add.at(ge, inv, np.concatenate(deltas))
                second[0][u] += ge**2
                move = u > 0
                model.emb[u[move]] -= 0.1 * ge[move] / (np.sqrt(second[0][u[move]]) + 1e-6)
    if len(aside):
        some = [[texts[i] for i in aside[k : k + 64]] for k in range(0, len(aside), 64)]
        z = np.concatenate([model.logits(t) for t in some])
        lang = np.concatenate([language.predict(t)[0] for t in some]) if language and language.languages else np.full(len(z), -1)
        calibrate(model, lang, z, y[aside], np.ones(len(z)), 0.0)
    return model


BIN = 0.02  # width of the bins of logits that calibration counts


def train_from(
    docs: DataFrame, labels: DataFrame, usable, most_rows: int = 2000, most_bytes: int = 64 << 20, language: language_id.LanguageModel | None = None,
    id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", seed: int = 0,
) -> ToxicityModel:
    """A model whose weights are fit on a bounded sample of whole texts and whose thresholds follow from all other usable labels.

    A fifth of the labelled ids, by a hash, calibrates; of the rest at most most_rows positive and most_rows negative ids
    are fit, chosen by another hash, of these in its order each whole text that still fits into most_bytes in all. Labels
    whose texts all are larger are an error. The ids chosen go to all tasks, so the documents are scanned
    but not shuffled. Every document of the fifth is scored whole where it lies; only counts by language, logit bin and
    label reach the driver. Of several labels of one id the largest counts, of several texts of one id the least is fit.
    """
    spark = docs.sparkSession
    id_type = labels.schema[id_col].dataType.simpleString()
    known = labels.filter(usable & F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__i")).agg(F.max(toxic_col).alias("__y"))
    part = F.pmod(F.xxhash64("__i", F.lit(seed + 1)), F.lit(5))
    ids, seen = [], {}
    for y in (1, 0):
        rows = known.filter((F.col("__y") == y) & (part > 0))
        seen[y] = rows.count()
        ids += rows.orderBy(F.xxhash64("__i", F.lit(seed)), "__i").limit(most_rows).collect()
    chosen = F.broadcast(spark.createDataFrame([(r[0], int(r["__y"])) for r in ids], f"__i {id_type}, __y int"))
    texts = docs.select(F.col(id_col).alias("__i"), F.coalesce(text_col, F.lit("")).alias("__t")).join(chosen, "__i")
    one = texts.groupBy("__i", "__y").agg(F.min("__t").alias("__t"))
    room = one.select("__i", F.octet_length("__t").alias("n")).orderBy(F.xxhash64("__i", F.lit(seed)), "__y", "__i").collect()
    fit, total = [], 0
    for r in room:  # 2 * most_rows at most; a text that no longer fits is passed over, those behind it are not
        if total + r["n"] <= most_bytes:
            total += r["n"]
            fit.append((r["__i"],))
    if room and not fit:
        raise ValueError(f"no labelled text fits into {most_bytes} bytes")
    got = one.join(F.broadcast(spark.createDataFrame(fit, f"__i {id_type}")), "__i", "left_semi").collect() if fit else []
    got = sorted((r["__t"], r["__y"]) for r in got)
    model = train([t for t, _ in got], [y for _, y in got], language, hold_out=False, seed=seed)
    if len({y for _, y in got}) < 2:
        return model
    # negatives that each negative of the sample stands for: what even odds are in the sample's own odds
    stands = max(1.0, seen[0] / max(1, min(seen[0], most_rows))) / max(1.0, seen[1] / max(1, min(seen[1], most_rows)))
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for piece in pieces(batch, "__t", 1 << 20):
                words = piece.column("__t").to_pylist()
                lang = m.language.predict(words)[0] if m.language and m.language.languages else np.full(len(words), -1)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(np.floor(m.logits(words) / BIN).astype(np.int64)), piece.column("__y").cast(pa.int32())], names=["lang", "bin", "y"])

    aside = docs.select(F.col(id_col).alias("__i"), F.coalesce(text_col, F.lit("")).alias("__t")).filter(part == 0).join(known.filter(part == 0), "__i").select("__t", "__y")
    cells = aside.mapInArrow(score, "lang int, bin bigint, y int").groupBy("lang", "bin", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if cells:
        lang, bin_, y, n = (np.array(x, dtype=np.float64) for x in zip(*cells, strict=True))
        calibrate(model, lang, (bin_ + 0.5) * BIN, y, n, float(np.log(stands)))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, columns: list[str], text_col: str = "text", keep_below: float | None = None) -> DataFrame:
    """__row, a struct of the given columns, and __toxicity for every row and whole text; nothing is shuffled.

    Null text counts as empty and gets the score of a text without words. Repeated rows are scored each, alike; a score
    equal to the cut counts as toxic. Very long texts are pooled whole. The caller's columns are in a struct, so their
    names cannot clash. An empty table gives an empty result. keep_below: only rows that score less.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs, columns), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in pieces(batch, "__text", 1 << 20):
                score = m.score([t or "" for t in part.column("__text").to_pylist()])
                out = pa.RecordBatch.from_arrays([part.column("__row"), pa.array(score.astype(np.float64))], names=["__row", "__toxicity"])
                yield out if keep_below is None else out.filter(pa.array(score < keep_below))

    return rows.mapInArrow(run, rows.select("__row").schema.add("__toxicity", "double"))
