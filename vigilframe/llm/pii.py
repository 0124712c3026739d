"""Personal data: fixed patterns as a base, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind and possessive runs only keep long digit runs linear; they change no match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_TRIGGER = re.compile(r"[0-9@]|[\[({<]at[\])}>]").finditer
_ANY = re.compile(r"[0-9@]").search


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans by kind, leftmost and non-overlapping inside each kind; offsets are code points."""
    out: list[Span] = []
    if not _ANY(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def plausible(kind: str, piece: str) -> bool:
    """Whether a span that the network adds can be of that kind at all: number of digits, checksum, range, a host name."""
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and bool(re.search(r"[ ().+-]", piece)) and not re.search(r"[^0-9 ().+-]", piece)
    if kind == "ip":
        parts = re.split(r"\[?\.\]?|\(\.\)", piece)
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    plain = re.sub(r"\s*[\[({<](at|dot)[\])}>]\s*", lambda m: "@" if m[1] == "at" else ".", piece)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain))


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII has a number each; other blanks, letters and the rest share one each; 0 is padding."""
    return np.fromiter((ord(c) - 31 if " " <= c <= "~" else 96 if c.isspace() else 97 if c.isalpha() else 98 for c in text), dtype=np.int64, count=len(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def allowed() -> np.ndarray:
    """Transitions that may occur: inside a kind only after its begin or inside."""
    ok = np.ones((LABELS, LABELS), dtype=bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Embedding, one LSTM each way, linear emissions, and a CRF over the labels. All windows of a batch are equally long."""

    def __init__(self, dim: int = 12, hidden: int = 20, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        g = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": g(100, dim) * 2, "out": g(2 * hidden, LABELS), "bias": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(dim, 4 * hidden), f"h{d}": g(hidden, 4 * hidden), f"c{d}": np.repeat([0, 1, 0, 0], hidden).astype(np.float32)}
        self.block = np.where(allowed(), 0, -1e4).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, state, cell, tape = np.zeros((n, steps, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[:, t] + state @ self.p[f"h{d}"]
            gate = _sigmoid(a[:, : 3 * h])
            i, f, o, u = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(a[:, 3 * h :])
            new = f * cell + i * u
            th = np.tanh(new)
            tape.append((t, i, f, o, u, cell, th, state))
            cell, state = new, o * th
            out[:, t] = state
        return out, tape

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["emb"][ids]
        (f, tf), (b, tb) = self._lstm(x, "f"), self._lstm(x, "b")
        h = np.concatenate([f, b], axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, h, tf, tb)

    def _chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward scores of the CRF and its log partition."""
        t = self.p["trans"] + self.block
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.block[0]
        for k in range(1, e.shape[1]):
            a[:, k] = _lse(a[:, k - 1][:, :, None] + t, 1) + e[:, k]
        for k in range(e.shape[1] - 2, -1, -1):
            b[:, k] = _lse(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        return a, b, _lse(a[:, -1], 1)

    def loss_and_grads(self, ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the label sequences, and its gradients."""
        e, (x, h, tf, tb) = self.emissions(ids)
        n, steps, _ = e.shape
        a, b, z = self._chain(e)
        t = self.p["trans"] + self.block
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None, :]
        gold = e[rows, cols, labels].sum(axis=1) + t[labels[:, :-1], labels[:, 1:]].sum(axis=1)
        de = np.exp(a + b - z[:, None, None])
        de[rows, cols, labels] -= 1
        dt = np.zeros_like(t)
        for k in range(steps - 1):
            dt += np.exp(a[:, k][:, :, None] + t + (e[:, k + 1] + b[:, k + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(dt, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        de /= n
        g = {"trans": np.where(allowed(), dt / n, 0).astype(np.float32), "bias": de.sum(axis=(0, 1)), "out": h.reshape(-1, h.shape[2]).T @ de.reshape(-1, LABELS)}
        dh = de @ self.p["out"].T
        dx = np.zeros_like(x)
        for d, tape, part in (("f", tf, dh[:, :, : self.hidden]), ("b", tb, dh[:, :, self.hidden :])):
            gx, gh, gc, dxd = self._back(x, tape, part, d)
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
            dx += dxd
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], ids.ravel(), dx.reshape(-1, x.shape[2]))
        return float((z - gold).mean()), g

    def _back(self, x: np.ndarray, tape: list, dout: np.ndarray, d: str):
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        da_all, gh = np.zeros((*x.shape[:2], wx.shape[1]), np.float32), np.zeros_like(wh)
        ds, dc = np.zeros((len(x), self.hidden), np.float32), np.zeros((len(x), self.hidden), np.float32)
        for t, i, f, o, u, cell, th, state in reversed(tape):
            ds = ds + dout[:, t]
            dc = dc + ds * o * (1 - th**2)
            da = np.concatenate([dc * u * i * (1 - i), dc * cell * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - u**2)], axis=1)
            da_all[:, t] = da
            gh += state.T @ da
            ds, dc = da @ wh.T, dc * f
        flat = da_all.reshape(-1, da_all.shape[2])
        return x.reshape(-1, x.shape[2]).T @ flat, gh, flat.sum(axis=0), da_all @ wx.T

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely label sequence of each window (Viterbi), and each label's marginal probability there."""
        e, _ = self.emissions(ids)
        a, b, z = self._chain(e)
        t = self.p["trans"] + self.block
        best, back = e[:, 0] + self.block[0], np.zeros(e.shape, dtype=np.int8)
        for k in range(1, e.shape[1]):
            s = best[:, :, None] + t
            back[:, k] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, k]
        path = np.zeros(e.shape[:2], dtype=np.int64)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(e))
        for k in range(e.shape[1] - 1, 0, -1):
            path[:, k - 1] = back[rows, k, path[:, k]]
        return path, np.exp(np.take_along_axis(a + b, path[:, :, None], 2)[:, :, 0] - z[:, None])


@dataclass(frozen=True)
class Windows:
    size: int = 64
    stride: int = 32


def window_starts(text: str, w: Windows) -> list[int]:
    """Overlapping windows on a fixed grid that hold a digit, an @ or a bracketed "at"; no kind is possible without one of those."""
    grid = {g for m in _TRIGGER(text) for g in range(max(0, m.start() // w.stride - w.size // w.stride + 1), m.start() // w.stride + 1)}
    last = max(0, -(-(len(text) - w.size) // w.stride))
    return [g * w.stride for g in sorted({min(g, last) for g in grid})]


def reconcile(found: list[tuple[Span, float]], base: list[Span], text: str, least: float) -> list[Span]:
    """The added spans of a whole text: of all windows' plausible spans clear of base spans, the non-overlapping set of the greatest weight."""
    best: dict[Span, float] = {}
    for span, p in found:
        k, s, e = span
        if p >= least and not any(s < f and b < e for _, b, f in base) and plausible(k, text[s:e]):
            best[span] = max(p, best.get(span, 0.0))
    spans = sorted(best, key=lambda x: (x[2], x[1], x[0]))
    ends = [s[2] for s in spans]
    score, take = [0.0], []
    for span in spans:
        before = int(np.searchsorted(ends, span[1], side="right"))
        value = score[before] + best[span] * (span[2] - span[1])
        take.append((value > score[-1], before))
        score.append(max(score[-1], value))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            out.append(spans[i - 1])
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def label_spans(path: np.ndarray, sure: np.ndarray, start: int) -> list[tuple[Span, float]]:
    """Spans of one label sequence that begins at `start`, each with its least marginal."""
    out, i, n = [], 0, len(path)
    while i < n:
        j = i + 1
        if path[i] % 2 == 1:
            while j < n and path[j] == path[i] + 1:
                j += 1
            out.append(((KINDS[path[i] // 2], start + i, start + j), float(sure[i:j].min())))
        i = j
    return out


def decode_pieces(texts: list[str], where: list[tuple[int, int, int]], net: BiLstmCrf, cells: int = 512 * 64) -> Iterator[tuple[tuple[int, int, int], list[tuple[Span, float]]]]:
    """(piece, its spans) for pieces (text, start, end) that have any; pieces of one length go through the network together."""
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for piece in where:
        by_size.setdefault(piece[2] - piece[1], []).append(piece)
    for size, same in by_size.items():
        step = max(1, cells // size)
        for at in range(0, len(same), step):
            some = same[at : at + step]
            ids = np.zeros((len(some), size), dtype=np.int64)
            for r, (k, s, e) in enumerate(some):
                c = char_ids(texts[k][s:e])
                ids[r, : len(c)] = c
            path, sure = net.decode(ids)
            for r in np.flatnonzero((path > 0).any(axis=1)):
                k, s, e = some[r]
                n = min(e, len(texts[k])) - s
                yield some[r], label_spans(path[r, :n], sure[r, :n], s)


def merged(wider: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces with those of the same text that overlap joined into one."""
    out: list[tuple[int, int, int]] = []
    for k, s, e in sorted(wider):
        if out and out[-1][0] == k and s < out[-1][2]:
            out[-1] = (k, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out


def find_spans(texts: list[str], net: BiLstmCrf | None, w: Windows = Windows(), least: float = 0.9) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text. All texts' windows go through the network together.

    A span that an inner edge cuts and no window holds whole is decoded again in a piece that reaches further beyond that
    edge, pieces that overlap joined into one, twice as far each time until no edge cuts it or the text ends: there is no
    bound on a span's length. A cut span on top of a base span is left, for whatever holds it could not be added.
    """
    base = [base_spans(t) for t in texts]
    if net is None:
        return [(b, []) for b in base]
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    where, reach = [(k, s, s + w.size) for k, t in enumerate(texts) for s in window_starts(t, w)], w.stride
    while where:
        cut: list[tuple[tuple[int, int, int], Span, bool, bool]] = []
        for (k, s, e), spans in decode_pieces(texts, where, net):
            for span, p in spans:
                left, right = span[1] == s and s > 0, span[2] == e and e < len(texts[k])
                if left or right:
                    cut.append(((k, s, e), span, left, right))
                else:
                    found[k].append((span, p))
        where = []
        for (k, s, e), (kind, a, b), left, right in cut:
            whole = any(x == kind and c <= a and b <= d for (x, c, d), _ in found[k])
            if not whole and not any(a < d and c < b for _, c, d in base[k]):
                where.append((k, max(0, s - reach) if left else s, e + reach if right else e))
        # grid positions only, so that lengths repeat and pieces of a batch are equally long; padding follows a text's end
        last = [-(-len(t) // w.stride) * w.stride for t in texts] if where else []
        where = merged([(k, s, max(min(e, last[k]), s + w.size)) for k, s, e in where])
        reach *= 2
    return [(b, reconcile(f, b, t, least)) for b, f, t in zip(base, found, texts, strict=True)]


def _variants(rng: np.random.Generator) -> tuple[str | None, str]:
    """A generated item: its kind and writing; None for numbers that only look like one."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    card = d(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    pick = int(rng.integers(0, 14))
    if pick <= 3:
        at, dot = [("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) ")][pick]
        return "email", f"{word()}{dot if pick == 0 else '.'}{d(2)}{at}{word()}{dot}{['com', 'org', 'net', 'io'][rng.integers(4)]}"
    if pick == 4:
        return "phone", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"
    if pick <= 6:
        return "phone", [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"][rng.integers(3)]
    if pick <= 8:
        dot = "." if pick == 7 else "[.]"
        return "ip", dot.join(str(x) for x in rng.integers(0, 256, 4))
    if pick == 9:
        return "card", card
    if pick == 10:
        return "card", ".".join(card[i : i + 4] for i in range(0, 16, 4))
    bad = d(15)
    bad += next(c for c in "9876543210" if not luhn(bad + c))
    return None, [f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", bad, d(6), f"{300 + int(rng.integers(600))}.{d(2)}.{d(3)}.{d(2)}", f"{d(2)}:{d(2)}", d(20)][rng.integers(7)]


def labelled(text: str, spans: list[Span], start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers and labels of one window; spans that the window cuts are labelled as far as it shows them."""
    ids, y = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    c = char_ids(text[start : start + size])
    ids[: len(c)] = c
    for k, s, e in spans:
        a, b = max(s - start, 0), min(e - start, len(c))
        if a < b:
            y[a:b] = 2 + 2 * KINDS.index(k)
            if s >= start or a == 0:
                y[a] = 1 + 2 * KINDS.index(k)
    return ids, y


def train(samples: list[tuple[str, list[Span]]], w: Windows = Windows(), generated: int = 1500, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 0) -> BiLstmCrf | None:
    """Adam on windows of labelled text: the samples as they are, and samples with a generated item put in, known places labelled."""
    if not samples:
        return None
    rng, net = np.random.default_rng(seed), BiLstmCrf(seed=seed)
    data = []
    for text, spans in samples:
        for s in window_starts(text, w) or [0]:
            data.append(labelled(text, spans, s, w.size))
    for _ in range(generated):
        text, spans = samples[rng.integers(len(samples))]
        kind, item = _variants(rng)
        at = int(rng.integers(0, len(text) + 1))
        if any(s <= at <= e for _, s, e in spans):
            continue
        pad = " " if at else ""
        new = text[:at] + pad + item + " " + text[at:]
        n = len(pad) + len(item) + 1
        moved = [(k, s + n * (s >= at), e + n * (s >= at)) for k, s, e in spans]
        if kind:
            moved.append((kind, at + len(pad), at + len(pad) + len(item)))
        data.append(labelled(new, moved, max(0, at - int(rng.integers(0, w.size - 8))), w.size))
    ids, y = np.stack([a for a, _ in data]), np.stack([b for _, b in data])
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            _, g = net.loss_and_grads(ids[pick], y[pick])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v**2 - second[k])
                net.p[k] -= (lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def train_from(docs: DataFrame, most_texts: int = 800, around: int = 160, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> BiLstmCrf | None:
    """A network from at most 2 * most_texts passages, about most_texts: texts with a digit or an @ by a hash of id and text,
    of each the `around` characters on either side of one such place, chosen by the same hash.

    The labelled spans are those of the fixed patterns; generated items in the same passages show the writings they miss.
    """
    rows = docs.filter(F.col(text_col).rlike("[0-9@]"))
    n = rows.count()
    if not n:
        return None
    hashed = F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(seed + 3))
    drawn = rows.filter(F.pmod(hashed, F.lit(1_000_000)) / 1e6 < min(1.0, most_texts / n)).select(hashed.alias("h"), F.col(text_col).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist(), strict=True):
                places = [m.start() for m in re.finditer("[0-9@]", t)]
                at = places[(h >> 20) % len(places)]
                out.append(t[max(0, at - around) : at + around])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(out, pa.string())], names=["h", "t"])

    got = drawn.mapInArrow(cut, "h bigint, t string").orderBy("h", "t").limit(2 * most_texts).collect()
    return train([(r["t"], base_spans(r["t"])) for r in got], seed=seed)


def detect(docs: DataFrame, net: BiLstmCrf | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added, n_spans for every row and whole text; nothing is shuffled.

    Counts and hash are of the base spans; `spans` has those and the added ones, `added` how many the network added,
    n_spans how many there are in all. Added spans never overlap base ones or each other; of overlapping ones the set with
    the greatest weight stays, of equal sets the one that ends first. Null text counts as empty: no spans, the hash of the
    empty string. Repeated rows are answered each, alike; very long texts are read whole. Only id and text are read, so
    other columns' names do not matter. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                got = find_spans([t or "" for t in part.column("__text").to_pylist()], held.value, least=least)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in got], type=pa.int64()) for k in KINDS]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got])
                yield pa.RecordBatch.from_arrays([part.column("__id"), *counts, digest, pa.array([joined(b + a) for b, a in got]), pa.array([len(a) for _, a in got], type=pa.int64()), pa.array([len(b) + len(a) for b, a in got], type=pa.int64())], names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "added", "n_spans"])

    schema = f"`{id_col}` {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, added bigint, n_spans bigint"
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
