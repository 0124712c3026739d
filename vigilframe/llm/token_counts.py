"""Token counts of a BPE vocabulary by merging with a heap and a linked list, without producing identifiers."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: printable Latin-1 bytes stand for themselves, the others get characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class WordBpe:
    """Counts tokens as the tokenizers library gives them for a word-level BPE file over bytes.

    Reads vocabulary, merges, normalizers, the pre-tokenizer's pattern and the added tokens from the file. A file that
    asks for anything else (other normalizers, dropout, unknown tokens, byte fallback, kept separators, prefix spaces,
    added tokens that strip or normalise) is refused by ValueError, not counted wrongly. Counts by piece are kept in a
    table of at most `most` pieces of at most `longest` characters for as long as the worker lives.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.nfc, self.lower = self._normalizers(spec.get("normalizer"))
        self._supported(spec)
        self.longest = longest
        self.suffix, self.most = model.get("end_of_word_suffix") or "", most
        self.rank: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            self.rank[tuple(m) if isinstance(m, list) else tuple(m.split(" "))] = i
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.marks = {s[:2] for s in special}
        self.alphabet = byte_alphabet()
        self.known: dict[str, int] = {}

    @staticmethod
    def _normalizers(spec: dict | None) -> tuple[bool, bool]:
        """Whether a file asks for NFC and for lower case. Blanks for white space change nothing: separators are removed."""
        steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        for s in steps:
            if s["type"] not in ("NFC", "Lowercase") and not (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "):
                raise ValueError(f"unsupported normalizer: {s}")
        kinds = [s["type"] for s in steps if s["type"] != "Replace"]
        if kinds not in ([], ["NFC"], ["Lowercase"], ["NFC", "Lowercase"]):
            raise ValueError(f"unsupported order of normalizers: {kinds}")
        return "NFC" in kinds, "Lowercase" in kinds

    @staticmethod
    def _supported(spec: dict) -> None:
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [s["type"] for s in steps if s["type"] not in ("Split", "ByteLevel")]
        odd += ["Split" for s in steps if s["type"] == "Split" and not (s["behavior"] == "Removed" and s["invert"] and "Regex" in s["pattern"])]
        odd += ["ByteLevel" for s in steps if s["type"] == "ByteLevel" and (s["add_prefix_space"] or s.get("use_regex", True))]
        odd += [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or odd:
            raise ValueError(f"unsupported tokenizer file: {model['type']}, {odd}")

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges. The pair with the lowest rank, leftmost first, is merged until none is left."""
        symbols = [self.alphabet[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if not n:
            return 0
        symbols[-1] += self.suffix
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            k = right[i] = right[j]
            n -= 1
            if k >= 0:
                left[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := left[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n

    def _plain(self, text: str) -> int:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # the library lower-cases character by character
        known, total = self.known, 0
        for piece in self.find(text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= self.longest:
                    if len(known) >= self.most:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string in it counts as one, as by the library's default."""
        if not text:
            return 0
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


_LOADED: dict[str, WordBpe] = {}


def counter(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row, in place: nothing is shuffled.

    path: the tokenizer file on the workers; None takes word_bpe_49k.json of the installed public_tokenizers. Null text
    counts as empty, with 0 bytes and 0 tokens; blank texts have 0 tokens. Repeated rows stay repeated.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            bpe = counter(public_tokenizers.path("word_bpe_49k.json"))
        else:
            bpe = counter(path)
        for batch in batches:
            for part in pieces(batch, "__text"):
                n = [bpe.count(t) for t in part.column("__text").to_pylist()]
                size = pc.binary_length(part.column("__text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("__id"), size, pa.array(n, type=pa.int64()), pa.array([x > limit for x in n])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
