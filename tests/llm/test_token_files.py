"""What a tokenizer file asks for is done or refused."""

import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigilframe.llm.token_counts import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "   ", "It's A Test's END", "ΟΔΟΣ ΣΑΣ İstanbul ẞ", "été Å", "x" * 500 + " y", "1234 !!??   z", "<|endoftext|>A<|startoftext|> <|endoftext", "日本語 हिन्दी 🙂🙂"]


def spec():
    with open(PATH, encoding="utf-8") as f:
        return json.load(f)


@pytest.mark.parametrize("normalizer", [
    None, {"type": "NFC"}, {"type": "Lowercase"}, {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}])
def test_normalizers_of_the_file_hold(tmp_path, normalizer):
    s = spec()
    s["normalizer"] = normalizer
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(s, f)
    mine, library = WordBpe(path, most=5, longest=4), Tokenizer.from_file(path)
    assert [mine.count(t) for t in TEXTS * 2] == [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS * 2]
    assert len(mine.known) <= 5 and max(map(len, mine.known)) <= 4


@pytest.mark.parametrize("change", [
    lambda s: s.update(normalizer={"type": "NFKC"}), lambda s: s["model"].update(dropout=0.1), lambda s: s["model"].update(ignore_merges=True),
    lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"), lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True), lambda s: s["added_tokens"][0].update(lstrip=True),
    lambda s: s.update(normalizer={"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "NFC"}]})])
def test_other_files_are_refused(tmp_path, change):
    s = spec()
    change(s)
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(s, f)
    with pytest.raises(ValueError, match="unsupported"):
        WordBpe(path)
