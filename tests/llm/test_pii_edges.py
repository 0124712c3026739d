"""Added spans are found whole wherever the window grid cuts them."""

import numpy as np
import pytest

from vigilframe.llm import pii

BLANK = pii.char_ids("~")[0]


class Marks:
    """A network that labels every run of characters but ~ as one address, whatever window it sees."""

    def __init__(self):
        self.cells = 0

    def decode(self, ids):
        self.cells += ids.size
        on = (ids != BLANK) & (ids != 0)
        begin = on & ~np.pad(on, ((0, 0), (1, 0)))[:, :-1]
        return np.where(begin, 1, np.where(on, 2, 0)), np.ones(ids.shape)


ADDRESS = "anna.schmidt42 [at] example-mail [dot] com"
LONG = "a" * 90 + " [at] " + "b" * 150 + " [dot] com"


@pytest.mark.parametrize("address", [ADDRESS, LONG])
@pytest.mark.parametrize("after", [0, 5, 400])
def test_cut_addresses_are_joined(address, after):
    for at in range(200, 232):
        text = "~" * at + address + "~" * after
        assert pii.find_spans([text], Marks()) == [([], [("email", at, at + len(address))])], at


def test_two_texts_and_a_span_at_the_start():
    got = pii.find_spans([LONG + "~" * 50, "~" * 77 + ADDRESS, ""], Marks())
    assert got == [([], [("email", 0, len(LONG))]), ([], [("email", 77, 77 + len(ADDRESS))]), ([], [])]


def test_work_stays_in_proportion_when_all_is_labelled():
    net = Marks()
    text = "1 " * 20_000
    pii.find_spans([text], net)
    assert net.cells < 12 * len(text)
