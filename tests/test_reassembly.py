"""Segments and fragments in any order against plain loops, and literal cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilframe.operators import reassembly as R


def run(rows, buffer=None):
    buffer = buffer or R.SegmentBuffer()
    return [buffer({"syn": s, "seq": q, "data": d}) for s, q, d in rows]


def test_out_of_order_repeated_and_wrapped_segments():
    start = (1 << 32) - 4
    got = run([(True, start - 1, ""), (False, start + 3, "def"), (False, start, "abc"), (False, start, "abc"), (False, 2, "ghi"), (False, 2, ""), (False, 70_000, "far")])
    assert [g["kind"] for g in got] == ["syn", "held", "in_order", "old", "in_order", "empty", "refused"]
    assert [g["released"] for g in got] == ["", "", "abcdef", "", "ghi", "", ""]


def test_first_segment_without_syn_is_expected():
    assert [g["released"] for g in run([(False, 10, "ab"), (False, 14, "ef"), (False, 12, "cd")])] == ["ab", "", "cdef"]


def test_a_later_copy_replaces_a_held_segment_and_old_ones_go():
    got = run([(False, 0, "a"), (False, 2, "cd"), (False, 2, "CD"), (False, 3, "x"), (False, 1, "bb"), (False, 3, "d"), (False, 4, "e")])
    assert [g["released"] for g in got] == ["a", "", "", "", "bbx", "", "e"]


def test_held_bytes_are_bounded():
    buffer = R.SegmentBuffer()
    run([(False, 0, "a")], buffer)
    kinds = [buffer({"syn": False, "seq": 2 + i, "data": "x" * 40_000})["kind"] for i in range(40)]
    assert kinds == ["held"] * 27 + ["refused"] * 13 and buffer.bytes == 27 * 40_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcü", min_size=1, max_size=60), st.integers(0, (1 << 32) - 1), st.integers(0, 1 << 30))
def test_all_segments_in_any_order_give_the_text(text, isn, seed):
    """After the SYN, pieces in any order and repeated give the whole text, unless a held number lies beyond the wrap-around."""
    rng, at, pieces = random.Random(seed), 0, []
    while at < len(text):
        n = rng.randint(1, 7)
        pieces.append(((isn + 1 + len(text[:at].encode())) % (1 << 32), text[at : at + n]))
        at += n
    if pieces[-1][0] < pieces[0][0]:
        return
    sent = pieces + rng.sample(pieces, len(pieces) // 2)
    rng.shuffle(sent)
    assert "".join(g["released"] for g in run([(True, isn, "")] + [(False, q, d) for q, d in sent])) == text


def plain_fragments(rows):
    """Every stored fragment is compared with each new one; the end is looked for in sorted order."""
    out, first, stored, total, end = [], None, [], 0, None
    for at, offset, size, more in rows:
        expired = first is not None and at - first > 30
        if expired or first is None:
            first, stored, total, end = at, [], 0, None
        a, b = offset * 8, offset * 8 + size
        total += size
        if not more:
            end = b
        overlap = any(a < y and b > x for x, y in stored)
        if not overlap:
            stored.append((a, b))
        big = end if end is not None and end > 65_535 else total if total > 65_535 else None
        reach, gap = 0, False
        for x, y in sorted(stored):
            gap |= x > reach
            reach = max(reach, y)
        whole = end is not None and not gap and reach >= end
        out.append((size < 28 and more, overlap, big, whole, expired))
        if whole:
            first = None
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 12), st.sampled_from([0, 8, 16, 24, 32, 40_000]), st.booleans()), max_size=14))
def test_fragment_groups_match_a_plain_loop(rows):
    rows = sorted(rows, key=lambda r: r[0])
    group = R.FragmentGroup()
    got = [group({"at": float(a), "offset": o, "size": s, "more": m}) for a, o, s, m in rows]
    assert [(g["tiny"], g["overlap"], g["oversized"], g["completed"], g["expired"]) for g in got] == plain_fragments(rows)


@pytest.mark.parametrize("last", [10.0, 100.0])
def test_ratios_count_open_groups_that_are_too_old(spark, last):
    rows = [("a", 1, 0.0, 0, 16, True), ("a", 1, 1.0, 1, 16, True), ("a", 2, 2.0, 0, 32, False), ("b", 1, 0.0, 0, 32, True)]
    f = spark.createDataFrame(rows, "src string, id int, at double, offset long, size long, more boolean")
    t = R.track_fragments(f, ["src", "id"], ["at"])
    t = t.withColumn("latest", F.expr("row_number() OVER (PARTITION BY src, id ORDER BY at DESC) = 1")).withColumn("packets", F.lit(6))
    got = {r["src"]: (round(r["rate"], 3), round(r["overlap"], 3), round(r["incomplete"], 3), round(r["tiny"], 3)) for r in R.fragment_ratios(t, ["src"], spark.createDataFrame([(last,)], "at double"), F.col("packets")).collect()}
    late = last > 30
    assert got == {"a": (0.5, 0.333, 0.333 if late else 0.0, 0.667), "b": (0.167, 0.0, 1.0 if late else 0.0, 0.0)}


def test_empty_tables(spark):
    s = spark.createDataFrame([], "doc_id long, k long, syn boolean, seq long, data string")
    assert R.reassemble(s, ["doc_id"], ["k"]).count() == 0


def test_lines_of_one_number_and_day_in_any_order_of_files(spark, tmp_path):
    """Two lines of an order with equal number and day: overlap and completion don't depend on which is read first."""
    import datetime

    from vigilframe.plans import registry

    day = datetime.datetime(1996, 3, 4)
    rows = [(o, p, 1, n, float(q), day) for o in range(1, 40) for n, p, q in ((1, 1, 3), (2, 11, 3), (2, 2, 9), (3, 22, 2), (3, 3, 4), (3, 4, 7))]
    got = []
    for i, some in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(some, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
        df.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got.append([sorted(map(str, map(tuple, registry.queries()[name](spark, f"{tmp_path}/{i}").collect()))) for name in ("I31_fragment_tracking", "D49_fragment_ratios")])
    assert got[0] == got[1]
