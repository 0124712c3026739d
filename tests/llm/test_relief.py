"""The driver's memory between jobs, and the shuffles of a round of components."""

import re
from pathlib import Path

from vigilframe.llm import components
from vigilframe.llm.common import relieve


def resident(pid="self") -> int:
    """MB of memory that is no file's."""
    return int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) // 1024


def test_freed_texts_go_back_to_the_machine(spark):
    """Freed blocks below one that is still held stay in the C heap until they are trimmed."""
    texts = [bytes(3000) for _ in range(60_000)]
    held = texts[::500]
    full = resident()
    texts.clear()
    assert held and resident() > full - 50
    relieve(spark)
    assert resident() < full - 100


def test_freed_blocks_of_the_jvm_go_back_to_the_machine(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    util = spark._jvm.org.apache.spark.unsafe.Platform
    blocks = [util.allocateMemory(60_000) for _ in range(2000)]
    for b in blocks:
        util.setMemory(b, 1, 60_000)
    full = resident(pid)
    for b in blocks[:-1]:
        util.freeMemory(b)
    relieve(spark)
    assert resident(pid) < full - 60
    util.freeMemory(blocks[-1])


def test_large_star_shuffles_three_times(spark):
    """Once for the minima and twice for the join; equal rows are dropped by the small star."""
    edges = spark.createDataFrame([(5, 3), (5, 2), (3, 2), (9, 5)], "a long, b long")
    with_plain_joins = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(with_plain_joins)
    spark.conf.set(with_plain_joins, "-1")
    try:
        star = components._large_star(edges)
        assert star._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted((r.a, r.b) for r in star.collect()) == [(3, 2), (5, 2), (5, 2), (9, 2)]
        assert {(r.node, r.root) for r in components.components(edges.unionAll(edges)).collect()} == {(2, 2), (3, 2), (5, 2), (9, 2)}
    finally:
        spark.conf.set(with_plain_joins, before)
