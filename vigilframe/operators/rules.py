"""Signature rules as a table, and their join with payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = r"^(\w+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(->|<>|<-)\s+(\S+)\s+(\S+)\s*\((.*)\)\s*$"
OPTION = r'([A-Za-z_.]+)(?::((?:"(?:[^"\\]|\\.)*"|[^;"])*))?;'
SHORTEST = 4  # bytes; shorter contents make no prefilter pattern


def parse_rules(lines: DataFrame, col: str = "value", variables: dict[str, str] | None = None) -> DataFrame:
    """One row per rule line: header fields, sid, message, class, priority, contents and threshold.

    Continuations are expected to be joined, comments and blank lines are skipped, `$NAME` is replaced textually. A line
    that is no rule is dropped.
    """
    text = F.trim(F.col(col))
    for name, value in (variables or {}).items():
        text = F.replace(text, F.lit(f"${name}"), F.lit(value))
    r = lines.select(text.alias("line")).filter(~F.col("line").startswith("#") & F.col("line").rlike(HEADER))
    g = lambda i: F.regexp_extract("line", HEADER, i)
    r = r.select("line", *[g(i).alias(n) for i, n in enumerate(("action", "proto", "src", "src_port", "direction", "dst", "dst_port", "options"), 1)])
    keys, values = F.regexp_extract_all("options", F.lit(OPTION), 1), F.regexp_extract_all("options", F.lit(OPTION), 2)
    r = r.withColumn("opts", F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda o: F.struct(o["k"].alias("k"), F.trim(o["v"]).alias("v"))))
    one = lambda k: F.try_element_at(F.filter("opts", lambda o: o["k"] == k), F.lit(1))["v"]
    quoted = lambda v: F.regexp_extract(v, r'^!?"(.*)"$', 1)
    r = r.withColumns({
        "sid": one("sid").try_cast("int"), "rev": one("rev").try_cast("int"), "msg": quoted(one("msg")), "classtype": one("classtype"), "priority": F.coalesce(one("priority").try_cast("int"), F.lit(3)),
        "noalert": F.exists("opts", lambda o: o["k"] == "noalert"), "threshold": threshold_spec(one("threshold")),
    })
    return r.withColumns({"contents": content_list(F.col("opts")), "keywords": F.transform("opts", lambda o: o["k"])}).drop("opts", "options", "line")


def merge_rule_sets(sets: list[DataFrame], order: str) -> DataFrame:
    """One rule of each sid: that of the last set which has it, and of repeated sids in a set the last by `order`. Later sets replace, they do not renumber."""
    rows = [s.withColumn("__set", F.lit(i)) for i, s in enumerate(sets)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    kept = [c for c in both.columns if c not in ("__set", "sid")]
    last = both.groupBy("sid").agg(F.max_by(F.struct(*kept), F.struct("__set", order)).alias("__r"))
    return last.select("sid", "__r.*")


def rule_totals(rules: DataFrame) -> DataFrame:
    """name, n: all rules, those by action and protocol, with content, pcre or flow, disabled ones, and those that have a fast pattern."""
    has = lambda k: F.array_contains("keywords", k)
    names = F.array(
        F.lit("total"), F.concat(F.lit("action:"), "action"), F.concat(F.lit("protocol:"), "proto"), F.when(has("content"), "with_content"), F.when(has("pcre"), "with_pcre"), F.when(has("flow"), "with_flow"),
        F.when(~F.col("enabled"), "disabled"), F.when(F.exists("contents", lambda c: ~c["negated"]), "fast_patterns"),
    )
    return rules.select(F.explode(F.array_compact(names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def content_list(opts: Column) -> Column:
    """Contents in order, each with the modifiers that follow it up to the next content."""
    empty = F.array().cast("array<struct<pattern:string,negated:boolean,nocase:boolean,offset:int,depth:int,fast:boolean>>")

    def add(acc: Column, o: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        new = F.struct(decode_hex(F.regexp_extract(o["v"], r'^!?"(.*)"', 1)).alias("pattern"), o["v"].startswith("!").alias("negated"), F.lit(False).alias("nocase"), F.lit(0).alias("offset"), F.lit(None).cast("int").alias("depth"), F.lit(False).alias("fast"))
        k, n = o["k"], o["v"].try_cast("int")
        changed = F.struct(
            last["pattern"].alias("pattern"), last["negated"].alias("negated"), (last["nocase"] | (k == "nocase")).alias("nocase"),
            F.when(k == "offset", F.coalesce(n, F.lit(0))).otherwise(last["offset"]).alias("offset"), F.when(k == "depth", n).otherwise(last["depth"]).alias("depth"), (last["fast"] | (k == "fast_pattern")).alias("fast"))
        known = k.isin("nocase", "offset", "depth", "fast_pattern") & last.isNotNull()
        return F.when(k == "content", F.concat(acc, F.array(new))).when(known, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(changed))).otherwise(acc)

    return F.aggregate(opts, empty, add)


def decode_hex(v: Column) -> Column:
    """`|41 42|` runs of a content literal as characters."""
    parts = F.split(v, r"\|")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.decode(F.unhex(F.replace(x, F.lit(" "), F.lit(""))), "ISO-8859-1")).otherwise(x)), "")


def threshold_spec(v: Column) -> Column:
    g = lambda k: F.regexp_extract(v, rf"{k}\s+(\w+)", 1)
    return F.when(v.isNotNull(), F.struct(g("type").alias("type"), g("track").alias("track"), g("count").try_cast("int").alias("count"), g("seconds").try_cast("int").alias("seconds")))


def size_spec(v: Column) -> Column:
    """`n`, `>n`, `<n`, `>=n`, `<=n`, `a<>b` as (low, high), both ends included; null for anything else."""
    n = lambda k: F.regexp_extract(F.trim(v), r"^(<=|>=|<|>)?\s*(\d+)\s*(?:(<>)\s*(\d+))?$", k)
    a, b, top = n(2).try_cast("long"), n(4).try_cast("long"), F.lit((1 << 62)).cast("long")
    zero = F.lit(0).cast("long")
    low = F.when(n(3) != "", a + 1).when(n(1) == ">", a + 1).when(n(1) == ">=", a).when(n(1).isin("<", "<="), zero).otherwise(a)
    high = F.when(n(3) != "", b - 1).when(n(1) == "<", a - 1).when(n(1) == "<=", a).when(n(1).isin(">", ">="), top).otherwise(a)
    return F.when(a.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def literal_pattern(content: Column, nocase: Column) -> Column:
    """A regular expression that matches exactly a content's characters: each as an escape of two or more hex digits."""
    points = F.transform(F.regexp_extract_all(content, F.lit("(?s)(.)"), 1), lambda c: F.concat(F.lit("\\x{"), F.lower(F.hex(F.ascii(c))), F.lit("}")))
    return F.concat(F.when(nocase, F.lit("(?i)")).otherwise(F.lit("")), F.array_join(points, ""))


def tcp_flags_spec(v: Column) -> Column:
    """`SA`, `S,12`, `+F`, `*SR`, `!A` as (mode, want): want has the bits of the letters."""
    bits = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32, "E": 64, "C": 128}
    letters = F.split_part(v, F.lit(","), F.lit(1))
    want = sum((F.when(letters.contains(k), F.lit(b)).otherwise(0) for k, b in bits.items()), F.lit(0))
    return F.struct(F.when(letters.rlike(r"^\+"), "plus").when(letters.rlike(r"^\*"), "any").when(letters.rlike("^!"), "not").otherwise("exact").alias("mode"), want.alias("want"))


def port_predicate(spec: Column, port: Column) -> Column:
    """any, a port, a range a:b, a list [..], or the negation of one."""
    body = F.regexp_replace(spec, r"^!|[\[\]]", "")
    inside = F.exists(F.split(body, ","), lambda p: F.when(p.contains(":"), (port >= F.coalesce(F.split_part(p, F.lit(":"), F.lit(1)).try_cast("int"), F.lit(0))) & (port <= F.coalesce(F.split_part(p, F.lit(":"), F.lit(2)).try_cast("int"), F.lit(65535)))).otherwise(p.try_cast("int") == port))
    return (spec == "any") | F.when(spec.startswith("!"), ~inside).otherwise(inside)


def port_blocks(spec: Column) -> Column:
    """A port spec as aligned blocks of powers of two, structs (port_bits, port_lo), without overlap: 32 an interval at most.

    any, a port, a range a:b, a list [..], or the negation of one; intervals of a list are merged by their distinct blocks.
    """
    body = F.regexp_replace(spec, r"^!|[\[\]]", "")
    bound = lambda p, i, default: F.coalesce(F.split_part(p, F.lit(":"), F.lit(i)).try_cast("int"), F.lit(default))
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    listed = F.transform(F.split(body, ","), lambda p: F.when(F.trim(p).contains(":"), span(bound(F.trim(p), 1, 0), bound(F.trim(p), 2, 65535))).when(F.trim(p).try_cast("int").isNotNull(), span(F.trim(p).try_cast("int"), F.trim(p).try_cast("int"))))
    ordered = F.array_sort(F.filter(listed, lambda p: p.isNotNull() & (p["lo"] <= p["hi"])))
    # gaps between the intervals: where each begins, and what no earlier one reaches
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("gaps"), F.array().cast("array<struct<lo:int,hi:int>>").alias("kept"))
    step = lambda s, p: F.struct(
        F.greatest(s["at"], p["hi"] + 1).alias("at"), F.when(p["lo"] > s["at"], F.concat(s["gaps"], F.array(span(s["at"], p["lo"] - 1)))).otherwise(s["gaps"]).alias("gaps"),
        F.when(p["hi"] >= s["at"], F.concat(s["kept"], F.array(span(F.greatest(s["at"], p["lo"]), p["hi"])))).otherwise(s["kept"]).alias("kept"))
    swept = F.aggregate(ordered, start, step)
    rest = F.when(swept["at"] <= 65535, F.concat(swept["gaps"], F.array(span(swept["at"], F.lit(65535))))).otherwise(swept["gaps"])
    spans = F.when(spec == "any", F.array(span(F.lit(0), F.lit(65535)))).when(spec.startswith("!"), rest).otherwise(swept["kept"])

    def blocks(p: Column) -> Column:
        def level(k: Column) -> Column:
            size = F.pow(F.lit(2.0), k).cast("int")
            first, end = F.floor((p["lo"] + size - 1) / size).cast("int"), F.floor((p["hi"] + 1) / size).cast("int")
            some = first < end
            one = lambda at: F.struct(k.alias("port_bits"), (at * size).alias("port_lo"))
            return F.array_compact(F.array(F.when(some & (first % 2 == 1), one(first)), F.when(some & (end % 2 == 1), one(end - 1))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(16)), level))

    return F.flatten(F.transform(spans, blocks))


def header_join(packets: DataFrame, headers: DataFrame, src: str, port: str) -> DataFrame:
    """packets with the sid of each rule header that they match: protocol, source network and destination port, by one equi join.

    headers has sid, proto, prefix, lo (networks as of cidr_bounds) and spec (a port spec). A port spec becomes aligned
    blocks, a network is one by nature. A packet looks up one key for each pair of prefix and block length that occurs
    among the rules; the driver sees those pairs, 33 x 17 at most, not the rules. The blocks are written once and read for
    the pairs and the join, so the rules' long expressions are compiled for one plan. Each match is found once.
    """
    from ..sources.scratch import as_table
    from .lookups import block_size

    table = as_table(headers.select("sid", "proto", "prefix", F.col("lo").alias("net_lo"), F.inline(port_blocks(F.col("spec")))))
    shapes = sorted(tuple(r) for r in table.select("prefix", "port_bits").distinct().collect())  # 561 rows at most
    if not shapes:
        return packets.join(table.select("proto", "sid"), "proto").select(*packets.columns, "sid")
    size, unit = block_size(F.col("prefix")), F.pow(F.lit(2.0), F.col("port_bits")).cast("int")
    lengths = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(b).alias("port_bits")) for p, b in shapes])
    probe = packets.select("*", F.inline(lengths))
    probe = probe.withColumns({"net_lo": F.col(src) - F.col(src) % size, "port_lo": F.col(port) - F.col(port) % unit})
    return probe.join(table, ["proto", "prefix", "port_bits", "net_lo", "port_lo"]).select(*packets.columns, "sid")


def fast_pattern(contents: Column) -> Column:
    """The explicit fast pattern, else the longest positive content; lower-cased, null below SHORTEST characters."""
    plain = F.filter(contents, lambda c: ~c["negated"])
    best = F.array_max(F.transform(plain, lambda c: F.struct(c["fast"].alias("f"), F.length(c["pattern"]).alias("n"), c["pattern"].alias("p"))))
    return F.when(best["n"] >= SHORTEST, F.lower(best["p"]))


def content_match(contents: Column, payload: Column) -> Column:
    """All positive contents found in their place, no negated one."""
    def ok(c: Column) -> Column:
        end = F.when(c["depth"].isNull(), F.length(payload)).otherwise(c["depth"])
        part = F.substring(payload, c["offset"] + 1, end)
        found = F.when(c["nocase"], F.contains(F.lower(part), F.lower(c["pattern"]))).otherwise(F.contains(part, c["pattern"]))
        return F.when(c["negated"], ~found).otherwise(found)

    return F.forall(contents, ok)


def match_rules(payloads: DataFrame, rules: DataFrame, id_col: str, payload: str, most_rules: int = 200_000) -> DataFrame:
    """(id, sid) of every rule that matches a payload.

    The rules' fast patterns (most_rules at most, else ValueError) go to the tasks as one automaton; each payload is
    scanned once and yields candidate rules, overlapping hits included. Candidates then join the rules on sid for the
    exact test. Rules without a fast pattern are candidates of every payload.
    """
    import ahocorasick

    rows = rules.select("sid", fast_pattern(F.col("contents")).alias("fp")).limit(most_rules + 1).collect()
    if len(rows) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    by: dict[str, list[int]] = {}
    for r in rows:
        if r["fp"]:
            by.setdefault(r["fp"], []).append(r["sid"])
    always = [r["sid"] for r in rows if not r["fp"]]
    held = payloads.sparkSession.sparkContext.broadcast((by, always))

    @F.pandas_udf("array<int>")
    def candidates(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns, rest = held.value
        scan = ahocorasick.Automaton()
        for p, sids in patterns.items():
            scan.add_word(p, sids)
        scan.make_automaton()
        for part in parts:
            yield pd.Series([sorted({s for _, found in (scan.iter((t or "").lower()) if patterns else ()) for s in found} | set(rest)) for t in part])

    c = payloads.select(id_col, F.col(payload).alias("__p"), F.explode(candidates(payload)).alias("sid"))
    return c.join(rules.select("sid", "contents"), "sid").filter(content_match(F.col("contents"), F.col("__p"))).select(id_col, "sid")
