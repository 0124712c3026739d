"""Connections and datagrams put together again, and the state that sessions of protocols keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reassembly as R
from ..sources import tables as T
from .registry import register

PIECE = 1000


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as TCP streams: pieces of a text arrive shuffled, some twice, some never; every third stream wraps around."""
    d = T.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("text <> ''")
    d = d.withColumn("isn", F.when(F.col("doc_id") % 3 == 0, 4294965796).otherwise((F.col("doc_id") * 2654435761) % 4294967296))
    p = d.select("doc_id", "isn", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))).alias("i"), "text")
    p = p.select("doc_id", "isn", "i", F.expr(f"substring(text, i * {PIECE} + 1, {PIECE})").alias("data"))
    n = F.octet_length("data").cast("long")
    p = p.withColumn("seq", (F.col("isn") + 1 + F.sum(n).over(Window.partitionBy("doc_id").orderBy("i")) - n) % 4294967296)
    p = p.withColumn("at", F.col("i") * 2 + (F.col("doc_id") + F.col("i") * 3) % 7).filter((F.col("doc_id") + F.col("i")) % 17 != 16)
    again = p.filter((F.col("doc_id") + F.col("i")) % 6 == 0).withColumns({"at": F.col("at") + 5, "copy": F.lit(1)})
    syn = d.filter("doc_id % 5 <> 4").select("doc_id", F.lit(-1).alias("i"), F.lit("").alias("data"), F.col("isn").alias("seq"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("copy"), F.lit(True).alias("syn"))
    both = p.withColumn("copy", F.lit(0)).unionByName(again).withColumn("syn", F.lit(False)).drop("isn").unionByName(syn)
    return both.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "i", "copy"))).select("doc_id", "k", "syn", "seq", "data")


SEGMENTS = f"""doc AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 4294965796 ELSE (doc_id * 2654435761) % 4294967296 END AS isn FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, isn, i, substr(text, i * {PIECE} + 1, {PIECE}) AS data FROM (SELECT *, unnest(range(0, (length(text) - 1) // {PIECE} + 1)) AS i FROM doc)),
placed AS (SELECT doc_id, i, data, (isn + 1 + sum(strlen(data)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(data)) % 4294967296 AS seq, i * 2 + (doc_id + i * 3) % 7 AS due FROM pieces),
sent AS (
  SELECT doc_id, i, data, seq, due, 0 AS copy, false AS syn FROM placed WHERE (doc_id + i) % 17 <> 16
  UNION ALL SELECT doc_id, i, data, seq, due + 5, 1, false FROM placed WHERE (doc_id + i) % 17 <> 16 AND (doc_id + i) % 6 = 0
  UNION ALL SELECT doc_id, -1, '', isn, -1, 0, true FROM doc WHERE doc_id % 5 <> 4),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY due, i, copy) AS k, syn, seq::BIGINT AS seq, data FROM sent)"""


def _behind(a: str, b: str) -> str:
    """SQL of R._before."""
    return f"((({b}) - ({a}) + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647)"


def _step(sql: str) -> str:
    """The fold as recursion: a row takes the next segment, or after one in order one more held segment."""
    low = "list_min(list_transform(held, lambda x: x.seq))"
    size = "coalesce(list_sum(list_transform(held, lambda x: strlen(x.data))), 0)"
    take = f"(kind = 'in_order' AND len(held) > 0 AND ({low} = nxt OR {_behind(low, 'nxt')}))"
    first = "coalesce(nxt, seq)"
    arrived = f"""CASE WHEN syn THEN 'syn' WHEN data = '' THEN 'empty' WHEN seq = {first} THEN 'in_order' WHEN NOT {_behind(first, 'seq')} THEN 'old'
      WHEN (seq - {first} + 4294967296) % 4294967296 > {R.MAX_GAP} OR {size} >= {R.MAX_HELD} THEN 'refused' ELSE 'held' END"""
    return f"""WITH RECURSIVE {sql},
fold(doc_id, k, step, nxt, held, kind, released) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0, NULL::BIGINT, []::STRUCT(seq BIGINT, data VARCHAR)[], 'start', '' FROM seg
  UNION ALL
  SELECT doc_id, CASE WHEN take THEN k ELSE k + 1 END, step + 1,
         CASE WHEN take AND low = nxt THEN (nxt + strlen(piece)) % 4294967296 WHEN take THEN nxt
              WHEN now = 'syn' THEN (seq + 1) % 4294967296 WHEN now = 'in_order' THEN (seq + strlen(data)) % 4294967296 WHEN now = 'empty' THEN nxt ELSE {first} END,
         CASE WHEN take THEN list_filter(held, lambda x: x.seq <> low)
              WHEN now = 'held' THEN list_append(list_filter(held, lambda x: x.seq <> seq), {{'seq': seq, 'data': data}}) ELSE held END,
         CASE WHEN take THEN 'in_order' ELSE now END,
         CASE WHEN take THEN released || CASE WHEN low = nxt THEN piece ELSE '' END WHEN now = 'in_order' THEN data ELSE '' END
  FROM (SELECT f.*, s.seq, s.data, {low} AS low, {take} AS take, {arrived} AS now,
               list_filter(held, lambda x: x.seq = {low})[1].data AS piece
        FROM fold f LEFT JOIN seg s ON s.doc_id = f.doc_id AND s.k = f.k + 1 WHERE {take} OR s.k IS NOT NULL))
SELECT doc_id, k, kind, strlen(released) AS bytes, sha256(released) AS sha256 FROM fold WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY step DESC) = 1"""


@register("I12_tcp_reassembly", _step(SEGMENTS))
def tcp_reassembly(spark, sf):
    """What each segment of a stream lets through: kind, bytes and hash of the released text."""
    out = R.reassemble(segments(spark, sf), ["doc_id"], ["k"])
    return out.select("doc_id", F.col("k").cast("long").alias("k"), "kind", F.octet_length("released").cast("long").alias("bytes"), F.sha2("released", 256).alias("sha256"))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """`lineitem` as IP fragments: an order is a datagram, a line a fragment of 8 bytes a unit of quantity, a day a second.

    Some begin a unit early, some are lost, and some datagrams begin near the greatest offset.
    """
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("at"))
    w = Window.partitionBy("l_orderkey")
    start = F.sum("q").over(w.orderBy("l_linenumber")) - F.col("q")
    early = ((F.col("l_partkey") % 11 == 0) & (F.col("l_linenumber") > 1)).cast("long")
    f = li.withColumns({"offset": start - early + F.when(F.col("l_orderkey") % 50 == 0, 8150).otherwise(0), "more": F.col("l_linenumber") < F.max("l_linenumber").over(w)})
    key = F.col("l_orderkey")
    return f.filter("l_partkey % 13 <> 0").select((key % 1000).alias("src"), (key % 7).alias("dst"), (key % 65536).alias("id"), "l_orderkey", "l_linenumber", "at", "offset", (F.col("q") * 8).alias("size"), "more")


FRAGMENTS = """fr0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS due,
         sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity::BIGINT - CASE WHEN l_partkey % 11 = 0 AND l_linenumber > 1 THEN 1 ELSE 0 END
           + CASE WHEN l_orderkey % 50 = 0 THEN 8150 ELSE 0 END AS off,
         l_linenumber < max(l_linenumber) OVER (PARTITION BY l_orderkey) AS more
  FROM lineitem),
fr AS (
  SELECT l_orderkey % 1000 AS src, l_orderkey % 7 AS dst, l_orderkey % 65536 AS id, l_orderkey, l_linenumber, due, off::BIGINT * 8 AS a, off::BIGINT * 8 + q * 8 AS b, q * 8 AS size, more,
         row_number() OVER (PARTITION BY l_orderkey % 1000, l_orderkey % 7, l_orderkey % 65536 ORDER BY due, l_orderkey, l_linenumber) AS k
  FROM fr0 WHERE l_partkey % 13 <> 0)"""

TRACKED = f"""{FRAGMENTS},
tr(src, dst, id, k, l_orderkey, l_linenumber, first, stored, total, fin, tiny, overlap, oversized, completed, expired, opened) AS (
  SELECT DISTINCT src, dst, id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::DOUBLE, []::BIGINT[][], 0::BIGINT, NULL::BIGINT, false, false, NULL::BIGINT, false, false, NULL::DOUBLE FROM fr
  UNION ALL
  SELECT src, dst, id, k, l_orderkey, l_linenumber, CASE WHEN whole THEN NULL ELSE opened END, CASE WHEN whole THEN [] ELSE st END, CASE WHEN whole THEN 0 ELSE total END,
         CASE WHEN whole THEN NULL ELSE fin END, tiny, overlap, CASE WHEN fin > {R.MAX_DATAGRAM} THEN fin WHEN total > {R.MAX_DATAGRAM} THEN total END, whole, expired, opened
  FROM (SELECT *, fin IS NOT NULL AND coalesce(list_sum(list_transform(st, lambda x: x[2] - x[1])), 0) = coalesce(list_max(list_transform(st, lambda x: x[2])), 0)
                  AND coalesce(list_max(list_transform(st, lambda x: x[2])), 0) >= fin AS whole
        FROM (SELECT *, CASE WHEN overlap THEN old ELSE list_append(old, [a, b]) END AS st
              FROM (SELECT *, len(list_filter(old, lambda x: a < x[2] AND b > x[1])) > 0 AS overlap
                    FROM (SELECT f.src, f.dst, f.id, f.k, f.l_orderkey, f.l_linenumber::BIGINT AS l_linenumber, f.a, f.b, coalesce(f.due - t.first > {R.FRAGMENT_TIMEOUT}, false) AS expired,
                                 CASE WHEN coalesce(f.due - t.first > {R.FRAGMENT_TIMEOUT}, true) THEN [] ELSE t.stored END AS old,
                                 CASE WHEN coalesce(f.due - t.first > {R.FRAGMENT_TIMEOUT}, true) THEN f.due ELSE t.first END AS opened,
                                 (CASE WHEN coalesce(f.due - t.first > {R.FRAGMENT_TIMEOUT}, true) THEN 0 ELSE t.total END) + f.size AS total,
                                 CASE WHEN NOT f.more THEN f.b WHEN coalesce(f.due - t.first > {R.FRAGMENT_TIMEOUT}, true) THEN NULL ELSE t.fin END AS fin,
                                 f.size < {R.MIN_FRAGMENT} AND f.more AS tiny
                          FROM tr t JOIN fr f ON f.src = t.src AND f.dst = t.dst AND f.id = t.id AND f.k = t.k + 1)))))"""


#: Lines of an order may share number and day, which the SQL leaves open; place and size decide, else results would depend on files.
ARRIVAL = ["at", "l_orderkey", "l_linenumber", "offset", "size"]


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    return R.track_fragments(fragments(spark, sf), ["src", "dst", "id"], ARRIVAL)


@register("I31_fragment_tracking", f"WITH RECURSIVE {TRACKED} SELECT l_orderkey, l_linenumber, tiny, overlap, oversized, completed, expired FROM tr WHERE k > 0")
def fragment_tracking(spark, sf):
    return tracked(spark, sf).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "tiny", "overlap", "oversized", "completed", "expired")


@register("D49_fragment_ratios", f"""WITH RECURSIVE {TRACKED}, ev AS (SELECT l_orderkey % 1000 AS src, count(*) AS packets FROM lineitem GROUP BY 1), fin AS (SELECT max(due) AS fin FROM fr),
 l AS (SELECT t.*, t.k = max(t.k) OVER (PARTITION BY src, dst, id) AS latest FROM tr t WHERE k > 0)
 SELECT src, round(count(*) / max(packets), 6) AS rate, round(count(*) FILTER (overlap) / count(*), 6) AS overlap,
        round((count(*) FILTER (expired) + count(*) FILTER (latest AND NOT completed AND fin.fin - opened > {R.FRAGMENT_TIMEOUT})) / count(*), 6) AS incomplete, round(count(*) FILTER (tiny) / count(*), 6) AS tiny
 FROM l JOIN ev USING (src), fin GROUP BY src""")
def fragment_ratios(spark, sf):
    t = tracked(spark, sf)
    w = Window.partitionBy("src", "dst", "id").orderBy(*map(F.desc, ARRIVAL))
    packets = T.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("src")).agg(F.count(F.lit(1)).alias("packets"))
    t = t.withColumn("latest", F.row_number().over(w) == 1).join(packets, "src")
    out = R.fragment_ratios(t, ["src"], fragments(spark, sf).agg(F.max("at").alias("at")), F.col("packets"))
    return out.select("src", *[F.round(c, 6).alias(c) for c in ("rate", "overlap", "incomplete", "tiny")])
