"""Queries over the link-layer and routing detectors with their default limits; only the mapping from `events` is made up here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link_layer as N
from ..sources import tables as T
from .registry import register

#: One second of a frame's time stands for ten hours of the table's, so that windows of seconds hold events.
SPAN = 36_000
#: Which routers, origins and keys are known in these queries.
KNOWN = [0, 1, 2, 3, 4, 5]
F_SQL = f"f AS (SELECT event_id, epoch_us(ts) // {SPAN} AS us, user_id, port, port % 5 AS k, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'n' || port END AS name, severity, value FROM det)"
LISTED = ", ".join(map(str, KNOWN))


def frames(spark, sf):
    name = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("n"), F.col("port").cast("string")))
    us = F.floor(F.unix_micros("ts") / SPAN).cast("long")
    return T.detections(spark, sf).select("event_id", us.alias("us"), "user_id", "port", (F.col("port") % 5).alias("k"), name.alias("name"), "severity", "value")


def now(df) -> int:
    """The last time in the table; 0 where it is empty."""
    return df.agg(F.max("us")).first()[0] or 0


def windowed(seconds: int, where: str = "true") -> str:
    """SQL: rows of f with the time their window opened, as `a`."""
    w = seconds * N.SECOND
    return f"""WITH RECURSIVE {T.DETECTIONS}, {F_SQL}, g AS (SELECT * FROM f WHERE {where}), o(k, at_us) AS (SELECT k, min(us) FROM g GROUP BY 1 UNION ALL SELECT o.k, min(g.us) FROM o JOIN g ON g.k = o.k AND g.us > o.at_us + {w} GROUP BY o.k, o.at_us),
 a AS (SELECT g.*, o.at_us AS opened FROM g ASOF JOIN o ON g.k = o.k AND g.us >= o.at_us)"""


@register("I42_rate_floods", f"{windowed(5, 'severity >= 1')}, r AS (SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) / greatest((us - opened) / 1000000, 0.1::DOUBLE) AS rate FROM a) SELECT event_id, round(rate, 6) AS rate FROM r WHERE rate > 10")
def rate_floods(spark, sf):
    return N.rate_flood(frames(spark, sf).filter("severity >= 1"), ["k"]).select("event_id", F.round("rate", 6).alias("rate"))


def seen_sql(seconds, limit, value="name"):
    return f"{windowed(seconds)}, p AS (SELECT *, CASE WHEN CAST({value} AS VARCHAR) <> '' AND row_number() OVER (PARTITION BY k, opened, {value} ORDER BY us, event_id) = 1 THEN 1 ELSE 0 END AS fst FROM a), s AS (SELECT event_id, CAST(sum(fst) OVER (PARTITION BY k, opened ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen FROM p) SELECT event_id, seen FROM s WHERE seen > {limit}"


@register("I43_beacon_names", seen_sql(60, 10))
def beacon_names(spark, sf):
    """The limit of probe responses, 10; beacons take 20."""
    return N.distinct_flood(frames(spark, sf), ["k"], "name", 10).select("event_id", "seen")


@register("I29_address_starvation", seen_sql(60, 49, "user_id"))
def address_starvation(spark, sf):
    return N.distinct_flood(frames(spark, sf), ["k"], "user_id", 49).select("event_id", "seen")


@register("I29_rogue_servers", f"WITH {T.DETECTIONS}, {F_SQL} SELECT event_id FROM f WHERE user_id NOT IN ({LISTED})")
def rogue_servers(spark, sf):
    known = spark.createDataFrame([(k,) for k in KNOWN], "server long")
    return N.strangers(frames(spark, sf), "user_id", known, "server").select("event_id")


@register("I30_advertisement_floods", f"{windowed(60)}, r AS (SELECT event_id, us - opened AS age, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) AS place FROM a) SELECT event_id, round(CASE WHEN age > 0 THEN place / (age / 1000000) ELSE place END, 6) AS rate FROM r WHERE place >= 10")
def advertisement_floods(spark, sf):
    return N.count_flood(frames(spark, sf), ["k"]).select("event_id", F.round("rate", 6).alias("rate"))


@register("I44_evil_twins", f"""WITH RECURSIVE {T.DETECTIONS}, {F_SQL}, g AS (SELECT event_id, us, name || ':' || user_id AS k FROM f WHERE name <> '' AND user_id NOT IN ({LISTED}) AND user_id <> port),
 o(k, at_us) AS (SELECT k, min(us) FROM g GROUP BY 1 UNION ALL SELECT o.k, min(g.us) FROM o JOIN g ON g.k = o.k AND g.us >= o.at_us + 60000000 GROUP BY o.k, o.at_us) SELECT min(event_id) AS event_id FROM o JOIN g ON g.k = o.k AND g.us = o.at_us GROUP BY o.k, o.at_us""")
def evil_twins(spark, sf):
    known = spark.range(100).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("ssid"), F.col("id").alias("owner"))
    trusted = spark.createDataFrame([(k,) for k in KNOWN], "bssid long")
    f = frames(spark, sf).select("event_id", "us", F.col("name").alias("ssid"), F.col("user_id").alias("bssid"))
    return N.evil_twins(f, known, trusted).select("event_id")


EXCHANGE = f"WITH RECURSIVE {T.DETECTIONS}, {F_SQL}, g AS (SELECT event_id, us, k, CAST(event_id % 4 + 1 AS INTEGER) AS msg, event_id % 3 = 0 AS pmkid, port // 10 AS counter, user_id % 20 AS nonce, row_number() OVER (PARTITION BY k ORDER BY us, event_id) AS rn FROM f)"


def exchange(spark, sf):
    return frames(spark, sf).select("event_id", "us", "k", (F.col("event_id") % 4 + 1).cast("int").alias("msg"), (F.col("event_id") % 3 == 0).alias("pmkid"), F.floor(F.col("port") / 10).alias("counter"), (F.col("user_id") % 20).alias("nonce"))


@register("I45_key_captures", f"""{EXCHANGE}, st(k, rn, first, mask, had, event_id, alert) AS (SELECT k, 0::BIGINT, min(us), 0, false, NULL::BIGINT, NULL::VARCHAR FROM g GROUP BY 1 UNION ALL
 SELECT k, rn, first, CASE WHEN alert = 'HandshakeCapture' THEN 0 ELSE mask END, had OR (msg = 1 AND pmkid), event_id, alert FROM (
  SELECT *, CASE WHEN msg = 1 AND pmkid AND NOT had THEN 'PmkidCapture' WHEN mask = 15 THEN 'HandshakeCapture' END AS alert FROM (
   SELECT g.k, g.rn, g.msg, g.pmkid, g.event_id, CASE WHEN g.us - first > 30000000 THEN g.us ELSE first END AS first, (CASE WHEN g.us - first > 30000000 THEN 0 ELSE mask END) | (1 << (g.msg - 1)) AS mask, had AND g.us - first <= 30000000 AS had FROM st JOIN g ON g.k = st.k AND g.rn = st.rn + 1))) SELECT event_id, alert FROM st WHERE alert IS NOT NULL""")
def key_captures(spark, sf):
    from ..operators import stateful as S

    return S.fold(exchange(spark, sf), ["k"], lambda: N.Handshake(30 * N.SECOND), "alert", "string").filter("alert IS NOT NULL").select("event_id", "alert")


@register("I46_reinstallations", f"""{EXCHANGE}, st(k, rn, first, n, last, nonces, event_id, alert) AS (SELECT k, 0::BIGINT, min(us), 0, 0::BIGINT, []::BIGINT[], NULL::BIGINT, false FROM g GROUP BY 1 UNION ALL
 SELECT k, rn, first, CASE WHEN early OR msg <> 3 OR again THEN n WHEN n + 1 >= 3 THEN 0 ELSE n + 1 END, CASE WHEN early THEN last ELSE counter END,
  CASE WHEN early OR msg <> 3 OR again THEN nonces ELSE list_append(nonces, nonce)[-10:] END, event_id, early OR (msg = 3 AND (again OR n + 1 >= 3)) FROM (
  SELECT *, msg = 3 AND counter <> 0 AND counter <= last AS early, list_contains(nonces, nonce) AS again FROM (
   SELECT g.*, CASE WHEN late THEN g.us ELSE first END AS first, CASE WHEN late THEN 0 ELSE n END AS n, CASE WHEN late THEN 0 ELSE last END AS last, CASE WHEN late THEN [] ELSE nonces END AS nonces
   FROM (SELECT st.*, g2.us - st.first > 60000000 AS late FROM st JOIN g g2 ON g2.k = st.k AND g2.rn = st.rn + 1) s JOIN g ON g.k = s.k AND g.rn = s.rn + 1))) SELECT event_id FROM st WHERE alert""")
def reinstallations(spark, sf):
    from ..operators import stateful as S

    return S.fold(exchange(spark, sf), ["k"], lambda: N.Reinstall(60 * N.SECOND, 3)).filter("fired").select("event_id")


UPDATES = f"WITH {T.DETECTIONS}, {F_SQL}, u AS (SELECT event_id, us, port AS prefix, event_id % 4 <> 0 AS announced, user_id % 9 AS origin FROM f)"


def updates(spark, sf):
    return frames(spark, sf).select("event_id", "us", F.col("port").alias("prefix"), (F.col("event_id") % 4 != 0).alias("announced"), (F.col("user_id") % 9).alias("origin"))


@register("I36_route_hijacks", f"{UPDATES}, l AS (SELECT event_id, origin, lag(origin) OVER (PARTITION BY prefix ORDER BY us, event_id) AS was FROM u WHERE announced) SELECT event_id, was FROM l WHERE (was <> origin AND (origin NOT IN ({LISTED}) OR was IN ({LISTED}))) OR (was IS NULL AND origin NOT IN ({LISTED}))")
def route_hijacks(spark, sf):
    return N.origin_alerts(updates(spark, sf), KNOWN).select("event_id", "was")


@register("I36_route_flaps", f"{UPDATES}, l AS (SELECT *, count(*) FILTER (announced) OVER (PARTITION BY prefix ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) > 0 AS live FROM u), s AS (SELECT prefix, count(*) FILTER (live) AS changes, max(us) FILTER (announced) AS last FROM l GROUP BY 1) SELECT prefix, changes FROM s WHERE changes >= 5 AND (SELECT max(us) FROM u) - last < 60000000")
def route_flaps(spark, sf):
    u = updates(spark, sf)
    return N.flapping(u, now(u))


@register("I39_ospf", f"WITH {T.DETECTIONS}, {F_SQL}, x AS (SELECT event_id, [CASE WHEN severity = 0 THEN 'NoAuthentication' END, CASE WHEN user_id % 8 NOT IN ({LISTED}) THEN 'NeighborInjection' END, CASE WHEN event_id % 2 = 0 AND port % 7 <> 3 AND port % 7 <> 0 THEN 'DrManipulation' END] AS l FROM f) SELECT event_id, unnest(list_filter(l, lambda v: v IS NOT NULL)) AS alert FROM x")
def ospf(spark, sf):
    f = frames(spark, sf)
    dr = F.when(F.col("event_id") % 2 == 0, F.col("port") % 7)
    return f.select("event_id", F.explode(N.ospf_alerts(F.col("user_id") % 8, F.col("severity"), dr, F.lit(3), KNOWN)).alias("alert"))


@register("I39_hello_flood", f"WITH {T.DETECTIONS}, {F_SQL}, s AS (SELECT k AS router, count(*) AS hellos, max(us) AS last FROM f GROUP BY 1) SELECT router, hellos FROM s WHERE hellos > 100 AND (SELECT max(us) FROM f) - last < 10000000")
def hello_flood(spark, sf):
    f = frames(spark, sf)
    return N.hello_flood(f.select(F.col("k").alias("router"), "us"), now(f))


@register("I39_rip", f"WITH {T.DETECTIONS}, {F_SQL}, x AS (SELECT event_id, [CASE WHEN user_id % 8 NOT IN ({LISTED}) THEN 'Injection' END, CASE WHEN severity < 3 AND port % 18 >= 16 THEN 'RoutePoisoning' END, CASE WHEN severity < 3 AND port % 18 = 0 THEN 'MetricZero' END] AS l FROM f) SELECT event_id, unnest(list_filter(l, lambda v: v IS NOT NULL)) AS alert FROM x")
def rip(spark, sf):
    family = F.when(F.col("severity") < 3, 2).otherwise(0)
    return frames(spark, sf).select("event_id", F.explode(N.rip_alerts(F.col("user_id") % 8, family, F.col("port") % 18, KNOWN)).alias("alert"))


@register("I40_tunnels", f"WITH {T.DETECTIONS}, {F_SQL}, x AS (SELECT event_id, [CASE WHEN user_id % 8 NOT IN ({LISTED}) AND user_id >= 50 THEN 'Endpoint' END, CASE WHEN event_id % 3 > 0 AND port NOT IN ({LISTED}) THEN 'Key' END] AS l FROM f) SELECT event_id, unnest(list_filter(l, lambda v: v IS NOT NULL)) AS alert FROM x")
def tunnels(spark, sf):
    key = F.when(F.col("event_id") % 3 > 0, F.col("port"))
    return frames(spark, sf).select("event_id", F.explode(N.tunnel_alerts(F.col("user_id") % 8, F.col("user_id") < 50, key, KNOWN, KNOWN)).alias("alert"))


@register("I40_network_enumeration", f"WITH {T.DETECTIONS}, {F_SQL} SELECT user_id % 50 AS src, k AS dst, count(DISTINCT port) AS vnis FROM f GROUP BY 1, 2 HAVING count(DISTINCT port) > 10")
def network_enumeration(spark, sf):
    return N.vni_enumeration(frames(spark, sf).select((F.col("user_id") % 50).alias("src"), F.col("k").alias("dst"), F.col("port").alias("vni")))


@register("I33_incomplete_groups", f"WITH {T.DETECTIONS}, {F_SQL}, d AS (SELECT k, event_id // 4 AS id, min(us) AS first_us, count(*) AS fragments, max(severity) = 3 AS complete FROM f GROUP BY 1, 2), s AS (SELECT k, count(*) FILTER (NOT complete) AS incomplete, sum(fragments) / greatest(((SELECT max(us) FROM f) - min(first_us) FILTER (NOT complete)) / 1000000, 1.0::DOUBLE) AS rate FROM d GROUP BY 1) SELECT k, incomplete, round(rate, 6) AS rate FROM s WHERE incomplete > 100 AND rate > 0.5")
def incomplete_groups(spark, sf):
    f = frames(spark, sf)
    d = f.groupBy("k", F.floor(F.col("event_id") / 4).alias("id")).agg(F.min("us").alias("first_us"), F.count(F.lit(1)).alias("fragments"), (F.max("severity") == 3).alias("complete"))
    return N.fragment_flood(d, ["k"], now(f), 0.5).select("k", "incomplete", F.round("rate", 6).alias("rate"))
