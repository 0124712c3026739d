"""Input tables, and the telemetry views that queries derive from the given tables.

No given table holds packets or detections, so `events` stands for both: a user is a source address, the number in
`props` picks the service, and the event id fixes direction and TCP flags. Each view has a DuckDB twin under the same
name in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Server ports of the ten services, and the TCP flag bytes that packets cycle through.
SERVICE_PORTS = (22, 53, 80, 123, 443, 445, 1900, 3306, 3389, 8080)
UDP_PORTS = (53, 123, 1900)
FLAG_CYCLE = (2, 18, 16, 24, 17, 4, 0, 41)
CLIENT_BASE, SERVER_BASE = 3232235520, 167772160  # 192.168.0.0 and 10.0.0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        severity.alias("severity"), F.get_json_object("props", "$.k").cast("int").alias("port"), "value", F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"),
    )


DETECTIONS = """det AS (
  SELECT event_id, 'u' || user_id AS src, user_id, ts, event_type,
         CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS severity,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS port, value, least(1.0, value / 500) AS confidence
  FROM events)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumns({"k": k, "svc": F.floor(k / 10).cast("int")})
    icmp = F.col("k") % 10 == 9
    back = F.col("event_id") % 3 == 0
    client, server = F.lit(CLIENT_BASE).cast("long") + F.col("user_id"), F.lit(SERVER_BASE).cast("long") + F.col("svc")
    port = pick(F.col("svc"), SERVICE_PORTS)
    proto = F.when(icmp, 1).when(port.isin(*UDP_PORTS), 17).otherwise(6)
    e = e.withColumns({"proto": proto, "cport": F.when(icmp, 0).otherwise((F.lit(40000) + F.col("user_id")).cast("int")), "vport": F.when(icmp, 0).otherwise(port)})
    return e.select(
        F.col("event_id").alias("packet_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(back, server).otherwise(client).alias("src_num"), F.when(back, client).otherwise(server).alias("dst_num"),
        F.when(back, F.col("vport")).otherwise(F.col("cport")).alias("src_port"), F.when(back, F.col("cport")).otherwise(F.col("vport")).alias("dst_port"),
        "proto", F.when(F.col("proto") == 6, pick(F.col("event_id") % 8, FLAG_CYCLE)).otherwise(0).alias("flags"),
        F.floor("value").cast("int").alias("size"), (F.lit(64) - F.col("event_id") % 3).cast("int").alias("ttl"), "user_id",
    )


PACKETS = f"""ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS svc FROM events),
ev2 AS (
  SELECT *, CASE WHEN k % 10 = 9 THEN 0 ELSE CAST(40000 + user_id AS INTEGER) END AS cport,
         CASE WHEN k % 10 = 9 THEN 0 ELSE list_extract([{", ".join(map(str, SERVICE_PORTS))}], svc + 1) END AS vport,
         CASE WHEN k % 10 = 9 THEN 1 WHEN list_extract([{", ".join(map(str, SERVICE_PORTS))}], svc + 1) IN ({", ".join(map(str, UDP_PORTS))}) THEN 17 ELSE 6 END AS proto
  FROM ev),
pkt AS (
  SELECT event_id AS packet_id, ts,
         CASE WHEN event_id % 3 = 0 THEN {SERVER_BASE} + svc ELSE {CLIENT_BASE} + user_id END AS src_num,
         CASE WHEN event_id % 3 = 0 THEN {CLIENT_BASE} + user_id ELSE {SERVER_BASE} + svc END AS dst_num,
         CASE WHEN event_id % 3 = 0 THEN vport ELSE cport END AS src_port, CASE WHEN event_id % 3 = 0 THEN cport ELSE vport END AS dst_port,
         proto, CASE WHEN proto = 6 THEN list_extract([{", ".join(map(str, FLAG_CYCLE))}], event_id % 8 + 1) ELSE 0 END AS flags,
         CAST(floor(value) AS INTEGER) AS size, CAST(64 - event_id % 3 AS INTEGER) AS ttl, user_id
  FROM ev2)"""


def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as bans: the customer is the address, a ban lasts as many hours as its price in thousands, urgent ones never end."""
    o = table(spark, sf_dir, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    hours = F.floor(F.col("o_totalprice") / 1000).cast("int")
    expires = F.when(~F.col("o_orderpriority").startswith("1"), F.timestamp_seconds(F.unix_seconds(created) + hours * 3600))
    return o.select(F.col("o_orderkey").alias("ban_id"), F.col("o_custkey").alias("ip"), F.col("o_orderpriority").alias("reason"), F.col("o_orderstatus").alias("source"), created.alias("created_at"), expires.alias("expires_at"))


BANS = """bans AS (
  SELECT o_orderkey AS ban_id, o_custkey AS ip, o_orderpriority AS reason, o_orderstatus AS source, o_orderdate AS created_at,
         CASE WHEN NOT starts_with(o_orderpriority, '1') THEN o_orderdate + to_hours(CAST(floor(o_totalprice / 1000) AS BIGINT)) END AS expires_at
  FROM orders)"""


def intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`nation` with `region` as address intelligence: one row per user modulo 25; two nations have no country code."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").alias("ip_key"), F.when(F.col("n_nationkey") % 11 != 10, F.col("n_name")).alias("country_code"), F.col("r_name").alias("as_org"), (F.col("n_nationkey") * 4).alias("threat_score"))


INTEL = """intel AS (
  SELECT n_nationkey AS ip_key, CASE WHEN n_nationkey % 11 <> 10 THEN n_name END AS country_code, r_name AS as_org, n_nationkey * 4 AS threat_score
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

#: What "now" is in queries on bans and on events.
NOW_BANS, NOW_EVENTS = "2000-01-01 00:00:00", "2024-01-31 00:00:00"
