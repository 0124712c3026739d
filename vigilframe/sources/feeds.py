"""Readers of text and CSV inputs: logs, indicator feeds, ground truth, flow records, rule files, settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import textscan as S

IOC = ["value", "ioc_type", "source", "category", "severity"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines without comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' AND NOT value LIKE '#%' AND NOT value LIKE ';%'")


def _ioc(df: DataFrame, kind, source: str, category: str, severity: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("value", kind.alias("ioc_type"), F.lit(source).alias("source"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))


def spamhaus(spark: SparkSession, path: str) -> DataFrame:
    """`CIDR ; SBL` lines."""
    return _ioc(lines(spark, path).select(F.trim(F.split("value", ";")[0]).alias("value")), "cidr", "spamhaus", "spam", "high")


def plain_ips(spark: SparkSession, path: str, source: str = "et", category: str = "malicious", severity: str = "high") -> DataFrame:
    """One address or network a line."""
    df = lines(spark, path)
    return _ioc(df, F.when(F.col("value").contains("/"), "cidr").otherwise("ip"), source, category, severity)


def _csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    return spark.read.option("comment", "#").option("quote", '"').schema(", ".join(f"c{i} string" for i in range(columns))).csv(path)


def urlhaus(spark: SparkSession, path: str) -> DataFrame:
    return _ioc(_csv(spark, path, 9).select(F.col("c2").alias("value")).filter("value IS NOT NULL"), "url", "urlhaus", "malware", "high")


def sslbl(spark: SparkSession, path: str) -> DataFrame:
    return _ioc(_csv(spark, path, 3).select(F.lower(F.trim("c1")).alias("value")).filter("length(value) = 40"), "cert_sha1", "sslbl", "c2", "high")


def feodo(spark: SparkSession, path: str) -> DataFrame:
    return _ioc(_csv(spark, path, 6).select(F.trim("c1").alias("value")).filter(F.col("value").rlike(r"^[0-9.]+$")), "ip", "feodo", "c2", "critical")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All indicators; of equal type and value the last by source name stays."""
    every = reduce(DataFrame.unionByName, feeds)
    last = every.groupBy("ioc_type", "value").agg(F.max_by(F.struct("source", "category", "severity"), "source").alias("v"))
    return last.select("value", "ioc_type", "v.source", "v.category", "v.severity")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).filter(F.col("value").rlike(r"^[0-9a-fA-F.:/]+$")).select(F.col("value").alias("ip")).distinct()


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, src_ip, dst_ip, attack_type, severity; header lines and rows without an address are dropped, an unknown severity is medium."""
    df = spark.read.schema("ts string, src_ip string, dst_ip string, attack_type string, severity string").csv(path)
    known = F.lower("severity").isin("info", "low", "medium", "high", "critical")
    return df.filter(~F.lower(F.coalesce("ts", F.lit(""))).contains("timestamp") & F.col("src_ip").rlike(r"^\d+\.\d+\.\d+\.\d+$") & F.col("attack_type").isNotNull()).select(
        F.timestamp_seconds(F.col("ts").try_cast("double")).alias("ts"), "src_ip", F.nullif("dst_ip", F.lit("")).alias("dst_ip"), "attack_type", F.when(known, F.lower("severity")).otherwise("medium").alias("severity"))


def cicids(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow rows of at least 84 columns: source, destination, label."""
    df = spark.read.text(path).select(F.split("value", ",").alias("c")).filter("size(c) >= 84")
    label = F.upper(F.trim(F.col("c")[83]))
    return df.select(F.trim(F.col("c")[1]).alias("src_ip"), F.trim(F.col("c")[3]).alias("dst_ip"), label.alias("label"), (label != "BENIGN").alias("attack")).filter("label <> 'LABEL'")


NETFLOW = "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, L4_SRC_PORT int, L4_DST_PORT int, PROTOCOL int, L7_PROTO double, IN_BYTES long, IN_PKTS long, OUT_BYTES long, OUT_PKTS long, TCP_FLAGS int, FLOW_DURATION_MILLISECONDS long, Label int, Attack string"


def netflow(spark: SparkSession, path: str) -> DataFrame:
    """Header-mapped flow records under this library's flow names; unknown columns are ignored."""
    found = [c.strip() for c in spark.read.text(path).first()[0].split(",")]
    types = dict(x.split(" ") for x in NETFLOW.split(", "))
    df = spark.read.option("header", True).schema(", ".join(f"`{c}` {types.get(c, 'string')}" for c in found)).csv(path)
    names = {"IPV4_SRC_ADDR": "client_ip", "IPV4_DST_ADDR": "server_ip", "L4_SRC_PORT": "client_port", "L4_DST_PORT": "server_port", "PROTOCOL": "proto", "IN_BYTES": "fwd_bytes", "IN_PKTS": "fwd_packets", "OUT_BYTES": "bwd_bytes", "OUT_PKTS": "bwd_packets", "TCP_FLAGS": "flags", "FLOW_DURATION_MILLISECONDS": "duration_ms", "Label": "label", "Attack": "attack"}
    return df.select(*[F.col(k).alias(v) if k in found else F.lit(None).cast(types[k]).alias(v) for k, v in names.items()])


def service_log(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Lines of service logs that name an attacker: time, service, event type, address, line."""
    df = spark.read.text(path).withColumn("m", S.match_log(F.col("value"))).filter("m IS NOT NULL")
    return df.select(S.syslog_time(F.col("value"), year).alias("ts"), "m.service", "m.event_type", "m.ip", F.trim("value").alias("log_line"))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path).withColumn("a", S.access_log(F.col("value"))).filter("a IS NOT NULL")
    return df.select("a.*")


def port_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Kernel firewall lines marked SCAN: address, port, kind."""
    df = spark.read.text(path).filter(F.col("value").contains("SCAN"))
    g = lambda p: F.regexp_extract("value", p, 1)
    return df.select(g(r"SRC=([0-9.]+)").alias("ip"), g(r"DPT=(\d+)").try_cast("int").alias("port"), F.lower(g(r"(\w+)[ _-]?SCAN")).alias("kind")).filter("ip <> ''")


def rules(spark: SparkSession, path: str, variables: dict[str, str] | None = None, disabled: list[int] | None = None) -> DataFrame:
    """Rule files (a file, a folder or a glob); listed sids are disabled."""
    r = R.parse_rules(spark.read.text(path), variables=variables)
    off = F.col("sid").isin(disabled) if disabled else F.lit(False)
    return r.withColumn("enabled", ~off)


def classifications(spark: SparkSession, path: str) -> DataFrame:
    """`config classification: short,description,priority` lines."""
    p = r"^config classification:\s*([^,]+),([^,]+),\s*(\d+)"
    df = spark.read.text(path).filter(F.col("value").rlike(p))
    return df.select(*[F.trim(F.regexp_extract("value", p, i)).alias(n) for i, n in ((1, "classtype"), (2, "description"))], F.regexp_extract("value", p, 3).cast("int").alias("priority"))


HTTP_FILE = "patterns map<string, struct<severity: string, action: string, description: string, patterns: array<string>, regex: array<string>>>"


def http_patterns(spark: SparkSession, path: str) -> DataFrame:
    """category, severity, action, patterns, regex: one row per category of a JSON file of HTTP attack patterns."""
    df = spark.read.schema(HTTP_FILE).option("multiLine", True).json(path).select(F.explode("patterns").alias("category", "p"))
    none = F.array().cast("array<string>")
    return df.select("category", F.lower("p.severity").alias("severity"), "p.action", F.coalesce("p.patterns", none).alias("patterns"), F.coalesce("p.regex", none).alias("regex"))
