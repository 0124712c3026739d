"""Access-log lines behind a proxy: the fields, and the client's own address from the forwarded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookups import cidr_join, ip_to_long


def parse_proxy_log(lines: DataFrame, proxies: DataFrame, key: str, line: str = "value") -> DataFrame:
    """key, proxy_ip, real_ip, is_proxy, request, status, user_agent and effective_ip of each line; other lines are dropped.

    A line is `address - - [time] "request" status ...` with quoted fields behind it. The user agent is the last quoted
    field but one, the forwarded addresses the last one. They count where the first address is in a network of proxies(prefix,
    lo): the first of them that is an IPv4 address outside all networks is the client's. A status that is no number up to
    65535 is 0. key is unique. Each address looks networks up by equal keys (cidr_join); no list is broadcast.
    """
    text = F.col(line)
    cut = F.instr(text, " - - ")
    r = lines.filter((cut > 0)).select(F.col(key), F.trim(F.substring(text, F.lit(1), cut - 1)).alias("proxy_ip"), F.split(F.substring(text, cut + 5, F.length(text)), '"').alias("__f"))
    r = r.withColumn("__n", F.floor((F.size("__f") - 1) / 2)).filter((F.col("__n") >= 1) & ip_to_long(F.col("proxy_ip")).isNotNull())
    field = lambda back: F.when(F.col("__n") >= back, F.get("__f", (2 * (F.col("__n") - back) + 1).cast("int")))
    status = F.regexp_extract(F.substring(F.get("__f", F.lit(2)), 2, 1 << 20), r"^\s*(\S+)", 1).try_cast("int")
    r = r.withColumns({
        "request": F.get("__f", F.lit(1)), "status": F.when(status.between(0, 65_535), status).otherwise(0), "user_agent": F.coalesce(field(2), F.lit("")),
        "__ips": F.transform(F.split(F.coalesce(field(1), F.lit("")), ","), lambda x: F.trim(x)),
    }).drop("__f", "__n")
    each = r.select(key, F.posexplode(F.concat(F.array("proxy_ip"), F.col("__ips"))).alias("__at", "__ip")).withColumn("__num", ip_to_long(F.col("__ip"))).filter("__num IS NOT NULL")
    known = cidr_join(each, "__num", proxies.select("prefix", "lo"))
    own = F.min(F.when((F.col("__at") > 0) & F.col("prefix").isNull(), F.struct("__at", "__ip"))).alias("__first")
    found = known.groupBy(F.col(key).alias("__key")).agg(F.max(F.when(F.col("__at") == 0, F.col("prefix").isNotNull())).alias("is_proxy"), own)
    out = r.join(found, F.col(key) == F.col("__key"))
    real = F.when(F.col("is_proxy"), F.col("__first.__ip"))
    return out.select(key, "proxy_ip", real.alias("real_ip"), "is_proxy", "request", "status", "user_agent", F.coalesce(real, F.col("proxy_ip")).alias("effective_ip"))
