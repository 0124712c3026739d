"""Floods, spoofed routers and captures seen on links: windows that open at an event, running counts, lists of what is known.

Times are microseconds in `us`; `event_id` breaks ties. Limits are parameters with the usual defaults. A window opens at
the first event of its keys and is replaced by the first event more than its length later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stateful as S

SECOND = 1_000_000


class Opened:
    """The time at which the window of an event opened."""

    closed = True

    def of(self, window: Column, place: Column, opened: Column) -> Column:
        return opened

    def __init__(self, window_us: int):
        self.window, self.first = window_us, None

    def __call__(self, row: dict) -> int:
        if self.first is None or row["us"] - self.first > self.window:
            self.first = row["us"]
        return self.first


class Handshake:
    """Capture of a key exchange: the first PMKID of message 1 in a window, and all four messages seen, which starts over."""

    def __init__(self, window_us: int):
        self.window, self.first, self.mask, self.pmkid = window_us, None, 0, False

    def __call__(self, row: dict) -> str | None:
        if self.first is None or row["us"] - self.first > self.window:
            self.first, self.mask, self.pmkid = row["us"], 0, False
        self.mask |= 1 << (row["msg"] - 1)
        if row["msg"] == 1 and row["pmkid"] and not self.pmkid:
            self.pmkid = True
            return "PmkidCapture"
        if self.mask == 15:
            self.mask = 0
            return "HandshakeCapture"
        return None


class Reinstall:
    """Message 3 with a counter that does not rise or a nonce among its last ten, or its third time; then counting starts over."""

    def __init__(self, window_us: int, limit: int):
        self.window, self.limit, self.first = window_us, limit, None

    def __call__(self, row: dict) -> bool:
        if self.first is None or row["us"] - self.first > self.window:
            self.first, self.count, self.last, self.nonces = row["us"], 0, 0, []
        third = row["msg"] == 3
        if third and row["counter"] != 0 and row["counter"] <= self.last:
            return True
        self.last = row["counter"]
        if not third:
            return False
        if row["nonce"] in self.nonces:
            return True
        self.nonces = [*self.nonces, row["nonce"]][-10:]
        self.count += 1
        if self.count >= self.limit:
            self.count = 0
            return True
        return False


def opened(df: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    return S.fold(df, keys, lambda: Opened(window_us), "opened", "bigint")


def rate_flood(frames: DataFrame, keys: list[str], per_second: float = 10.0, window_us: int = 5 * SECOND) -> DataFrame:
    """Frames at which their window's count by its age in seconds (a tenth at least) exceeds a rate: deauthentication, disassociation."""
    place = F.row_number().over(Window.partitionBy(*keys, "opened").orderBy("us", "event_id"))
    rate = place / F.greatest((F.col("us") - F.col("opened")) / SECOND, F.lit(0.1))
    return opened(frames, keys, window_us).withColumn("rate", rate).filter(F.col("rate") > per_second)


def distinct_flood(frames: DataFrame, keys: list[str], value: str, limit: int, window_us: int = 60 * SECOND) -> DataFrame:
    """Frames with `seen`, the distinct non-empty values so far in their window, where it is above limit.

    Beacons of one sender with over 20 names, probe responses of one station with over 10, requests of over 49 hardware
    addresses. A value counts where it first stands, so nothing gathers a set.
    """
    first = (F.row_number().over(Window.partitionBy(*keys, "opened", value).orderBy("us", "event_id")) == 1) & (F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    running = Window.partitionBy(*keys, "opened").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return opened(frames, keys, window_us).withColumn("first", first.cast("long")).withColumn("seen", F.sum("first").over(running)).drop("first").filter(F.col("seen") > limit)


def count_flood(frames: DataFrame, keys: list[str], limit: int = 10, window_us: int = 60 * SECOND) -> DataFrame:
    """Frames that are the limit-th or later of their window, with `rate` a second: router advertisements."""
    place = F.row_number().over(Window.partitionBy(*keys, "opened").orderBy("us", "event_id"))
    age = (F.col("us") - F.col("opened")) / SECOND
    d = opened(frames, keys, window_us).withColumn("place", place).filter(F.col("place") >= limit)
    return d.withColumn("rate", F.when(age > 0, F.col("place") / age).otherwise(F.col("place").cast("double"))).drop("place")


def strangers(frames: DataFrame, sender: str, known: DataFrame, name: str) -> DataFrame:
    """Frames of senders that are not known; none where nobody is known: rogue servers, spoofed routers."""
    some = known.select(F.lit(True).alias("__some")).limit(1)
    away = frames.join(known.select(F.col(name).alias(sender)), sender, "left_anti")
    return away.join(F.broadcast(some)).drop("__some")  # one row


def evil_twins(frames: DataFrame, known: DataFrame, trusted: DataFrame, quiet_us: int = 60 * SECOND) -> DataFrame:
    """Frames that announce a known name from another station, not trusted; told again after quiet_us. known: ssid, owner."""
    odd = frames.filter("ssid <> ''").join(trusted.select("bssid"), "bssid", "left_anti").join(known.select("ssid", "owner"), "ssid").filter("bssid <> owner")
    return S.fold(odd, ["ssid", "bssid"], lambda: S.FirstSeen(quiet_us), "told").filter("told").drop("told")


def origin_alerts(updates: DataFrame, known: list[int]) -> DataFrame:
    """Announcements whose origin differs from the prefix's last one (`was`), unless it is known and the last was not; new prefixes of unknown origins."""
    was = F.lag("origin").over(Window.partitionBy("prefix").orderBy("us", "event_id"))
    d = updates.filter("announced AND origin IS NOT NULL").withColumn("was", was)
    changed = (F.col("was") != F.col("origin")) & (~F.col("origin").isin(known) | F.col("was").isin(known))
    new = F.col("was").isNull() & F.lit(bool(known)) & ~F.col("origin").isin(known)
    return d.filter(changed | new)


def flapping(updates: DataFrame, now_us: int, limit: int = 5, within_us: int = 60 * SECOND) -> DataFrame:
    """Prefixes with limit announcements and withdrawals or more, the last announced less than within_us ago; withdrawals count once announced."""
    before = F.count_if("announced").over(Window.partitionBy("prefix").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)) > 0
    g = updates.withColumn("live", before).groupBy("prefix").agg(F.count_if("live").alias("changes"), F.max(F.when(F.col("announced"), F.col("us"))).alias("last"))
    return g.filter((F.col("changes") >= limit) & (F.lit(now_us) - F.col("last") < within_us)).select("prefix", "changes")


def ospf_alerts(router: Column, auth: Column, dr: Column, expected_dr: Column, known: list[int], require_auth: bool = True) -> Column:
    """Alerts of an OSPF packet; dr is null where it is no Hello, 0 where none is claimed."""
    return F.array_compact(F.array(
        F.when(F.lit(require_auth) & (auth == 0), "NoAuthentication"), F.when(F.lit(bool(known)) & ~router.isin(known), "NeighborInjection"),
        F.when((dr != expected_dr) & (dr != 0), "DrManipulation")))


def hello_flood(hellos: DataFrame, now_us: int, limit: int = 100, within_us: int = 10 * SECOND) -> DataFrame:
    """Routers with more than limit hellos in all, the last less than within_us ago."""
    g = hellos.groupBy("router").agg(F.count(F.lit(1)).alias("hellos"), F.max("us").alias("last"))
    return g.filter((F.col("hellos") > limit) & (F.lit(now_us) - F.col("last") < within_us)).select("router", "hellos")


def rip_alerts(source: Column, family: Column, metric: Column, known: list[int]) -> Column:
    """Alerts of one route entry: an unknown source, a metric of 16 or more, a metric of 0."""
    return F.array_compact(F.array(F.when(F.lit(bool(known)) & ~source.isin(known), "Injection"), F.when((family == 2) & (metric >= 16), "RoutePoisoning"), F.when((family == 2) & (metric == 0), "MetricZero")))


def tunnel_alerts(dst: Column, internal: Column, key: Column, endpoints: list[int], keys: list[int]) -> Column:
    """Alerts of a GRE or VXLAN packet: an endpoint or a key that is not authorised. Empty lists allow all."""
    return F.array_compact(F.array(F.when(F.lit(bool(endpoints)) & ~dst.isin(endpoints) & ~internal, "Endpoint"), F.when(F.lit(bool(keys)) & key.isNotNull() & ~key.isin(keys), "Key")))


def vni_enumeration(packets: DataFrame, limit: int = 10) -> DataFrame:
    """Tunnels (src, dst) with more than limit distinct network numbers."""
    return packets.groupBy("src", "dst").agg(F.count_distinct("vni").alias("vnis")).filter(F.col("vnis") > limit)


def fragment_flood(groups: DataFrame, keys: list[str], now_us: int, per_second: float, limit: int = 100) -> DataFrame:
    """Sensors with more than limit incomplete groups and over per_second fragments a second since the oldest of them.

    groups: first_us, fragments and complete of each datagram.
    """
    bad = ~F.col("complete")
    g = groups.groupBy(*keys).agg(F.count_if(bad).alias("incomplete"), F.sum("fragments").alias("fragments"), F.min(F.when(bad, F.col("first_us"))).alias("oldest"))
    rate = F.col("fragments") / F.greatest((F.lit(now_us) - F.col("oldest")) / SECOND, F.lit(1.0))
    return g.withColumn("rate", rate).filter((F.col("incomplete") > limit) & (F.col("rate") > per_second)).select(*keys, "incomplete", "rate")
