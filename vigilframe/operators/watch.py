"""State of devices, names and sessions that detectors watch, as running counts in order: no row-at-a-time state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pipes of remote administration, without the prefix \\PIPE\\, and endings that ransomware gives files.
ADMIN_PIPES = ["atsvc", "svcctl", "samr", "lsarpc", "netlogon", "srvsvc", "wkssvc", "winreg", "epmapper", "eventlog", "spoolss", "browser", "ntsvcs", "scerpc"]
RANSOM_ENDINGS = [
    ".encrypted", ".locked", ".crypto", ".crypt", ".enc", ".locky", ".cerber", ".zepto", ".thor", ".aesir", ".zzzzz", ".cryptolocker", ".cryptowall", ".ctbl", ".ecc", ".ezz", ".exx", ".vvv", ".xxx",
]
#: Fixed values of the DNS channel: queries a minute, length of a name, its entropy in bits, bytes of a TXT answer.
DNS_RATE, DNS_LENGTH, DNS_ENTROPY, DNS_TXT = 100, 63, 4.0, 512


def so_far(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def discovery_alerts(frames: DataFrame, known: DataFrame) -> DataFrame:
    """frames(protocol, device, name, mac, capabilities, us, event_id) with alerts: unexpected_address, capabilities_changed, new_device.

    device is the CDP device id or the LLDP chassis, name the CDP device id or the LLDP system name. known(name, mac) has
    the configured devices, one row each. A CDP device's capabilities are held against its frame before, where both have
    some. A device that nobody configured is new at its first frame.
    """
    w = Window.partitionBy("protocol", "device").orderBy("us", "event_id")
    rows = frames.join(known.select(F.col("name").alias("__name"), F.col("mac").alias("__mac")), F.col("name") == F.col("__name"), "left")
    first = F.row_number().over(w) == 1
    was = F.lag("capabilities").over(w)
    rows = rows.withColumns({"__first": first, "__was": was})
    alerts = F.array_compact(F.array(
        F.when(F.col("__mac") != F.col("mac"), "unexpected_address"), F.when((F.col("protocol") == "CDP") & (F.col("__was") != F.col("capabilities")), "capabilities_changed"),
        F.when(F.col("__first") & F.col("__name").isNull(), "new_device"),
    ))
    return rows.withColumn("alerts", alerts).select(*frames.columns, "alerts")


def name_entropy(name: Column) -> Column:
    """Shannon entropy of a name's characters in bits, as an expression."""
    total = F.length(name)
    share = lambda c: (total - F.length(F.replace(name, c, F.lit("")))) / total
    chars = F.filter(F.array_distinct(F.split(name, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def dns_channel(queries: DataFrame, source: str, minute_us: int = 60_000_000) -> DataFrame:
    """queries(source, us, event_id, name, type, answer) with finding, severity and ban; null where there is none.

    In this order, the first that holds: more than DNS_RATE queries of the source in the minute up to the query; a name
    longer than DNS_LENGTH with an entropy above DNS_ENTROPY, from the sixth on a covert channel; a TXT answer above
    DNS_TXT bytes, a ban from the eleventh TXT query on; more than 20 TXT queries. What an earlier rule takes is not
    counted by a later one. Queries of the same instant come in order of event_id.
    """
    at = Window.partitionBy(source, "us").orderBy("event_id")
    later = F.count(F.lit(1)).over(Window.partitionBy(source, "us")) - F.row_number().over(at)
    rows = queries.withColumn("__rate", F.count(F.lit(1)).over(Window.partitionBy(source).orderBy("us").rangeBetween(-(minute_us - 1), 0)) - later)
    fast = F.col("__rate") > DNS_RATE
    odd = (F.length("name") > DNS_LENGTH) & (name_entropy(F.col("name")) > DNS_ENTROPY)
    rows = rows.withColumn("__kind", F.when(fast, 1).when(odd, 2).when(F.col("type") == 16, 3).otherwise(0))
    count = lambda kind: F.sum((F.col("__kind") == kind).cast("long")).over(so_far([source], ["us", "event_id"]))
    rows = rows.withColumns({"__odd": count(2), "__txt": count(3)})
    kind, large = F.col("__kind"), F.col("answer") > DNS_TXT
    case = lambda a, b, c, d, e: F.when(kind == 1, a).when((kind == 2) & (F.col("__odd") > 5), b).when(kind == 2, c).when((kind == 3) & large, d).when((kind == 3) & (F.col("__txt") > 20), e)
    return rows.withColumns({
        "finding": case("rate_limit", "covert_channel", "high_entropy", "txt_abuse", "txt_abuse"), "severity": case("medium", "high", "low", "medium", "medium"),
        "ban": case(F.lit(False), F.lit(True), F.lit(False), F.col("__txt") > 10, F.lit(True)),
    }).select(*queries.columns, "finding", "severity", "ban")


def smtp_volume(commands: DataFrame, flow: list[str], order: list[str], transactions: int, recipients: int) -> DataFrame:
    """commands(flow, order, op) with transactions and recipients of the flow so far, recipients of the present mail, and high_volume.

    op: `mail` begins a mail, `rcpt` adds a recipient, `done` completes it, `rset` forgets its recipients but no totals.
    """
    w = so_far(flow, order)
    times = lambda *ops: F.sum(F.col("op").isin(*ops).cast("long"))
    rows = commands.withColumns({"transactions": times("done").over(w), "recipients": times("rcpt").over(w), "__mail": times("mail", "rset").over(w)})
    rows = rows.withColumn("in_mail", times("rcpt").over(so_far([*flow, "__mail"], order)))
    return rows.withColumn("high_volume", (F.col("transactions") >= transactions) | (F.col("recipients") >= recipients)).drop("__mail")


def _opened(rows: DataFrame, session: list[str], order: list[str], ops: tuple[str, str], test: Column, name: str) -> DataFrame:
    """rows with the number of open things (ops: opens, closes) of the session that pass the test: each change of one adds or takes away one."""
    own = Window.partitionBy(*session, F.col("op").isin(*ops), "id").orderBy(*order)
    now = (F.col("op").isin(*ops) & (F.col("op") == ops[0]) & F.coalesce(test, F.lit(False))).cast("long")
    rows = rows.withColumn("__now", now)
    rows = rows.withColumn("__change", F.when(F.col("op").isin(*ops), F.col("__now") - F.coalesce(F.lag("__now").over(own), F.lit(0))).otherwise(0))
    return rows.withColumn(name, F.sum("__change").over(so_far(session, order))).drop("__now", "__change")


def admin_share(name: Column) -> Column:
    low = F.lower(name)
    return low.endswith("$") & reduce(lambda a, b: a | b, [low.contains(f"\\{s}$") | (low == f"{s}$") for s in ("c", "admin", "ipc")])


def smb_state(messages: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """messages(session, order, op, id, name) with what the session's state says after each: lateral, ransomware, brute_force.

    op: tree_connect and tree_disconnect (id of the tree, name of the share), open and close (id and name of a file), pipe
    (id and name; a pipe's id holds the latest name and is never closed), auth_failure. lateral: an open administrative
    share, or a pipe of remote administration; ransomware: over 5 names with an ending of RANSOM_ENDINGS or over 100 files
    opened so far; brute_force: 5 failures or more.
    """
    name = F.lower("name")
    pipe = reduce(lambda a, b: a | b, [name.contains(f"\\pipe\\{p}") for p in ADMIN_PIPES])
    rows = _opened(messages, session, order, ("tree_connect", "tree_disconnect"), admin_share(F.col("name")), "open_admin")
    rows = _opened(rows, session, order, ("pipe", "pipe"), pipe, "admin_pipes")
    ending = F.coalesce(reduce(lambda a, b: a | b, [name.endswith(e) for e in RANSOM_ENDINGS]), F.lit(False))
    w, opened = so_far(session, order), F.col("op") == "open"
    count = lambda c: F.sum(c.cast("long")).over(w)
    rows = rows.withColumns({"suspicious": count(opened & ending), "files": count(opened), "failures": count(F.col("op") == "auth_failure")})
    return rows.withColumns({"lateral": (F.col("open_admin") > 0) | (F.col("admin_pipes") > 0), "ransomware": (F.col("suspicious") > 5) | (F.col("files") > 100), "brute_force": F.col("failures") >= 5})
