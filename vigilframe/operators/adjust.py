"""Recommended configuration changes from accuracy by module: which threshold or pattern, by how much, within safe bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Step and greatest change by strategy; safe bounds of a threshold and of a change's share.
STRATEGIES = {"conservative": (0.02, 0.10), "moderate": (0.05, 0.20), "aggressive": (0.10, 0.30)}
LOWEST, HIGHEST, MOST_SHARE = 0.3, 0.95, 0.20
#: What a pattern's name contains, the threshold it speaks for, and that threshold's default.
THRESHOLDS = [("brute", "layer234.brute_force.auth_port_threshold", 0.50, "brute force"), ("scan", "layer234.scan.signature_threshold", 0.85, "scan")]
CHANGE = "struct<path: string, direction: string, amount: double, current_value: double, new_value: double, reason: string>"


def _change(path: Column | str, direction: str, amount: Column, current: float, new: Column, reason: Column) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(path.alias("path"), F.lit(direction).alias("direction"), amount.cast("double").alias("amount"), F.lit(float(current)).alias("current_value"), new.cast("double").alias("new_value"), reason.alias("reason")).cast(CHANGE)


def _bounded(path: str, direction: str, amount: Column, current: float, reason: Column) -> Column:
    """A threshold's change by a share of its value, held within the bounds; the share is cut too, and said so."""
    raw = current * (1 + amount) if direction == "increase" else current * (1 - amount)
    new = F.least(F.greatest(raw, F.lit(LOWEST)), F.lit(HIGHEST))
    cut = F.abs(new - current) / current > MOST_SHARE
    return _change(path, direction, F.when(cut, MOST_SHARE).otherwise(amount), current, new, F.when(cut, F.concat(reason, F.lit(" (clamped to safe bounds)"))).otherwise(reason))


def _slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def _percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def recommend(stats: DataFrame, strategy: str = "conservative") -> DataFrame:
    """path, direction, amount, current_value, new_value and reason of every change that the accuracy of modules asks for.

    stats has one row a module: module, fp_rate, fn_rate, top_fp and missed, arrays of (name, n) in falling order. layer234:
    a false positive rate above 5 % raises, a false negative rate above 10 % lowers the thresholds that the names speak
    for, twice as far above 10 or 20 %. http_detect: patterns with over 10 false positives go off, missed attacks of over 5
    come on, of the first three each. signatures: over 50 missed in all at a rate above 15 % lift exclusions, the first
    two patterns at a false positive rate above 10 % are excluded. Other modules give nothing.
    """
    step, most = STRATEGIES[strategy]
    fp, fn = F.col("fp_rate"), F.col("fn_rate")
    speaks = lambda names, word: F.exists(names, lambda x: F.lower(x["name"]).contains(word))
    amount = lambda rate, twice: F.least(F.when(rate > twice, 2 * step).otherwise(step), F.lit(most))
    layer = [F.when((fp > 0.05) & speaks("top_fp", w), _bounded(p, "increase", amount(fp, 0.10), d, F.concat(F.lit("FP rate "), _percent(fp), F.lit(f" for {n}" + (" detection" if w == "scan" else ""))))) for w, p, d, n in THRESHOLDS]
    layer += [F.when((fn > 0.10) & speaks("missed", w), _bounded(p, "decrease", amount(fn, 0.20), d, F.concat(F.lit("FN rate "), _percent(fn), F.lit(f" - missing {n} attacks")))) for w, p, d, n in THRESHOLDS]
    n = lambda x: x["n"].cast("string")
    off = lambda x: _change(F.concat(F.lit("http_detect.patterns."), _slug(x["name"]), F.lit(".enabled")), "decrease", F.lit(min(step, most)), 1.0, F.lit(0.0), F.concat(F.lit("Pattern '"), x["name"], F.lit("' caused "), n(x), F.lit(" false positives")))
    on = lambda x: _change(F.concat(F.lit("http_detect.patterns."), _slug(x["name"])), "increase", F.lit(step), 0.0, F.lit(1.0), F.concat(F.lit("Missed "), n(x), F.lit(" "), x["name"], F.lit(" attacks")))
    some = lambda names, k, least: F.filter(F.slice(names, 1, k), lambda x: x["n"] > least)
    none = F.array().cast(f"array<{CHANGE}>")
    http = F.concat(F.when(fp > 0.05, F.transform(some("top_fp", 3, 10), off)).otherwise(none), F.when(fn > 0.10, F.transform(some("missed", 3, 5), on)).otherwise(none))
    total = F.aggregate("missed", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    classes = "signatures.excluded_classtypes"
    lift = F.when((fn > 0.15) & (total > 50), F.array(_change(classes, "decrease", F.lit(0.0), 0.0, F.lit(0.0), F.concat(F.lit("Missing "), total.cast("string"), F.lit(" attacks - review excluded classtypes"))))).otherwise(none)
    shut = lambda x: _change(classes, "increase", F.lit(0.0), 0.0, F.lit(0.0), F.concat(F.lit("Consider excluding '"), x["name"], F.lit("' ("), n(x), F.lit(" false positives)")))
    signatures = F.concat(lift, F.when(fp > 0.10, F.transform(F.slice("top_fp", 1, 2), shut)).otherwise(none))
    changes = F.when(F.col("module") == "layer234", F.array_compact(F.array(*layer))).when(F.col("module") == "http_detect", http).when(F.col("module") == "signatures", signatures).otherwise(none)
    return stats.select("module", F.inline(changes))
