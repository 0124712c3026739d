"""Labels read off texts and addresses, with the default words and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources import tables as T
from .alerts import chosen, picked
from .registry import register

D = T.DETECTIONS


def sql_words(cases, text: str, other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for words, name in cases) + f" ELSE {other} END"


ANSWERS = ('{"priority": "high", "x": "P1"}', '{"priority": "later", "x": "P1"}', '{"priority": 1, "x": "medium"}', "no json, low risk", "Critical!", "")


@register("H90_answer_priority", f"""WITH a AS (SELECT conv_id, turn, {chosen(ANSWERS, "(conv_id + turn)")} || CASE WHEN turn % 2 = 0 AND (conv_id + turn) % 6 > 2 THEN coalesce(text, '') ELSE '' END AS answer FROM conversations),
 j AS (SELECT *, CASE WHEN json_valid(answer) AND json_type(answer, '$.priority') = 'VARCHAR' THEN upper(json_extract_string(answer, '$.priority')) END AS named FROM a)
 SELECT conv_id, turn, CASE WHEN named IS NOT NULL THEN CASE WHEN named IN ('P1', 'CRITICAL') THEN 'P1' WHEN named IN ('P2', 'HIGH') THEN 'P2' WHEN named IN ('P3', 'MEDIUM') THEN 'P3' WHEN named IN ('P4', 'LOW') THEN 'P4' END
   ELSE {sql_words([(p, p[0]) for p in L.PRIORITIES], "upper(answer)", "NULL")} END AS priority FROM j""")
def answer_priority(spark, sf):
    c = T.table(spark, sf, "conversations")
    by = F.col("conv_id") + F.col("turn")
    answer = F.concat(picked(ANSWERS, by), F.when((F.col("turn") % 2 == 0) & (by % 6 > 2), F.coalesce("text", F.lit(""))).otherwise(""))
    return c.select("conv_id", "turn", L.triage_priority(answer).alias("priority"))


@register("H97_activity", f"SELECT doc_id, {sql_words(L.ACTIVITY_TYPES, 'lower(coalesce(text, $$$$))', chr(39) + 'unknown' + chr(39))} AS kind, {sql_words(L.ACTIVITY_MODULES, 'lower(coalesce(text, $$$$))', chr(39) + 'layer234' + chr(39))} AS module FROM documents")
def activity(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return T.table(spark, sf, "documents").select("doc_id", L.activity_type(text).alias("kind"), L.activity_module(text).alias("module"))


KINDS = tuple(L.ATTACK_WORDS) + ("SignatureMatch", "Other")
LABELS = ("Port Scan", "FTP-Patator", "DDoS Hulk", "SQL Injection", "XSS", "Web Attack", "Infiltration", "Heartbleed", "Benign")
MATCHES = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {' OR '.join(f'contains(lower(label), {chr(39)}{w}{chr(39)})' for w in words)}" for k, words in L.ATTACK_WORDS.items()) + " ELSE kind IN ('SignatureMatch', 'AnomalyDetection') END"


@register("H10_attack_families", f"WITH {D}, a AS (SELECT event_id, {chosen(KINDS, 'event_id')} AS kind, {chosen(LABELS, 'port')} AS label FROM det) SELECT event_id, kind, label, {MATCHES} AS matches FROM a")
def attack_families(spark, sf):
    d = T.detections(spark, sf).select("event_id", picked(KINDS, F.col("event_id")).alias("kind"), picked(LABELS, F.col("port")).alias("label"))
    return d.withColumn("matches", L.attack_matches(F.col("kind"), F.col("label")))


@register("H29_random_sender", """WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN substr(md5(page_id::VARCHAR), 1, 16) WHEN 1 THEN 'a1B-c2D_e3F.g4' WHEN 2 THEN 'ab1' || page_id ELSE 'first.lastname' END AS l FROM pages),
 k AS (SELECT page_id, l, list_transform(string_split(l, ''), lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN 0 WHEN regexp_matches(c, '[a-z]') THEN 1 WHEN regexp_matches(c, '[A-Z]') THEN 2 ELSE 3 END) AS k FROM l)
 SELECT page_id, l AS local_part, strlen(l) >= 12 AND len(list_filter(range(2, len(k) + 1), lambda i: k[i] <> k[i - 1])) / strlen(l) > 0.5 AS random_looking FROM k""")
def random_sender(spark, sf):
    i = F.col("page_id")
    local = F.when(i % 4 == 0, F.substring(F.md5(i.cast("string").cast("binary")), 1, 16)).when(i % 4 == 1, "a1B-c2D_e3F.g4").when(i % 4 == 2, F.concat(F.lit("ab1"), i.cast("string"))).otherwise("first.lastname")
    return T.table(spark, sf, "pages").select("page_id", local.alias("local_part")).withColumn("random_looking", L.random_looking(F.col("local_part")))


SENDERS, RCPTS = ("a@example.com", "Bob <b@Corp.Local>", "c@else.org", "nobody"), ("x@else.org", "y@EXAMPLE.com", "z@far.net")


@register("I27_relay", f"""WITH {D}, m AS (SELECT event_id, {chosen(SENDERS, 'event_id')} AS sender, list_slice({list(RCPTS[::2] + RCPTS[1:2])}, 1, port % 4) AS rcpts FROM det),
 o AS (SELECT *, NOT regexp_matches(lower(sender), '@(example\\.com|corp\\.local)') AS away FROM m)
 SELECT event_id, away AND len(rcpts) > 0 AND len(list_filter(rcpts, lambda r: regexp_matches(lower(r), '@(example\\.com|corp\\.local)'))) = 0 AS relay FROM o""")
def relay(spark, sf):
    rcpts = F.slice(F.array(*[F.lit(r) for r in RCPTS[::2] + RCPTS[1:2]]), 1, (F.col("port") % 4).cast("int"))
    return T.detections(spark, sf).select("event_id", L.open_relay(picked(SENDERS, F.col("event_id")), rcpts, ["example.com", "Corp.Local"]).alias("relay"))
