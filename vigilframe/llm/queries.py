"""The thin query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, language_id, lm_score, merkle, minhash, mixing, pii, sharding, simhash, token_counts, toxicity
from .common import documents, fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train_from(docs, fold("doc_id", 5) != 0)
    out = language_id.identify(docs, model, ["doc_id"]).select("__row.*", "__lang", "__score", "__rejected")
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.detect(docs, pii.train_from(docs))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), simhash.hex_print(F.col("__fp")).alias("fingerprint"), F.col("__component").alias("component_id"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.lm_scores(documents(spark, sf_dir))
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from rows whose fold of 3 is not 1, language thresholds included."""
    docs, usable = documents(spark, sf_dir).select("doc_id", "text", "lang"), fold("doc_id", 3) != 1
    language = language_id.train_from(docs, usable, per_language=600)
    return toxicity.train_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable, language=language)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    out = toxicity.score_documents(documents(spark, sf_dir).select("doc_id", "text"), model, ["doc_id"]).select("__row.*", "__toxicity")
    score = F.col("__toxicity")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix_sources(docs, shards=8, seed=9).rows.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.size("__dealt")).alias("taken"), F.size("__dealt").alias("copies"),
        F.col("__dealt.__shard").alias("shards"), F.col("__dealt.__order").alias("orders"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", "text")
    out = sharding.shard_documents(slim, shards=8, seed=10, carry=())
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("__id").eqNullSafe(F.col("__component")).alias("kept"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = documents(spark, sf_dir), ("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.record_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    tampered = F.col("doc_id").isNotNull() & (fold("doc_id", 7) == 0)
    made = merkle.folded(merkle.manifest(docs, fields, "lang", "doc_id", F.when(tampered, changed)).proofs)
    return made.select(
        F.col("__id").alias("doc_id"), F.col("__leaf").alias("leaf"), F.col("__subroot").alias("subroot"), F.col("__root").alias("root"), F.sha2("__proof", 256).alias("proof_sha256"),
        F.col("__folded").alias("folded_root"), (F.col("__folded") == F.col("__root")).alias("verified"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label)
    out = hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)
    return out.select(
        F.col("__anchor").alias("anchor_id"), F.col("__positive").alias("positive_id"), F.col("__rank").alias("rank"), F.col("__negative").alias("negative_id"),
        F.col("__positive_score").alias("positive_score"), F.col("__negative_score").alias("negative_score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
v AS (
  SELECT doc_id, lang,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS b, xor(crc, 4294967295) % 7 = 0 AND doc_id IS NOT NULL AS tampered
  FROM d),
l AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf, tampered,
         sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || b) AS changed
  FROM v),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM l),
node(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY node.pos)) FROM node WHERE n > 1 GROUP BY tree, level, node.pos // 2, n),
subroot AS (SELECT tree, h, count(*) OVER () AS trees FROM node WHERE n = 1),
top(level, pos, n, h) AS (
  SELECT 0, tree, trees, h FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY top.pos)) FROM top WHERE n > 1 GROUP BY level, top.pos // 2, n),
fold(tree, pos, place, n, step, high, proof, h, done) AS (
  SELECT tree, pos, pos, n, 0, false, '', CASE WHEN tampered THEN changed ELSE leaf END, false FROM placed
  UNION ALL
  SELECT f.tree, f.pos,
         CASE WHEN f.n = 1 THEN f.tree ELSE f.place // 2 END,
         CASE WHEN f.n = 1 THEN s.trees ELSE (f.n + 1) // 2 END,
         CASE WHEN f.n = 1 THEN 0 ELSE f.step + 1 END,
         f.high OR f.n = 1,
         f.proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(b.h, t.h, '') END,
         CASE WHEN f.n = 1 THEN f.h WHEN f.place % 2 = 1 THEN sha256(coalesce(b.h, t.h, '') || f.h) ELSE sha256(f.h || coalesce(b.h, t.h, '')) END,
         f.n = 1 AND (f.high OR s.trees = 1)
  FROM fold f JOIN subroot s USING (tree)
  LEFT JOIN node b ON NOT f.high AND f.n > 1 AND b.tree = f.tree AND b.level = f.step AND b.pos = xor(f.place, 1)
  LEFT JOIN top t ON f.high AND f.n > 1 AND t.level = f.step AND t.pos = xor(f.place, 1)
  WHERE NOT f.done)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroot s ON s.tree = p.tree JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.done JOIN top r ON r.n = 1
""",
    "op11_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY x, y),
link AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
side AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM side UNION SELECT r.x, s.y FROM reach r JOIN side s ON r.y = s.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, min(r.y)), d.doc_id) AS component_id,
       d.doc_id = coalesce(least(d.doc_id, min(r.y)), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id, n.n
""",
    "op13_hard_negatives": """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, x.vec_id AS x, a.label = x.label AS alike, list_inner_product(a.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM q a JOIN q x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT a, x, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, x) <= 5),
n AS (
  SELECT p.a, p.x, p.score AS ps, s.x AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.x ORDER BY s.score DESC, s.x) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, x AS positive_id, rank::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
""",
}
