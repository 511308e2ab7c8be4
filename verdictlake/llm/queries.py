"""The corpus queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, mixing, neighbours, packing, quality, sharding, url_filters, warc
from .common import id_fold, new_dir, staged, table, text_or_empty

MOST_TOKENS = 2048
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, new_dir(spark, "shards"))
    rows = sharding.ingest(store, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("text_bytes"), F.sha2(text_or_empty(), 256).alias("text_sha256"), "lang", "source")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), MOST_TOKENS)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_string(F.col("sketch")).alias("fingerprint"), fingerprints.as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "distinct_shingles", "contained_in_edited")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.listed(spark.createDataFrame(URL_RULES, "key string, verdict string"), "key", "verdict")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality.scorer(spark, quality.learn(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.capture_histories(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predict = language_id.predictor(spark, language_id.learn(docs))
    rows = docs.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = staged(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")), "mix-sized")
    rows = mixing.mix(sized, F.col("size"))
    return rows.select("mx_row.doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_best_fit_packing, op3_fingerprints, op4_nearest_neighbours, op5_url_filters, op6_quality, op7_warc, op8_language, op9_mixing, op10_jaccard_join, pipeline)}

RULES_SQL = ", ".join(f"('{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}', '{k}', '{v}')" for k, v in URL_RULES)

ORACLE = {
    "op1_sharding": """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS text_bytes, sha256(coalesce(text, '')) AS text_sha256, lang, source
FROM documents""",
    "op5_url_filters": f"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {RULES_SQL}),
p AS (SELECT page_id, row_number() OVER () AS uid,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
m AS (SELECT uid, rule, r.verdict, row_number() OVER (PARTITION BY uid ORDER BY length(rule) DESC, length(rule_host) DESC) AS n
      FROM p JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.uid = m.uid AND m.n = 1""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
    "op9_mixing": r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS whole FROM w),
l AS (SELECT *, (whole - capped) / rest AS own FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT max(own) FROM l WHERE cap > own * weight), cap)) AS target FROM l),
c AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL),
a AS (SELECT source, sum(size * n) / sum(n) AS scale, min(size) AS least FROM c GROUP BY 1),
newton AS (
  SELECT a.source, target, scale, -50.0::DOUBLE / (least / scale) AS low, (ln(2.0::DOUBLE) + 1) / (least / scale) AS high, 0.0::DOUBLE AS lam, 0 AS i FROM t JOIN a ON t.source IS NOT DISTINCT FROM a.source
  UNION ALL
  SELECT source, target, scale, low, high, CASE WHEN there THEN lam WHEN next > low AND next < high THEN next ELSE (low + high) / 2 END, i + 1 FROM (
    SELECT source, target, scale, CASE WHEN target > now THEN lam ELSE low END AS low, CASE WHEN target > now THEN high ELSE lam END AS high, lam, i, abs(target - now) <= 1e-12::DOUBLE * greatest(target, 1) AS there, lam + (target - now) / nullif(slope, 0) AS next FROM (
      SELECT q.source, target, scale, low, high, lam, i, sum(n * size * least(2.0::DOUBLE, exp(least(700, lam * (size / scale))))) AS now, sum(CASE WHEN exp(least(700, lam * (size / scale))) < 2 THEN n * size * (size / scale) * exp(least(700, lam * (size / scale))) ELSE 0 END) AS slope
      FROM newton q JOIN c ON q.source IS NOT DISTINCT FROM c.source WHERE i < 80 GROUP BY ALL))),
r AS (SELECT c.source, size, n, round(least(2.0::DOUBLE, exp(least(700, lam * (size / scale)))), 9) AS rate, row_number() OVER (PARTITION BY c.source ORDER BY size DESC) AS k FROM c JOIN newton q ON q.source IS NOT DISTINCT FROM c.source AND i = 80),
fold AS (
  SELECT source, 0::BIGINT AS k, 0::BIGINT AS size, 0.0::DOUBLE AS owed, sum(n * rate * size) AS later, sum(n * size * 2.0::DOUBLE) AS room, 0::BIGINT AS copies FROM r GROUP BY source
  UNION ALL
  SELECT source, k, size, want - copies * size, later, room, copies FROM (SELECT *, greatest(0, least(CASE WHEN few <= top THEN greatest(few, least(near, top)) ELSE near END, 2 * n))::BIGINT AS copies FROM (
    SELECT *, floor(want / size + 0.5) AS near, ceil((want + later - room) / size - 1e-6) AS few, floor((want + later) / size + 1e-6) AS top FROM (
      SELECT r.source, r.k, r.size, n, owed + n * rate * r.size AS want, later - n * rate * r.size AS later, room - n * r.size * 2.0::DOUBLE AS room FROM fold JOIN r ON r.source IS NOT DISTINCT FROM fold.source AND r.k = fold.k + 1)))),
d AS (SELECT sized.*, source_size, target, row_number() OVER (PARTITION BY sized.source, size ORDER BY doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY sized.source, size) AS n FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, source_size, target, CAST(coalesce(d.size * (copies // n + CASE WHEN place <= copies % n THEN 1 ELSE 0 END), 0) AS BIGINT) AS taken
FROM d LEFT JOIN fold ON d.source IS NOT DISTINCT FROM fold.source AND d.size = fold.size AND fold.k > 0""",
}
