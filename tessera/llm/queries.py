"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, neardup, perplexity, rules, sharding, substrings, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_bands(_table(spark, sf_dir, "documents"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.entropy_mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_toxic_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold_of(F.col("doc_id"), 5) == 0
    rows = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("z").alias("log_ratio"), "passage")


def op5_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold_of(F.col("doc_id"), 4) == 2
    rows, _ = rules.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def op9_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(_table(spark, sf_dir, "documents"))


def op10_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(_table(spark, sf_dir, "pages"))
    return archive.records(payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_LIKE = " OR ".join(f"(host LIKE '{h.replace('*', '%')}' AND path LIKE '{p.replace('*', '%')}')" for h, p in urlfilter.BLOCKED)
SQL: dict[str, str] = {
    # '_' in no pattern: LIKE is exact here
    "op1_shift_and": f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')) t(rule, verdict, rh, rp)),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict FROM parts p LEFT JOIN rules r
  ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST, rule) AS k FROM fits)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_LIKE} THEN 'block' ELSE 'allow' END) AS verdict FROM best WHERE k = 1""",
    # the pairs that share a shingle, counted; classes by the least label that links reach
    "op5_minhash_hamming": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
c AS MATERIALIZED (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
e AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM c),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS met FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
  WHERE 100 * met >= 85 * (na + nb - met)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
class AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
degree AS (SELECT a AS id, count(*) AS links FROM both_ways GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(k.component_id, s.doc_id) AS kept, coalesce(d.links, 0) AS n_links
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN class k ON k.id = c.id LEFT JOIN degree d ON d.id = c.id""",
    "op8_winnowing": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_relative_lempel_ziv": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM win JOIN least USING (h) WHERE lo < doc_id),
cut AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d WHERE doc_id IN (SELECT doc_id FROM cut)),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN left_ USING (doc_id)""",
    # base32 of a digest: five hexadecimal digits are four of its own
    "op10_capture_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS lead FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to FROM p""",
}
