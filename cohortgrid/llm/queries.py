"""The operators bound to the given tables, one query each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortgrid.llm import bpe, contamination, fim, language, licences, lines, order_minhash, repeats, resampling, sharding, simhash, toxicity, unigram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.digests(documents(spark, sf_dir))


@query("op2_simhash_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op3_byte_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(documents(spark, sf_dir))


@query("op4_license_scans", licences.scan_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


OP7 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
x AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
m AS (SELECT r, s, v.n, item_id FROM x JOIN v ON x.words = v.words AND x.n = v.n),
h AS (SELECT r, count(DISTINCT p) AS hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY r),
k AS (SELECT r, count(*) AS items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""


@query("op7_benchmark_decontamination", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op8_unigram_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op11_fill_in_middle", fim.digests_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op12_sql(percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS t(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
o AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT r, w FROM d UNION ALL SELECT 0, {words} FROM benchmark)),
n AS MATERIALIZED (SELECT r, f, count(*) AS n FROM o GROUP BY r, f),
b AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % {buckets} AS bucket
  FROM (SELECT DISTINCT f FROM n), crc_table),
c AS (SELECT bucket, sum(n) FILTER (r > 0) AS s, sum(n) FILTER (r = 0) AS t FROM n JOIN b USING (f) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) + {buckets} AS s, coalesce(sum(t), 0) + {buckets} AS t FROM c),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(c.t, 0) + 1)::DOUBLE * whole.s::DOUBLE / ((coalesce(c.s, 0) + 1)::DOUBLE * whole.t::DOUBLE)))::BIGINT AS gain
  FROM c, whole),
m AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE r > 0 GROUP BY r),
z AS (
  SELECT r, doc_id, len(w) >= {min_words} AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM d LEFT JOIN m USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY able) AS whole_n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= whole_n * {percent} // 100 THEN place END AS rank
FROM k
"""


@query("op12_importance_resampling", op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_line_dedup", lines.lines_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))
