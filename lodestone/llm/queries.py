"""Queries opN_<name> with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html, lm, packing, pii, quality, shard, simhash, toxicity
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where(F.col("vec_id") % 100 == 0), k=10)


def op2_ziv_merhav(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm.score(table(spark, sf_dir, "documents"), good)


def op3_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(table(spark, sf_dir, "documents"), shards=40)


def op5_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    scored = toxicity.score(d, toxicity.fit(d, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_additive_quantisation, op2_ziv_merhav, op3_anchor_expansion, op4_jump_hash, op5_nb_ngrams, op6_rule_cascade, op7_segment_tree_bpe, op8_pivot_simhash, op9_text_density, op10_best_fit_packing, pipeline)
    return {f.__name__: f for f in own}


def _jump_sql(shards: int) -> str:
    """Jump consistent hashing by a fold of ``shards`` steps over (bucket, next bucket, state)."""
    k = "((acc.k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)"
    j = f"floor((acc.j + 1)::DOUBLE * (2147483648.0 / ((({k}) // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT"
    start = "{'b': -1::BIGINT, 'j': 0::BIGINT, 'k': key}"
    steps = f"list_reduce([NULL::STRUCT(b BIGINT, j BIGINT, k UHUGEINT)] || list_transform(range({shards}), lambda i: NULL::STRUCT(b BIGINT, j BIGINT, k UHUGEINT)), lambda acc, x: CASE WHEN acc.j < {shards} THEN {{'b': acc.j, 'j': {j}, 'k': {k}}} ELSE acc END, {start})"
    return f"(SELECT CASE WHEN s.j < {shards} THEN s.j ELSE s.b END FROM (SELECT {steps} AS s))::INT"


def _crc_sql(hexadecimal: str) -> str:
    """CRC-32 of the bytes that a hexadecimal text stands for."""
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    listed = "[" + ",".join(map(str, table)) + "]::BIGINT[]"
    step = f"xor(acc >> 8, ({listed})[(xor(acc, x) & 255) + 1])"
    return f"xor(list_reduce(list_transform(regexp_extract_all({hexadecimal}, '..'), lambda b: ('0x' || b)::BIGINT), lambda acc, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM f WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o.k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) AS o GROUP BY doc_id),
g AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM f LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_upper > n_lower AND n_upper > n_words) OR (n_lines > 3 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    op4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS hex, (((coalesce(doc_id, -1)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT))::UHUGEINT AS key FROM documents),
s AS (SELECT doc_id, strlen(t)::BIGINT + 16 AS size, {_crc_sql("hex")} AS text_crc32, {_jump_sql(40)} AS shard, {_jump_sql(41)} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""
    return {"op4_jump_hash": op4, "op6_rule_cascade": SQL_OP6}
