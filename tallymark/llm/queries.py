"""The corpus queries: thin contracts over the operators, each with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, kd_shards, mixing, neighbours, packing, quality_votes, secret_scan, simhash, toxicity, url_rules
from .common import read_table

#: The tokenizer file of op9 and of the pipeline; a path that every executor has.
TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the url contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards.document_shards(read_table(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.match_urls(read_table(spark, sf_dir, "pages"), url_rules.rule_frame(spark, URL_RULES))
    return out.withColumnRenamed("id", "page_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return neighbours.nearest(table, F.col("vec_id") % 50 == 0).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_votes.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def queries() -> dict[str, Query]:
    every = (op1_exact_dedup, op2_kd_shards, op3_cube_mix, op4_url_rules, op5_secret_scan, op6_prefix_forest, op7_toxicity_pu, op8_simhash_bk, op9_hilbert_pack, op10_quality_votes)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in URL_RULES)
    return {
        "op1_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
            w AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS nth,
                         min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
            SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM w""",
        "op4_url_rules": rf"""
            WITH r(v, h, p) AS (VALUES {rules}),
            u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            k AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            b AS (SELECT k.page_id, k.host, k.path, r.h || r.p AS rule, r.v,
                         row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.h || r.p) DESC, r.h DESC, r.p DESC, r.v DESC) AS nth
                  FROM k LEFT JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p))
            SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b WHERE nth = 1""",
    }
