"""Samples, counts and files of the mismatch relation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import write_bytes
from .reconcile import EXTRA, MATCH, MISMATCH_COLUMNS, MISSING, VALUE

UNNAMED = "(unknown)"
DEFAULT_SNIPPET, MOST_SNIPPET = 10, 50


def snippet_limit(asked: int | None) -> int:
    return min(MOST_SNIPPET, max(1, asked if asked is not None else DEFAULT_SNIPPET))


def snippet_budget(per_column: int, columns: int) -> int:
    """Rows of a grouped sample: both presence kinds and every column."""
    return 2 * per_column + per_column * columns


def dedupe(mismatches: DataFrame) -> DataFrame:
    """One row of each uid, column and type: the one with the smallest values."""
    keys = ["uid", "column_name", "mismatch_type"]
    rest = [c for c in mismatches.columns if c not in keys]
    return mismatches.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*mismatches.columns)


def _nth(partition: Sequence[Column | str]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy("uid", "column_name", "source_value", "target_value"))


def sample_per_column(mismatches: DataFrame, k: int) -> DataFrame:
    """The first k changed cells of each column, by uid. The window's rank filter is pushed below its shuffle."""
    rows = mismatches.where(F.col("mismatch_type") == VALUE)
    return rows.withColumn("_n", _nth(["column_name"])).where(F.col("_n") <= k).drop("_n")


def sample_stratified(mismatches: DataFrame, limit: int) -> DataFrame:
    """``limit`` changed cells taken from the columns in turn; cells without a column come last."""
    rows = sample_per_column(mismatches, limit).withColumn("_n", _nth(["column_name"]))
    return rows.orderBy(F.col("column_name").isNull(), "_n", "column_name").limit(limit).drop("_n")


def sample_grouped(mismatches: DataFrame, k: int) -> DataFrame:
    """Up to k missing, k extra and k changed cells of each column."""
    return mismatches.where(F.col("mismatch_type") != MATCH).withColumn("_n", _nth(["mismatch_type", "column_name"])).where(F.col("_n") <= k).drop("_n")


def category_budget(missing: int, extra: int, value: int, limit: int) -> tuple[int, int, int]:
    """How many rows each category gives to a sample of ``limit``: everyone in turn, as far as it has rows.

    With a limit below the number of categories that have rows, the first ones get one row each.
    """
    sizes, out = (missing, extra, value), [0, 0, 0]
    for _ in range(max(0, min(limit, sum(sizes)))):
        i = min((i for i in range(3) if out[i] < sizes[i]), key=lambda i: (out[i], i))
        out[i] += 1
    return tuple(out)


def sample_mixed(mismatches: DataFrame, limit: int) -> DataFrame:
    """A sample of all three kinds within a budget; the kinds are counted in one pass."""
    c = {r["mismatch_type"]: r["n"] for r in counts_by_type(mismatches).collect()}
    m, e, v = category_budget(c.get(MISSING, 0), c.get(EXTRA, 0), c.get(VALUE, 0), limit)
    first = lambda kind, n: mismatches.where(F.col("mismatch_type") == kind).orderBy("uid", "column_name").limit(n)
    return first(MISSING, m).unionByName(first(EXTRA, e)).unionByName(sample_stratified(mismatches, v))


def page(mismatches: DataFrame, limit: int, offset: int = 0, kind: str | None = None, uids: Sequence[str] | None = None) -> DataFrame:
    """A page in total order, of a kind and of some keys."""
    rows = mismatches.where(F.col("mismatch_type") == kind) if kind else mismatches
    rows = rows.where(F.col("uid").isin(*uids)) if uids is not None else rows
    return rows.orderBy("mismatch_type", "uid", "column_name").offset(offset).limit(limit)


def counts_by_type(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


def counts_by_column(mismatches: DataFrame) -> DataFrame:
    """column_name, n: changed cells of each column, each uid once."""
    name = F.when(F.coalesce(F.col("column_name"), F.lit("")) == "", UNNAMED).otherwise(F.col("column_name"))
    return mismatches.where(F.col("mismatch_type") == VALUE).select("uid", name.alias("column_name")).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))


def mismatched_rows(mismatches: DataFrame, exact: bool = True) -> DataFrame:
    """value_mismatch_rows: different uids with a changed cell; approximate if asked."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return mismatches.where(F.col("mismatch_type") == VALUE).agg(count("uid").alias("value_mismatch_rows"))


# Other names of the summary's entries.
SUMMARY_NAMES = {
    MISSING: (MISSING, "missing"), EXTRA: (EXTRA, "extra"), VALUE: (VALUE, "value_mismatch_cells", "value_mismatch_records"),
    "value_mismatch_rows": ("value_mismatch_rows", "changed_rows", "changed"),
}


def normal_summary(summary: dict | None) -> dict[str, int]:
    return {k: int(next((summary[n] for n in names if n in (summary or {})), 0)) for k, names in SUMMARY_NAMES.items()}


def merge_summaries(a: dict, b: dict) -> dict[str, int]:
    """The larger of each entry."""
    a, b = normal_summary(a), normal_summary(b)
    return {k: max(a[k], b[k]) for k in a}


def write_ndjson(mismatches: DataFrame, path: str, mode: str = "append") -> None:
    mismatches.select(*MISMATCH_COLUMNS).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_ndjson(spark, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in MISMATCH_COLUMNS)).json(path)


def enrich(mismatches: DataFrame, source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fills empty row details from both sides' records."""
    from ..functions import identity

    side = lambda df, n: df.select(identity.uid(identity.key_parts(df, keys)).alias("uid"), F.to_json(F.struct(*df.columns)).alias(n)).groupBy("uid").agg(F.max(n).alias(n))
    j = mismatches.join(side(source, "_s"), "uid", "left").join(side(target, "_t"), "uid", "left")
    built = F.to_json(F.struct(F.parse_json("_s").alias("source_record"), F.parse_json("_t").alias("target_record")))
    return j.withColumn("row_detail", F.when(F.coalesce("row_detail", F.lit("")) == "", built).otherwise(F.col("row_detail"))).select(*mismatches.columns)


def markdown(summary: dict, schema_issues: Sequence[dict] = (), samples: Sequence[dict] = (), title: str = "Reconciliation report", most: int = 50) -> str:
    """A report of counts, schema issues and the first samples."""
    out = [f"# {title}", "", "| count | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in summary.items()]]
    for name, rows in (("Schema differences", schema_issues), ("Samples", samples[:most])):
        if rows:
            out += ["", f"## {name}", "", "| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
            out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r.values()) + " |" for r in rows]
    return "\n".join(out) + "\n"


def write_json(spark: SparkSession, value: object, path: str, lines: bool = False) -> None:
    """A small value as a JSON file at any path that Spark writes; a list as JSON lines if asked."""
    dump = lambda v, indent: json.dumps(v, ensure_ascii=False, indent=indent, default=str)
    text = "".join(dump(v, None) + "\n" for v in value) if lines else dump(value, 1)
    write_bytes(spark, path, text.encode())


def write_job(spark: SparkSession, folder: str, status: dict, result: dict | None = None, batch: Sequence[dict] = (), stages: dict | None = None) -> None:
    """A job's files: status.json, result.json, batch_results.jsonl and stage_metrics.json, each if there is something to tell."""
    for name, value in (("status", status), ("result", result), ("stage_metrics", stages)):
        if value is not None:
            write_json(spark, value, f"{folder}/{name}.json")
    if batch:
        write_json(spark, list(batch), f"{folder}/batch_results.jsonl", lines=True)


def encrypt(c: Column, key: str) -> Column:
    """Text at rest: AES-GCM, base64."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM")))


def decrypt(c: Column, key: str) -> Column:
    return F.try_aes_decrypt(F.unbase64(c), F.lit(key), F.lit("GCM")).cast("string")
