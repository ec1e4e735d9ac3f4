"""Analytics and upkeep of run history: runs, entities, batches.

A run: run_id, status, is_match, source_name, target_name, pair_key, counts, created_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of file names that name no entity, and lengths of digit groups that are dates.
STOP_WORDS = ("source", "target", "src", "tgt", "file", "final", "raw", "data")
DATE_LENGTHS = (6, 8, 10, 12, 14)


def pair_key(source: Column, target: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("\x00"), target).cast("binary"), 256)


def run_stats(runs: DataFrame, unit: str, first: Column, last: Column) -> DataFrame:
    """bucket, total, passed, failed of every day or hour between two times, empty ones too."""
    t = F.date_trunc(unit, "created_at").cast("timestamp_ntz")
    found = runs.where(F.col("created_at").between(first, last)).groupBy(t.alias("bucket")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_match")).alias("passed"), F.count_if(~F.col("is_match")).alias("failed"))
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    trunc = lambda c: F.date_trunc(unit, c).cast("timestamp_ntz")
    calendar = runs.sparkSession.range(1).select(F.explode(F.sequence(trunc(first), trunc(last), step)).alias("bucket"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return calendar.join(found, "bucket", "left").select("bucket", zero("total"), zero("passed"), zero("failed"))


def stats_unit(first, last) -> str:
    """Hours for a range of at most a day."""
    return "hour" if (last - first).total_seconds() <= 86_400 else "day"


def recent(runs: DataFrame, limit: int, offset: int = 0, status: str | None = None, pair: str | None = None, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A page of runs, newest first, of a status, of a pair of files, and created from ``first`` to ``last``."""
    runs = runs.where(F.col("created_at") >= first) if first is not None else runs
    runs = runs.where(F.col("created_at") <= last) if last is not None else runs
    rows = runs.where(F.col("status") == status) if status else runs
    rows = rows.where(F.col("pair_key") == pair) if pair else rows
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).offset(offset).limit(limit)


def tokens(name: Column) -> Column:
    """Words of a file name that may name an entity."""
    stem = F.regexp_replace(F.element_at(F.split(F.lower(name), "/"), -1), r"\.[^.]*$", "")
    words = F.filter(F.split(stem, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.filter(words, lambda w: ~(w.rlike("^[0-9]+$") & F.length(w).isin(*DATE_LENGTHS)))


def infer_entities(files: DataFrame, entities: DataFrame) -> DataFrame:
    """``files`` with entity, score and confidence: the entity whose alias words meet most words of both names.

    files: source_name, target_name. entities: name, display_name, aliases. The entities are
    folded into a word index, so a file meets only entities that share a word with it.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    index = entities.select("name", F.explode(F.array_distinct(F.flatten(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array())), split)))).alias("word"))
    f = files.withColumn("_s", F.coalesce(tokens(F.col("source_name")), F.array())).withColumn("_t", F.coalesce(tokens(F.col("target_name")), F.array()))
    shared = F.array_intersect("_s", "_t")
    f = f.withColumn("_words", F.when(F.size(shared) > 0, shared).when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("_t")))
    key = ["source_name", "target_name"]
    hits = f.select(*key, F.explode(F.array_distinct(F.concat("_s", "_t"))).alias("word")).distinct().join(index, "word").groupBy(*key, "name").agg(F.count(F.lit(1)).alias("score"))
    best = hits.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "name")).alias("b")).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("b.name").alias("known"), (-F.col("b.minus")).alias("score"))
    j = f.join(best, F.col("source_name").eqNullSafe(F.col("_source_name")) & F.col("target_name").eqNullSafe(F.col("_target_name")), "left")
    entity = F.coalesce("known", F.get("_words", F.lit(0)), F.lit("unknown_entity"))
    confidence = F.when(F.col("score") >= 2, "high").when(F.col("score") == 1, "medium").otherwise("low")
    return j.select(*files.columns, entity.alias("entity"), F.coalesce("score", F.lit(0)).cast("long").alias("score"), confidence.alias("confidence"))


def entity_insights(runs: DataFrame, last: int | None = None, shown: int = 100) -> DataFrame:
    """entity, success, failed, total of all runs with an ``entity``, and its newest ``shown`` runs, newest first."""
    rows = recent(runs, last) if last else runs
    newest = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("created_at"), F.desc("run_id")))
    detail = F.struct(F.col("created_at"), "run_id", "is_match")
    # the rank's filter is pushed below the window's shuffle, so an entity's list is short before it is made
    listed = rows.withColumn("_n", newest).where(F.col("_n") <= shown).groupBy(F.col("entity").alias("_e")).agg(F.sort_array(F.collect_list(detail), asc=False).alias("runs"))
    counts = rows.groupBy("entity").agg(F.count_if(F.col("is_match")).alias("success"), F.count_if(~F.col("is_match")).alias("failed"), F.count(F.lit(1)).alias("total"))
    return counts.join(listed, F.col("entity").eqNullSafe(F.col("_e"))).drop("_e")


def batch_summary(units: DataFrame) -> DataFrame:
    """completed, failed, skipped, passed of a batch's units: status, is_match."""
    s = F.col("status")
    return units.agg(F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.count_if((s == "completed") & F.col("is_match")).alias("passed"))


def delete_runs(runs: DataFrame, mismatches: DataFrame, run_ids: DataFrame | None = None, pair: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the runs of ``run_ids``, or of a pair of files, or, with neither, without any."""
    if run_ids is None:
        run_ids = (runs.where(F.col("pair_key") == pair) if pair is not None else runs).select("run_id")
    run_ids = run_ids.select("run_id").distinct()
    return runs.join(run_ids, "run_id", "left_anti"), mismatches.join(run_ids, "run_id", "left_anti")


def save_draft(runs: DataFrame, draft: DataFrame) -> DataFrame:
    """``runs`` with a draft: a run with the status ``pending``, without results, that replaces an earlier draft of its id. A run that has begun stays as it is."""
    begun = runs.where(F.col("status") != "pending")
    new = draft.withColumn("status", F.lit("pending")).join(begun.select("run_id"), "run_id", "left_anti")
    return runs.join(new.select("run_id"), "run_id", "left_anti").unionByName(new, allowMissingColumns=True)


def backfill(run_id: object, mismatches: DataFrame, artifact: DataFrame) -> DataFrame:
    """The stored mismatches of a run, or, where none are stored, those of its artifact."""
    own = mismatches.where(F.col("run_id") == run_id)
    return artifact.withColumn("run_id", F.lit(run_id)).select(*mismatches.columns) if own.isEmpty() else own


def upsert_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """name, display_name, aliases: the latest display name, all aliases as a sorted set.

    A change without a display name keeps the old one. Name spelling is normalized.
    """
    norm = F.array_join(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""), "_")
    both = entities.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1))).withColumn("name", norm)
    return both.groupBy("name").agg(F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.col("_v"))).alias("display_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def persist_run(run: DataFrame, mismatches: DataFrame, path: str, cap: int | None = 100_000) -> bool:
    """Appends a run and all of its mismatches to the history; of a run with more than ``cap`` none are stored, as its artifact has them.

    Whether they were stored is the result.
    """
    run.write.mode("append").parquet(f"{path}/runs")
    whole = cap is None or mismatches.limit(cap + 1).count() <= cap
    if whole:
        mismatches.write.mode("append").parquet(f"{path}/mismatches")
    return whole
