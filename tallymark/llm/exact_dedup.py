"""Exact dedup by a log-structured merge index of digests (DataFrame operations only).

Entries (digest, id) are logged, and dealt by input task to memtables. A memtable is flushed as a
run: one entry a digest with its smallest identifier and its number of entries, sorted, with a
blocked Bloom filter beside it. Compaction merges FANOUT runs at a time, level by level, until one
is left. In a merge each entry probes the filters of the other runs: only entries that may have an
equal there are shuffled and folded, all others go down a level as they are. Digests with more than
one entry are hits; a fixed-width filter made of them picks the texts that must move, and those are
grouped by digest *and bytes*, so a digest collision never merges two texts. Copies are folded
before every shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Phase, beside_groups, placed_rows, save, text_or_empty

#: Memtables of a batch, and runs that one merge takes.
MEMTABLES, FANOUT = 8, 4
#: A filter block is one 64-bit word. At most so many blocks are broadcast at once: those of all runs of a level, or of the hits.
MAX_FILTER_BLOCKS = 1 << 20
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "50000"}


def normalise(text: Column) -> Column:
    """Every run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), f"[{BLANKS}]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """A log of (digest, id, batch, tag) and its sorted runs; batch and tag tell repeated rows of one id apart."""

    def __init__(self, memtables: int = MEMTABLES, fanout: int = FANOUT) -> None:
        self.memtables, self.fanout = memtables, fanout
        self.logs: list[DataFrame] = []
        self.runs: list[DataFrame] = []

    def flush(self, entries: DataFrame) -> None:
        """Log the entries (digest, id) of a batch and write its memtables as sorted runs."""
        batch = len(self.logs)
        log = save(entries.select("digest", "id", F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("tag")), "log")
        run = F.pmod(F.shiftright("tag", 33), F.lit(self.memtables)) + batch * self.memtables
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "batch", "tag")).alias("first")
        rows = log.groupBy(run.cast("int").alias("run"), "digest").agg(first, F.count(F.lit(1)).alias("n"))
        self.logs.append(log)
        self.runs.append(save(rows.sortWithinPartitions("run", "digest"), "run", **RUN_OPTIONS))

    def entries(self) -> DataFrame:
        """Everything that was logged."""
        if not self.logs:
            raise ValueError("the index has no runs")
        return reduce(DataFrame.unionByName, self.logs)

    def compact(self) -> DataFrame:
        """Merges all runs into one: a row a digest with ``first``, its entry with the smallest id (null ids last), and ``n``, its number of entries."""
        level, n_runs = reduce(DataFrame.unionByName, self.runs), self.memtables * len(self.runs)
        filters, blocks = run_filters(level, n_runs)
        while n_runs > 1:
            level, filters = self._merge(level, filters, blocks)
            n_runs = -(-n_runs // self.fanout)
        self.runs, self.memtables = [level], 1
        return level.drop("run")

    def _merge(self, level: DataFrame, filters: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
        """One level down: runs of a group become one run, and so do their filters."""
        group = F.floor(F.col("run") / self.fanout).cast("int")
        h, mask = _mask(F.col("digest"))
        # at most MAX_FILTER_BLOCKS rows, before they are brought together
        others = filters.groupBy(group.alias("_group"), F.col("block").alias("_block")).agg(F.collect_list(F.struct("run", "bits")).alias("_filters"))
        probed = level.withColumns({"_group": group, "_block": h.bitwiseAND(F.lit(blocks - 1)), "_mask": mask}).join(F.broadcast(others), ["_group", "_block"], "left")
        meets = F.exists("_filters", lambda f: (f["run"] != F.col("run")) & (f["bits"].bitwiseAND(F.col("_mask")) == F.col("_mask")))
        probed = probed.select("digest", "first", "n", F.col("_group").alias("run"), F.coalesce(meets, F.lit(True)).alias("meets"))
        met = probed.where("meets").groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        merged = probed.where("NOT meets").select("run", "digest", "first", "n").unionByName(met)
        below = filters.groupBy(group.alias("run"), "block").agg(F.bit_or("bits").alias("bits"))
        return save(merged.sortWithinPartitions("run", "digest"), "level", **RUN_OPTIONS), save(below, "filters")


def _mask(digest: Column) -> tuple[Column, Column]:
    h = F.xxhash64(digest)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return h, bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)).bitwiseOR(bit(58))


def run_filters(runs: DataFrame, n_runs: int) -> tuple[DataFrame, int]:
    """run, block, bits: a blocked Bloom filter of each run, of one width, about 16 bits an entry of the largest run.

    All of them together have at most MAX_FILTER_BLOCKS words: a full filter sends more entries through a merge, and changes no result.
    """
    most = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    blocks = 1
    while blocks < min(most // 4 + 1, MAX_FILTER_BLOCKS // n_runs // 2):
        blocks *= 2
    h, mask = _mask(F.col("digest"))
    table = runs.select("run", h.bitwiseAND(F.lit(blocks - 1)).alias("block"), mask.alias("mask")).groupBy("run", "block").agg(F.bit_or("mask").alias("bits"))
    return save(table, "filters"), blocks


def hit_filter(hits: DataFrame) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of the hits' digests, about 16 bits a hit, never over MAX_FILTER_BLOCKS words.

    A full filter lets more texts through; it never changes the result.
    """
    blocks = 1
    while blocks < min(hits.count() // 4 + 1, MAX_FILTER_BLOCKS):
        blocks *= 2
    h, mask = _mask(F.col("digest"))
    table = hits.select(h.bitwiseAND(F.lit(blocks - 1)).alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))
    return save(table, "filter"), blocks


def may_hit(docs: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """``docs`` with a boolean ``may_hit``; the filter is at most MAX_FILTER_BLOCKS rows, so it is broadcast."""
    h, mask = _mask(F.col("digest"))
    small = F.broadcast(table.select(F.col("block").alias("_block"), "bits"))
    out = docs.withColumn("_h", h.bitwiseAND(F.lit(blocks - 1))).join(small, F.col("_h") == F.col("_block"), "left")
    return out.withColumn("may_hit", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_h", "_block", "bits")


def _build(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DigestIndex, DataFrame, DataFrame, int]:
    """docs: id, norm. Returns the index, its compacted level and the filter of its hits."""
    index = DigestIndex()
    index.flush(docs.select(digest(F.col("norm")).alias("digest"), "id"))
    level = index.compact()
    table, blocks = hit_filter(level.where("n > 1"))
    return index, level, table, blocks


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Null text is the empty text; very long texts are read whole. Of equal texts the row with the
    smallest id stays; null ids come last; of repeated rows with one id exactly one stays. An empty
    table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    ``digest`` maps the normalised text to binary; texts that share it are told apart by their bytes.
    """
    base = docs.select(docs[doc_id].alias("id"), normalise(docs[text]).alias("norm"))
    with Phase(docs.sparkSession) as phase:
        index, level, table, blocks = _build(base, digest)
        for kept in (*index.logs, table):
            phase.keep(kept)
        texts = may_hit(base.withColumn("digest", digest(F.col("norm"))), table, blocks).where("may_hit")
        verified = texts.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        collided = phase.keep(save(verified.where("texts > 1").select("digest"), "collided"))
        found = level.where("n > 1").select("digest", F.col("first.id").alias("keep_id"), F.col("first.batch").alias("keep_batch"), F.col("first.tag").alias("keep_tag"), "n")
        n_collided = collided.count()
        if n_collided:
            found = found.join(collided, "digest", "left_anti")
        groups = phase.keep(save(found, "groups"))
    rows = may_hit(index.entries(), table, blocks)
    single = lambda df: df.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    out = single(rows.where("NOT may_hit"))
    hits = beside_groups(rows.where("may_hit").drop("may_hit"), groups, "digest", how="left")
    is_first = (F.col("batch") == F.col("keep_batch")) & (F.col("tag") == F.col("keep_tag"))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    out = out.unionByName(hits.select("id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("n").isNull() | is_first).alias("kept"), "digest"))
    if n_collided:
        out = out.join(collided, "digest", "left_anti").select("id", "keep_id", "group_size", "kept", "digest")
        out = out.unionByName(_by_bytes(base.withColumn("digest", digest(F.col("norm"))).join(collided, "digest", "left_semi")))
    return out


def _by_bytes(texts: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, grouped by their bytes."""
    rows = save(texts.groupBy("digest", "norm", "id").agg(F.count(F.lit(1)).alias("copies")), "collided_rows")
    groups = save(rows.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")), "collided_groups")
    out = rows.join(groups, ["digest", "norm"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept, whatever their types and names.

    Texts are compared as in ``exact_dedup``: null text is the empty text, the smallest id stays, null ids
    come last, and of repeated rows with one id the one that comes first in the files. An empty table gives
    an empty one. Texts that no copy shares stay where they are; only possible hits are shuffled, folded first.
    """
    names = docs.columns
    tagged, at = placed_rows(docs)
    row = tagged.select(F.col(doc_id).alias("id"), normalise(F.col(text)).alias("norm"), F.col(at).alias("at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    with Phase(docs.sparkSession) as phase:
        _, _, table, blocks = _build(row.select("id", "norm"), digest)
        phase.keep(table)
    marked = may_hit(row.withColumn("digest", digest(F.col("norm"))), table, blocks)
    alone = marked.where(~F.col("may_hit")).select("row.*")
    first = F.min_by("row", F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("row")
    return alone.unionByName(marked.where("may_hit").groupBy("digest", "norm").agg(first).select("row.*"))
