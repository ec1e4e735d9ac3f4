"""Helpers shared by the corpus operators: scratch tables, streamed groups, fixed expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import Phase, save, scratch_root

#: Fixed value: the white space of every contract, as a Java and Python character class body.
BLANKS = r"\x20\x09-\x0D"
#: Bytes of texts that a Python worker turns into strings at once. Spark itself bounds what crosses at once (64 MB).
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a plain scan of files, whose rows have a place that no later run changes."""
    return docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def placed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, a long, and its name.

    Rows of a scan of Parquet files have a place already, the file and the number in it, which is the same
    in every run. The rows of any other plan are written first, as they may come in another order when a lost task runs again.
    """
    row = fresh(docs, "_row")
    if is_scan(docs) and fresh(docs, "_metadata") == "_metadata":
        file, number = fresh(docs, "_file"), fresh(docs, "_number")
        try:
            rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        except AnalysisException:
            rows = None  # files of another format have no row numbers
        if rows is not None:
            files = save(rows.select(file).distinct().withColumn(number, F.row_number().over(Window.orderBy(file)).cast("long")), "files")
            # a row a file: fewer than the driver holds for the scan itself
            rows = rows.join(F.broadcast(files), file)
            return rows.withColumn(row, F.shiftleft(number, 40).bitwiseOR(F.col(row))).drop(file, number), row
    return save(docs.withColumn(row, F.monotonically_increasing_id()), "placed"), row


def blocks(rows: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in rows:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers outlive tasks, and else an executor keeps the peaks of all of them."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def batches(rows: Iterable[pa.RecordBatch], limit: int = 2048, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` rows and, but for single larger rows, of at most ``size`` bytes. After each of Spark's batches free memory is given back."""
    for batch in rows:
        todo = [batch.slice(at, limit) for at in range(0, batch.num_rows, limit)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
        give_back()


def sorted_groups(rows: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``keys`` from a partition sorted by them; a group may span Arrow batches.

    Yields tables made of one or more whole groups, so that single rows can be skipped in bulk.
    """
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def group_bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    change = np.ones(len(keys[0]), bool)
    if len(change):
        change[1:] = False
        for v in keys:
            change[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(change))


#: Narrow tables up to this many rows, each of a few numbers, go to the texts by broadcast; larger ones by a merge join.
MAX_BROADCAST = 1 << 20


def brought(df: DataFrame) -> DataFrame:
    """A saved narrow table, hinted by its number of rows for a join with whole texts."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df.hint("merge")


#: Keys with more rows than this, or than their share of all rows would be if there were HOT_KEYS of them, are hot: at most HOT_KEYS keys.
HOT, HOT_KEYS = 10_000, 1 << 16


def beside_groups(rows: DataFrame, groups: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, a row a key, of which ``n`` is the number of rows.

    The rows of hot keys stay where they are and their groups are broadcast, at most HOT_KEYS of
    them, as each has more than that share of all rows; all other rows are shuffled by key.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT, total // HOT_KEYS)
    few = F.broadcast(groups.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key, how))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_rank`` from 0 in the order given: rows are range-sorted, and a table with a row per range says where each begins."""
    s = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = s.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are ranges
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    parts = F.broadcast(parts.select("_range", before.alias("_before")))
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumn("_range", F.shiftright("_at", 33)).join(parts, "_range").withColumn("_rank", F.col("_before") + low).drop("_range", "_before", "_at")


__all__ = ["BLANKS", "Phase", "batches", "beside_groups", "blocks", "brought", "fold", "fresh", "give_back", "group_bounds", "placed_rows", "ranked", "read_table", "save", "scratch_root", "sorted_groups", "text_or_empty"]
