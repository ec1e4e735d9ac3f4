"""One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

Candidates come from two searches: SimHash fingerprints within three bits, found in BK-trees as in
``simhash``, and min-hashes in BANDS bands of ROWS, for the many similar texts whose fingerprints are
farther apart than shards of bits can reach. Components of candidates only bring texts together; in
each, documents are linked where the exact similarity of their shingles is high enough, and the
components of those links decide.

No task holds a whole component. Its members are dealt to parts, and its first document, its leader,
is held against each. Two documents that are linked with the leader need not be compared: they are in
one component already. The others, in blocks, are held against all members, part by part. So every link
that could join two components is looked at, and copies of one text, however many, cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Phase, batches, beside_groups, brought, group_bounds, placed_rows, save, sorted_groups, text_or_empty
from .components import components

SHINGLE, LEAST = 5, 0.8
#: Two texts with a similarity of 0.8 have no band in common with chance (1 - 0.8 ** ROWS) ** BANDS = 7e-5.
BANDS, ROWS, SEED = 24, 5, 11
#: Different shingles of a part, and of a block of open documents, about.
PART = 1 << 18
_RANDOM = np.random.default_rng(SEED)
_TIMES, _PLUS = (_RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)), _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Different shingles' hashes, in order. Texts without words have one in common, so they are equal."""
    found = np.unique(simhash.shingles(text, SHINGLE))
    return found if len(found) else np.zeros(1, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A number for each band, made of its min-hashes."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _TIMES + _PLUS >> np.uint64(20)).min(0))
    least = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for c in range(ROWS):
        out = (out ^ least[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sketch(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 256):
        texts = batch.column("text").to_pylist()
        sets = [shingle_set(t) for t in texts]
        fp = pa.array([simhash.fingerprint(t, SHINGLE) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), fp, pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["row", "fp", "size", "bands"])


def _sets(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 256):
        found = pa.array([shingle_set(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], found], [*rest, "found"])


def linked(sets: list[np.ndarray], asks: np.ndarray, least: float = LEAST) -> np.ndarray:
    """For each set the smallest index that links of ``least`` similarity or more reach; only links of those that ask are looked for.

    One that asks is held against all others that are not in its component yet.
    """
    size = np.array([len(s) for s in sets])
    token, of = np.unique(np.concatenate(sets), return_inverse=True)
    of = of.reshape(-1)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    by_token = owner[np.argsort(of, kind="stable")]
    start = np.searchsorted(np.sort(of), np.arange(len(token) + 1))
    root = np.arange(len(sets))
    for i in np.flatnonzero(asks).tolist():
        others = np.flatnonzero((root != root[i]) & (size >= least * size[i]) & (size * least <= size[i]))
        if not len(others):
            continue
        mine = of[ends[i] - size[i] : ends[i]]
        shared = np.zeros(len(sets), np.int64)
        for t in mine.tolist():
            shared[by_token[start[t] : start[t + 1]]] += 1
        shared = shared[others]
        # in whole numbers of hundredths, so that a similarity of exactly ``least`` counts
        near = others[shared * 100 >= round(least * 100) * (size[others] + size[i] - shared)]
        if len(near):
            joined = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _verified(keys: list[str]):
    """Links a, b of each group, as a forest: at most one for each of its rows."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(rows, keys):
            row, found, asks = table.column("row").to_numpy(), table.column("found"), table.column("asks").to_numpy()
            a, b = [], []
            for x, y in zip(*group_bounds(*[table.column(k).to_numpy() for k in keys]), strict=True):
                if asks[x:y].any():
                    root = linked([np.frombuffer(s.as_buffer(), np.uint64) for s in found.slice(x, y - x)], asks[x:y])
                    a.append(row[x:y])
                    b.append(row[x:y][root])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _links(members: DataFrame, asking: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Links between asking rows and members of the same group."""
    every = members.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True))).select(*keys, "row", "asks", "found")
    dealt = every.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, F.desc("asks"), "row")
    return save(dealt.mapInArrow(_verified(keys), "a long, b long").where("a <> b"), label)


def exact_links(sets: DataFrame, part: int = PART) -> DataFrame:
    """sets: row, root, size, found. Edges a, b whose components are those of all links within each root."""
    number = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    load = F.ceil(F.sum("size") / part).cast("long")
    parts = save(sets.groupBy("root").agg(F.min("row").alias("leader"), load.alias("parts"), F.count(F.lit(1)).alias("n")), "parts")
    dealt = save(beside_groups(sets, parts, "root").withColumn("part", number("parts")), "dealt")
    first = _links(dealt, dealt.where("row = leader").withColumn("part", each("parts")), ["root", "part"], "first")
    open_ = save(dealt.where("row <> leader").join(first.select(F.col("a").alias("row")), "row", "left_anti"), "open")
    # of components with open rows; n is still the number of members
    blocks = save(open_.groupBy("root").agg(load.alias("blocks"), F.max("n").alias("n")), "blocks")
    asking = beside_groups(open_.drop("n"), blocks, "root").withColumn("block", number("blocks")).withColumn("part", each("parts"))
    held = beside_groups(dealt.drop("n"), blocks, "root").withColumn("block", each("blocks"))
    return first.unionByName(_links(held, asking, ["root", "part", "block"], "second"))


def candidates(prints: DataFrame) -> DataFrame:
    """prints: row, fp, bands. Edges a, b whose components hold all pairs that the searches find."""
    in_band = prints.select("row", F.explode("bands").alias("key"))
    first = in_band.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    by_band = in_band.join(first, "key").select("a", F.col("row").alias("b"))
    distinct = save(prints.groupBy("fp").agg(F.min("row").alias("first")), "distinct")
    same = prints.join(distinct, "fp").select(F.col("first").alias("a"), F.col("row").alias("b"))
    near = simhash.links(distinct.select("fp"))
    near = near.join(distinct.toDF("a", "x"), "a").join(distinct.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return by_band.unionByName(same).unionByName(near).where("a <> b").distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component of near copies, all columns kept: that with the smallest id, null ids last.

    Null text is the empty text; texts without words are copies of each other, texts of fewer than
    five words are one shingle; very long texts are read whole. Rows are told apart by their place, so
    repeated rows, rows without an id or with one in common are decided each by itself. Columns of
    any name and type are kept; an empty table gives an empty one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows, row = placed_rows(docs)
    plain = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("id"), text_or_empty(F.col(text)).cast("binary").alias("text"))
    with Phase(docs.sparkSession) as phase:
        prints = save(plain.drop("id").mapInArrow(_sketch, "row long, fp long, size long, bands array<long>"), "sketches")
        member = components(candidates(prints)).withColumnRenamed("node", "row").join(prints.select("row", "size"), "row")
        member = brought(save(member, "member"))  # only texts with a candidate are shuffled
        found = plain.join(member, "row").select("row", "id", "root", "size", "text").mapInArrow(_sets, f"row long, id {kind}, root long, size long, found binary")
        found = save(found, "sets")
        linked_rows = components(exact_links(found.drop("id"))).withColumnRenamed("node", "row")
        named = found.select("row", "id").join(linked_rows, "row")
        stays = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")).select("first.row")
        gone = phase.keep(save(linked_rows.select("row").join(stays, "row", "left_anti").withColumnRenamed("row", row), "gone"))
    return rows.join(brought(gone), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
