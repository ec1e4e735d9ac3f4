"""Mixing sources to target weights by balanced sampling, the cube method (Deville and Tillé, 2004).

A source's target over its size is the expected number of times that each of its documents is
taken: a whole part, which is taken for sure, and a fraction. Fractions move through the
null-space of two constraints, the number of documents and of words, until they are 0 or 1.
The flight works on blocks of at most BLOCK documents of a source. What a block cannot decide, and
HELD documents of it with sizes like the powers of two, fly again in blocks of their own, round by
round. The last dozen of a source land together: of all ways to take them, the one whose words come nearest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Phase, brought, fresh, group_bounds, placed_rows, ranked, save, sorted_groups, text_or_empty

BLOCK = 1024
#: Documents that a block holds back for the next round, and for the landing.
HELD, LANDED = 6, 11
#: Blocks that meet in one block of the next round; each leaves two documents at most besides those held.
MERGED = BLOCK // (HELD + 2)
SURE = 1e-9


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """sources: source, source_size. Adds ``order`` (by code point, null last) and ``target``.

    All targets are ``share`` of all sizes, in proportion to the repeating weights, none above
    ``ceiling`` times its source. A pass fixes those above; their excess raises the others.
    """
    s = ranked(sources.withColumn("_null", F.col("source").isNull()), "_null", "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    s = save(s.select("source", "source_size", F.col("_rank").alias("order"), w.alias("w"), (F.col("source_size") * ceiling).alias("most")), "sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    scale, fixed = 0.0, -1
    while True:
        above = F.col("w") * scale > F.col("most") if fixed >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w"))), F.count_if(above)).first()
        if r[2] == fixed or not r[1]:
            break
        fixed, scale = r[2], (total - r[0]) / r[1]
    return s.select("source", "source_size", "order", F.least(F.col("w") * scale, F.col("most")).alias("target"))


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """0 or 1 for each of a few fractions: the sum of sizes comes as near as it can, then the sum."""
    taken = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    words, count = np.abs(taken @ size - p @ size), np.abs(taken.sum(1) - p.sum())
    return taken[np.lexsort((count.round(6), words.round(6)))[0]].astype(float)


def ladder(size: np.ndarray, rows: np.ndarray, k: int) -> list[int]:
    """k of ``rows`` whose sizes are near the largest one, its half, its quarter and so on: with them any gap can nearly be filled."""
    left = rows[np.lexsort((rows, size[rows]))].tolist()
    top, out = float(size[left[-1]]) if left else 0.0, []
    for j in range(min(k, len(left))):
        i = min(range(len(left)), key=lambda i: abs(size[left[i]] - top / 2**j))
        out.append(left.pop(i))
    return out


def flight(size: np.ndarray, p: np.ndarray, seed: int, land: bool, hold: int = HELD) -> np.ndarray:
    """Moves the fractions ``p`` to 0 or 1 while their sum and their sum of sizes stay.

    At most two stay undecided besides a ladder of ``hold``, which are left as they are; none if ``land``.
    """
    sizes, part = size.astype(float), p.astype(float)
    open_ = np.flatnonzero((part > 0) & (part < 1))
    held = set(ladder(sizes, open_, LANDED if land else hold))
    p, size = part.tolist(), sizes.tolist()
    draw = iter(np.random.default_rng(seed).random(2 * len(p) + 8).tolist())
    active: list[int] = []

    def step(direction: list[float]) -> None:
        """A random step along the direction until a fraction is 0 or 1; either way has the chance that keeps the mean."""
        up = down = np.inf
        for i, u in zip(active, direction, strict=True):
            if u > 0:
                up, down = min(up, (1 - p[i]) / u), min(down, p[i] / u)
            elif u < 0:
                up, down = min(up, -p[i] / u), min(down, (p[i] - 1) / u)
        by = up if next(draw) * (up + down) < down else -down
        for i, u in zip(active, direction, strict=True):
            p[i] += by * u
            if p[i] < SURE or p[i] > 1 - SURE:
                p[i] = float(round(p[i]))
        active[:] = [i for i in active if 0 < p[i] < 1]

    for i in range(len(p)):
        if not 0 < p[i] < 1 or i in held:
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = (size[j] for j in active)
            step([b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0])
    out = np.array(p)
    if land and (rest := sorted({*active, *held})):
        out[rest] = landing(sizes[rest], out[rest])
    return out


def _fly(land: bool, number: int):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(rows, ["order", "block"]):
            order, block = table.column("order").to_numpy(), table.column("block").to_numpy()
            size, p = table.column("size").to_numpy(), table.column("part").to_numpy().copy()
            for a, b in zip(*group_bounds(order, block), strict=True):
                p[a:b] = flight(size[a:b], p[a:b], zlib.crc32(f"{number}:{order[a]}:{block[a]}".encode()), land)
            yield from table.set_column(table.schema.get_field_index("part"), "part", pa.array(p)).to_batches()

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: ``id, source, size, source_size, target, copies``; the mix takes a document ``copies`` times.

    Size is the number of words of the whole text (null: none). Null is a source of its own, the last.
    Sources without words have target 0. Repeated rows are drawn each by itself. Reruns agree:
    documents are numbered by a hash of their id, and equal rows are interchangeable. An empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    return _mix(docs, None, weights, share, ceiling, doc_id, text, source).drop("order")


def _mix(docs: DataFrame, row: str | None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix; ``row`` names a column that goes with each row, as ``at``."""
    size = F.regexp_count(text_or_empty(docs[text]), F.lit(f"[^{BLANKS}]+")).cast("long")
    base = save(docs.select(docs[doc_id].alias("id"), docs[source].cast("string").alias("source"), size.alias("size"), *([docs[row].alias("at")] if row else [])), "sizes")
    more = ["at"] if row else []
    goal = save(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling), "targets")
    rows = ranked(base.withColumn("_null", F.col("source").isNull()).withColumn("_h", F.xxhash64("id")), "_null", "source", "_h", "id", "size", *more)
    rows = save(rows.select("id", "source", "size", "_rank", *more), "numbered")
    # the first number of each source: a row a source
    first = rows.groupBy("source").agg(F.min("_rank").alias("first")).withColumnRenamed("source", "of")
    goal = save(goal.join(first, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), "order", "source_size", "target", "first"), "goal")
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(ceiling))).otherwise(0.0)
    near = F.when(F.abs(times - F.round(times)) < SURE, F.round(times)).otherwise(times)
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", near)
    # the number of blocks of a source is known from its last number
    rows = rows.select("id", "order", F.floor((F.col("_rank") - F.col("first")) / BLOCK).cast("long").alias("block"), "_rank", "size", F.floor("times").cast("long").alias("whole"), (F.col("times") - F.floor("times")).alias("part"), *more)
    left, done, number = rows, [], 0
    while True:
        last = number > 0 and (left.agg(F.max("block")).first()[0] or 0) == 0
        dealt = left.repartition("order", "block").sortWithinPartitions("order", "block", "_rank")
        flown = save(dealt.mapInArrow(_fly(last, number), dealt.schema), f"round{number}")
        done.append(flown.where("part = 0 OR part = 1"))
        left = save(flown.where("part > 0 AND part < 1").withColumn("block", F.floor(F.col("block") / MERGED).cast("long")), f"left{number}")
        number += 1
        if last or left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("id", "order", "size", (F.col("whole") + F.col("part").cast("long")).alias("copies"), *more)
    return out.join(goal, "order").select("id", F.col("of").alias("source"), "size", "source_size", "target", "copies", "order", *more)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept, whatever their types and names.

    Rows are told apart by their place, so repeated rows, rows without an id or with one in common are
    drawn each by itself, and nulls, empty and long texts, ties and an empty table are as in ``mix``. How often
    a row is taken is decided on narrow rows. What most rows of its source have is known from a row a source, and
    only the other rows' numbers go to the texts: by broadcast up to ``common.MAX_BROADCAST`` rows, else by a merge join.
    """
    rows, row = placed_rows(docs)
    of, usual, own, n = (fresh(rows, c) for c in ("_of", "_usual", "_own", "_n"))
    with Phase(docs.sparkSession) as phase:
        drawn = save(_mix(rows, row, doc_id=doc_id, text=text, source=source, **how).select("source", "copies", "at"), "drawn")
        most = drawn.groupBy("source", "copies").count().groupBy("source").agg(F.max_by("copies", F.struct("count", "copies")).alias(usual))
        most = phase.keep(save(most.withColumnRenamed("source", of), "usual"))
        odd = drawn.join(most, F.col("source").eqNullSafe(F.col(of))).where(F.col("copies") != F.col(usual))
        odd = phase.keep(save(odd.select(F.col("at").alias(row), F.col("copies").cast("int").alias(own)), "odd"))
    taken = rows.withColumn(n, F.col(source).cast("string")).join(most, F.col(n).eqNullSafe(F.col(of)))
    taken = taken.join(brought(odd), row, "left").withColumn(n, F.coalesce(own, usual).cast("int")).where(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[f"`{c}`" for c in docs.columns])
