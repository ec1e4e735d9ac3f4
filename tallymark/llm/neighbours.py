"""Approximate nearest neighbours with a hash-prefix forest (Bawa, Condie and Ganesan, 2005).

Vectors are indexed in blocks. A block has TREES sorted arrays of hash strings of LENGTH bits, the
signs of random projections. A query descends every array by binary search to its longest matching
prefix, and then ascends all arrays together: at each prefix length the stretches that share it are
met, and what is new in them is scored. How far it goes is set by the wanted recall: it stops at the
prefix length at which a vector as near as its k-th best so far would have been met in some tree with
that chance. So the number of candidates follows from the data and has no cap: near neighbours end the
ascent after few of them, and a query without any goes up to the root. Scores are exact cosines of the
original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, save

TREES, LENGTH, SEED = 64, 32, 7
#: Bytes of query vectors that are broadcast at once; more queries are searched chunk by chunk.
CHUNK_BYTES = 16 << 20
BLOCK = 1 << 15
SAME = 1e-12


def usable(v: Column) -> Column:
    """Not null, not zero, and no null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """The sorted arrays of one block: of each tree its hash strings in order, and which row each one is of."""

    def __init__(self, rows: np.ndarray):
        self.planes = np.random.default_rng(SEED).standard_normal((rows.shape[1], TREES * LENGTH)).astype(np.float32)
        strings = self.strings(rows)
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """Of each tree (row) the hash string of each vector, as a number."""
        out = np.empty((TREES, len(rows)), np.int64)
        for at in range(0, len(rows), 2048):
            bits = (rows[at : at + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, TREES, LENGTH)
            out[:, at : at + 2048] = np.packbits(bits, axis=2).view(">u4")[:, :, 0].T
        return out

    def longest(self, strings: np.ndarray) -> np.ndarray:
        """Of each query the length of its longest match in any tree: one of the neighbours of its place in the sorted array has it."""
        out = np.zeros(strings.shape[1], np.int64)
        for mine, theirs in zip(strings, self.sorted, strict=True):
            at = np.searchsorted(theirs, mine)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(theirs) - 1)):
                out = np.maximum(out, LENGTH - np.frexp((mine ^ theirs[near]).astype(float))[1])
        return out

    def stretches(self, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query where the strings begin and end that share the query's prefix of its ``length``."""
        low = strings >> (LENGTH - length) << (LENGTH - length)
        high = low + (1 << (LENGTH - length))
        return tuple(np.stack([np.searchsorted(a, x) for a, x in zip(self.sorted, side, strict=True)]) for side in (low, high))

    def met(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which rows are in a stretch of some tree."""
        out = np.zeros(self.order.shape[1], bool)
        for t in np.flatnonzero(end > begin):
            out[self.order[t, begin[t] : end[t]]] = True
        return out


def enough(score: float, recall: float) -> int:
    """The longest prefix that a vector of this cosine shares with a query in some tree with the wanted chance; shorter ones all the more."""
    if score >= 1 - 1e-12:
        return LENGTH
    p = 1 - math.acos(max(-1.0, score)) / math.pi
    return max(0, min(LENGTH, math.floor(math.log(1 - (1 - recall) ** (1 / TREES)) / math.log(p)))) if p > 0 else 0


class Best:
    """The k best rows for one query id so far; ties go to the smaller id. ``row`` tells candidates apart."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, query: np.ndarray, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        """Products of all rows are rough to rounding; those that may count are computed again, each by itself."""
        rough = rows @ query
        kth = max(self.kth, np.partition(rough, -self.k)[-self.k]) if len(rough) > self.k else self.kth
        near = np.flatnonzero(rough >= kth - SAME)
        s, i, r = np.append(self.score, (rows[near] * query).sum(1)), np.append(self.id, ids[near]), np.append(self.row, numbers[near])
        order = np.lexsort((r, i, -s))
        _, first = np.unique(r[order], return_index=True)  # a row that several vectors of the query id meet counts once, by the nearest
        order = order[np.sort(first)][: self.k]
        self.score, self.id, self.row = s[order], i[order], r[order]

    @property
    def kth(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -1.0


def search_block(best: dict[int, Best], q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, recall: float, first: int = 0) -> int:
    """Looks for every query in one block of unit rows, the numbers of which begin at ``first``. Returns how many rows were scored."""
    forest, scored = Forest(rows), 0
    strings = forest.strings(queries)
    length = forest.longest(strings)
    done: dict[int, np.ndarray] = {}
    active = np.arange(len(queries))
    while len(active):
        begin, end = forest.stretches(strings[:, active], length[active])
        rest = []
        for n, q in enumerate(active.tolist()):
            met = forest.met(begin[:, n], end[:, n])
            new = met & ~done[q] if q in done else met
            new = np.flatnonzero(new & (ids != q_ids[q]))
            own = best[int(q_ids[q])]
            if len(new):
                scored += len(new)
                own.add(queries[q], rows[new], ids[new], first + new)
            goal = enough(own.kth, recall)
            if length[q] > goal:
                # half of the way, as a better k-th best on it ends the ascent earlier
                length[q] -= max(1, (length[q] - goal) // 2)
                done[q] = met
                rest.append(q)
            else:
                done.pop(q, None)
        active = np.array(rest, np.int64)
    return scored


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score``: each query's k nearest found by cosine, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without an id. A query's candidates are all rows of other ids and of its own number of
    components; if there are fewer than k, all are given. Rows that share an id are candidates each by
    itself. Repeated rows of a query are one query; different vectors of one query id are searched
    together, and each candidate counts with the nearest of them. An empty table gives no rows. Other
    columns of ``vectors`` are not read, whatever their names.
    """
    good = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[embedding].cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = save(good.where("asks").select("id", "v").distinct(), "queries")
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    sc, parts = vectors.sparkSession.sparkContext, []
    for c in range(chunks):
        by_size: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).collect():  # about CHUNK_BYTES
            by_size.setdefault(len(r["v"]), []).append(r)
        shared = sc.broadcast({n: (np.array([r["id"] for r in own], np.int64), unit(np.array([r["v"] for r in own], float))) for n, own in by_size.items()})
        # every task gives at most k rows a query
        parts.append(save(good.select("id", "v").mapInArrow(_searcher(shared, k, recall), "query_id long, vec_id long, score double"), "found"))
        shared.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, recall: float):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, first = shared.value, 0
        best = {int(i): Best(k) for ids, _ in queries.values() for i in ids}
        for batch in blocks(rows, BLOCK):
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            sizes = v.value_lengths().to_numpy()
            for n in set(sizes.tolist()) & queries.keys():
                at = np.flatnonzero(sizes == n)
                x = v.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)
                search_block(best, *queries[n], ids[at], unit(x), recall, first)
                first += len(at)
        if best:
            q = np.repeat(np.array(list(best), np.int64), [len(b.id) for b in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([b.id for b in best.values()]), pa.int64()), pa.array(np.concatenate([b.score for b in best.values()]), pa.float64())], ["query_id", "vec_id", "score"])

    return run
