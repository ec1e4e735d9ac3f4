"""SimHash near-dedup with BK-trees.

Fingerprints that differ in at most three bits agree in at least two of five blocks of bits.
So each pair of blocks deals the distinct fingerprints out into shards, and every link is found
inside some shard. A shard is held in a BK-tree, children keyed by their Hamming distance to
the parent; all its members descend it together, following only the edges within the radius.
Shards over a bound are dealt out again by four parts of their remaining bits, one of which must
agree. A shard gives its links as a spanning forest, not as pairs, and components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Phase, batches, beside_groups, group_bounds, save, sorted_groups, text_or_empty
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: First bit and width of each block.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Distinct fingerprints of a shard that one task takes at once; larger shards are dealt out again.
SHARD = 20_000
CHUNK = 1 << 16


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words, of all words if there are fewer; empty without words."""
    words = text.lower().split()  # on bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h64 = xxhash.xxh64_intdigest
    return np.fromiter((h64(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; zero without words. Signed."""
    found, total = shingles(text, width), np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        h = found[at : at + CHUNK].astype("<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(found), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())], ["id", "fp"])


def forest(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the different fingerprints the smallest index it is linked to, through others if need be.

    A BK-tree is grown and searched by all members at once: a node's subtree is split by the
    distance to the node, and a member goes on to the children whose distance differs by at most the radius.
    """
    x = x.view(np.uint64)
    parent = np.arange(len(x))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    everyone = np.arange(len(x))
    todo = [(everyone, everyone)]
    while todo:
        tree, who = todo.pop()
        node, rest = tree[0], tree[1:]
        d_who = np.bitwise_count(x[who] ^ x[node])
        for i in who[d_who <= radius].tolist():
            a, b = find(i), find(int(node))
            if a != b:
                parent[max(a, b)] = min(a, b)
        if not len(rest):
            continue
        d_rest = np.bitwise_count(x[rest] ^ x[node])
        for d in np.unique(d_rest).tolist():
            near = who[np.abs(d_who.astype(np.int16) - d) <= radius]
            if len(near):
                todo.append((rest[d_rest == d], near))
    return np.array([find(i) for i in range(len(x))])


def _links(keys: list[str]):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(rows, keys):
            fp = table.column("fp").to_numpy()
            starts, ends = group_bounds(*[table.column(k).to_numpy() for k in keys])
            a, b = [], []
            for i in np.flatnonzero(ends - starts > 1):
                part = fp[starts[i] : ends[i]]
                root = part[forest(part)]
                a.append(part[part != root])
                b.append(root[part != root])
            if a and len(a := np.concatenate(a)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _mask(width: int) -> Column:
    return F.lit((1 << width) - 1)


def _dealt(fps: DataFrame, limit: int) -> list[tuple[DataFrame, list[str]]]:
    """Shards as (rows, key columns); no shard has over ``limit`` fingerprints until 3 further deals leave few bits free."""
    part = lambda b: F.shiftrightunsigned("fp", b[0]).bitwiseAND(_mask(b[1]))
    shards = []
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        key = F.lit(k).cast("long") * (1 << 32) + F.shiftleft(part(BLOCKS[i]), 13) + part(BLOCKS[j])
        free = [b for n, b in enumerate(BLOCKS) if n not in (i, j)]
        rest, at = F.lit(0).cast("long"), 0
        for b in free:
            rest, at = rest.bitwiseOR(F.shiftleft(part(b), at)), at + b[1]
        shards.append(F.struct(key.alias("key"), rest.alias("rest"), F.lit(at).alias("bits")))
    rows = fps.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.key", "s.rest", "s.bits")
    out, keys = [], ["key"]
    for level in range(4):
        large = save(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys), "large") if level < 3 else None
        if large is None or large.isEmpty():
            out.append((rows.select("fp", *keys), keys))
            break
        out.append((rows.join(large, keys, "left_anti").select("fp", *keys), keys))
        rows = _deal_again(rows.join(large, keys), f"sub{level}")
        keys = [*keys, f"sub{level}"]
    return out


def _deal_again(rows: DataFrame, name: str) -> DataFrame:
    parts = []
    for s in range(4):
        width = F.expr(f"bits div 4 + IF(bits % 4 > {s}, 1, 0)").cast("int")
        off = F.expr(f"(bits div 4) * {s} + LEAST(bits % 4, {s})").cast("int")
        shl, shr = lambda v, n: F.call_function("shiftleft", v, n), lambda v, n: F.call_function("shiftrightunsigned", v, n)
        one = F.lit(1).cast("long")
        value = shr(F.col("rest"), off).bitwiseAND(shl(one, width) - 1)
        rest = F.col("rest").bitwiseAND(shl(one, off) - 1).bitwiseOR(shl(shr(F.col("rest"), (off + width).cast("int")), off))
        parts.append(F.struct((value * 4 + s).alias(name), rest.alias("rest"), (F.col("bits") - width).cast("int").alias("bits")))
    keep = [c for c in rows.columns if c not in ("rest", "bits")]
    return rows.select(*keep, F.explode(F.array(*parts)).alias("s")).select(*keep, f"s.{name}", "s.rest", "s.bits")


def links(fps: DataFrame, limit: int = SHARD) -> DataFrame:
    """fps: distinct fp. Returns edges a, b that join exactly the fingerprints within the radius, as forests."""
    out = None
    for rows, keys in _dealt(fps, limit):
        found = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp").mapInArrow(_links(keys), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD) -> DataFrame:
    """One row per input row: ``id, fp`` (signed long) and ``component_id``, the smallest id that links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids are
    never a component's id unless it has no other. Rows that share an id each keep their own text's component.
    Other columns of ``docs`` are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    prints = docs.select(docs[doc_id].alias("id"), text_or_empty(docs[text]).cast("binary").alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp long")
    prints = save(prints, "prints")
    with Phase(docs.sparkSession) as phase:
        distinct = save(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
        roots = components(links(distinct.select("fp"), limit))
        member = save(distinct.drop("n").join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least"), "member")
        least = save(member.groupBy("root").agg(F.min("least").alias("of"), F.count(F.lit(1)).alias("n")), "least")
        linked = beside_groups(member.drop("least"), least, "root").select("fp", "of")
        named = phase.keep(save(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("of", "least").alias("component_id")), "named"))
    return beside_groups(prints, named, "fp").select("id", "fp", "component_id")
