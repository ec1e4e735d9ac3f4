"""Sharding by a k-d tree over document metadata (DataFrame operations only).

Every level splits all its nodes at once. A node's widest dimension is found by one
aggregation; its weighted median is found digit by digit: documents are counted into the
node's 2,048 bins, running sums pick the bin that holds the median, and the next pass looks
inside that bin only, until it holds one document. Nothing but a row per node and bin is
shuffled, and the driver sees one row per node. Ties of a coordinate are ordered by a hash
of the document, so a node splits at the wanted weight whatever its values.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, text_or_empty

BITS, DIGIT, COORD, TIE = 62, 11, 30, 32
MAX_SHARDS = 1 << 16


def category(value: Column) -> Column:
    """A coordinate for a name: its place by hash; null comes first."""
    return F.when(value.isNull(), F.lit(-1.0)).otherwise(F.shiftrightunsigned(F.xxhash64(value), 33).cast("double"))


def _nodes(docs: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """The node table, at most a row a shard, inline."""
    return docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{int(x)}L" for x in r) + ")" for r in rows) + f" AS t({names})")


def kd_shards(docs: DataFrame, size: Column, dims: dict[str, Column], tie: Column, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``_size``, ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Either ``shards`` leaves of nearly equal size, or as many as bring a leaf to ``target_bytes``.
    Null coordinates count as the smallest. An empty table gives no rows. ``docs`` should be narrow: it is written once.
    """
    taken = {"_size", "_tie", "_tag", "_node", "_c", "shard", "slot"}
    if taken & set(docs.columns):
        raise ValueError(f"reserved columns: {sorted(taken & set(docs.columns))}")
    k = len(dims)
    base = docs.withColumns({"_size": size.cast("long"), "_tie": tie, "_c": F.array(*[F.coalesce(c.cast("double"), F.lit(float("-inf"))) for c in dims.values()])})
    base = save(base.withColumn("_tag", F.monotonically_increasing_id()), "narrow")
    # 24 bits tell documents apart, 8 more the repeated rows of one document
    base = base.withColumn("_tie", F.shiftleft(F.shiftrightunsigned("_tie", 40), 8).bitwiseOR(F.shiftrightunsigned(F.xxhash64("_tag"), 56)))
    finite = lambda j: F.when(F.col("_c")[j] > float("-inf"), F.col("_c")[j])
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("w"), *[f(finite(j)).alias(f"{f.__name__}{j}") for j in range(k) for f in (F.min, F.max)]).first()
    shards = shards or max(1, -(-(stats["w"] or 0) // (target_bytes or 1)))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards; at most {MAX_SHARDS}")
    top = (1 << COORD) - 1

    def scaled(j: int) -> Column:
        lo, hi = stats[f"min{j}"], stats[f"max{j}"]
        if lo is None or hi <= lo:
            return F.lit(0)
        c = F.col("_c")[j]
        return F.when(c > float("-inf"), F.least(F.floor((c - F.lit(lo)) * F.lit((top - 1) / (hi - lo))) + 1, F.lit(top))).otherwise(F.lit(0)).cast("int")

    base = base.withColumn("_c", F.array(*[scaled(j) for j in range(k)]))
    base = base.withColumn("_node", F.lit(0).cast("long"))
    nodes = {0: (shards, stats["w"] or 0)}  # node: shards below it, its weight; a node's number is its first shard
    while stats["n"] and any(n > 1 for n, _ in nodes.values()):
        base, nodes = _split(base, nodes, k)
    return _slots(base.withColumn("shard", F.col("_node").cast("int")).drop("_c", "_node", "_tie"))


def _key(c: Column, dim: Column) -> Column:
    return F.shiftleft(F.element_at(c, dim.cast("int") + 1).cast("long"), TIE).bitwiseOR(F.col("_tie"))


def _split(base: DataFrame, nodes: dict[int, tuple[int, int]], k: int) -> tuple[DataFrame, dict]:
    """One level: every node with several shards is cut at the weight of its first half of them."""
    spread = base.groupBy("_node").agg(*[(F.max(F.col("_c")[j]) - F.min(F.col("_c")[j])).alias(f"s{j}") for j in range(k)]).collect()
    # node: dim, prefix, weight wanted on the left below the prefix
    state = {}
    for r in spread:
        n, w = nodes[r["_node"]]
        if n > 1:
            state[r["_node"]] = [max(range(k), key=lambda j: (r[f"s{j}"], -j)), 0, w * (n // 2) / n]
    cut: dict[int, int] = {}
    dims = {node: s[0] for node, s in state.items()}
    shift = BITS
    while shift > 0 and state:
        was, shift = shift, max(0, shift - DIGIT)
        table = F.broadcast(_nodes(base, [(node, s[0], s[1]) for node, s in state.items()], "_node, _dim, _prefix"))
        key = _key(F.col("_c"), F.col("_dim"))
        part = base.join(table, "_node").withColumn("_key", key).where(F.shiftright("_key", was) == F.col("_prefix"))
        bins = part.groupBy("_node", F.shiftright("_key", shift).alias("bin")).agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("w").over(Window.partitionBy("_node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        want = F.broadcast(base.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({node}L, {s[2]!r}D)" for node, s in state.items()) + " AS t(_node, want)"))
        crossed = bins.withColumn("upto", upto).join(want, "_node").where("upto >= want")
        for r in crossed.groupBy("_node").agg(F.min(F.struct("bin", "w", "n", "upto")).alias("b")).collect():
            b, s = r["b"], state[r["_node"]]
            s[1], s[2] = b["bin"], s[2] - (b["upto"] - b["w"])
            if b["n"] == 1 or shift == 0:  # the document at the median goes to the side that it leaves nearer to the wanted weight
                cut[r["_node"]] = (b["bin"] + (s[2] * 2 > b["w"])) << shift
        state = {node: s for node, s in state.items() if node not in cut}
    out = _nodes(base, [(node, dims[node], at, node + nodes[node][0] // 2) for node, at in cut.items()], "_node, _dim, _at, _right")
    joined = base.join(F.broadcast(out), "_node", "left")
    moved = F.when(F.col("_dim").isNotNull() & (_key(F.col("_c"), F.coalesce("_dim", F.lit(0))) >= F.col("_at")), F.col("_right")).otherwise(F.col("_node"))
    base = save(joined.withColumn("_node", moved).drop("_dim", "_at", "_right"), "level")
    weights = {r["_node"]: r["w"] for r in base.groupBy("_node").agg(F.sum("_size").alias("w")).collect()}
    made = {}
    for node, (n, _) in nodes.items():
        for child, m in ((node, n // 2), (node + n // 2, n - n // 2)) if node in cut else ((node, 1),):
            made[child] = (m, weights.get(child, 0))
    return base, {c: v for c, v in made.items() if c in weights}


def _slots(base: DataFrame) -> DataFrame:
    """Numbers each shard's rows without gaps: rows are range-sorted, and a table with a row per range and shard says where each begins."""
    s = save(base.repartitionByRange("shard", "_tag").sortWithinPartitions("shard", "_tag").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    parts = s.groupBy("shard", F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    parts = F.broadcast(parts.withColumn("_before", before).drop("n"))
    out = s.withColumn("_range", F.shiftright("_at", 33)).join(parts, ["shard", "_range"])
    return out.withColumn("slot", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_first", "_before", "_at", "_tag")


def document_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, size, crc, shard, slot`` of documents: size is the UTF-8 bytes of the text (null: none) plus one.

    The dimensions are the length, the language, the source and the id; a missing column is left out. Null
    coordinates, null ids too, come first in their dimension. Rows that tie in a coordinate are ordered by a hash of
    id and text, repeated rows by one of their place, so they may be in different shards; each has a slot of its own.
    A text that is larger than a shard leaves others empty. An empty table gives no rows. Other columns of
    ``docs`` are not read, whatever their names.
    """
    t = text_or_empty(docs[text])
    have = {c: docs[c] for c in ("n_chars", "lang", "source") if c in docs.columns and c not in (doc_id, text)}
    extra = {f"m_{c}": (v.cast("double") if c == "n_chars" else category(v.cast("string"))) for c, v in have.items()}
    narrow = docs.select(docs[doc_id].alias("id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("crc"), *[v.alias(c) for c, v in extra.items()])
    dims = {c: F.col(c) for c in extra} | {"m_id": F.xxhash64("id").cast("double") if narrow.schema["id"].dataType.typeName() not in ("long", "integer") else F.col("id").cast("double")}
    out = kd_shards(narrow, F.col("size"), dims, F.xxhash64("id", "crc"), shards=shards)
    return out.select("id", "size", "crc", "shard", "slot")


__all__ = ["category", "document_shards", "kd_shards"]
