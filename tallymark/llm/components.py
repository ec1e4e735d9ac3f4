"""Connected components by contraction: every round replaces each node by the first of its neighbourhood.

The order of nodes is a hash that changes every second round: two rounds with one order fold
a star, a new order keeps chains short in expectation (Bögeholz, Brand and Todor, 2020).
Rounds work on what is left of the edges, in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Phase, save


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns ``node, root`` for every node of an edge that joins two different nodes."""
    with Phase(edges.sparkSession) as phase:
        both = edges.where("a <> b")
        left = save(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        maps: list[DataFrame] = []
        while not left.isEmpty():
            first = lambda c, k=len(maps) // 2: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("x"))
            rep = left.groupBy("a").agg(F.min(first(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least("m", first(F.col("a")))["x"].alias("rep"))
            rep = save(rep, "rep")
            # one jump along the pointers: they only go to earlier nodes, so there is no cycle
            jump = rep.select(F.col("node").alias("rep"), F.col("rep").alias("next"))
            rep = save(rep.join(jump, "rep").select("node", F.col("next").alias("rep")), "rep2")
            maps.append(rep)
            a, b = rep.toDF("a", "ra"), rep.toDF("b", "rb")
            left = save(left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        out = maps[0].toDF("node", "root") if maps else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
        for rep in maps[1:]:
            out = save(out.join(rep.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        return phase.keep(save(out, "components") if len(maps) < 2 else out)
