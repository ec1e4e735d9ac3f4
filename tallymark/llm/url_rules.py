"""URL filters as a sort-merge range join (DataFrame operations only).

A host is turned into its reversed labels, each closed by U+0000, so that a domain and all
its subdomains form one interval of keys. The intervals nest; what is active at a key is a
chain of rules, the stack. Rules and urls are sorted together by key over ranges of equal
size; inside a range a running last value carries the stack from the rule that opened it,
and the stack that is open at a range's border is handed on from a table with one row a range.
Paths are tested on the stack, deepest rule first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,host:string,path:string,verdict:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by U+0000."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x00"), F.lit("\x00"))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, 'host/path') pairs as a table; the path starts with the first slash."""
    values = ", ".join("('{}', '{}')".format(v, r.replace("\\", "\\\\").replace("'", "\\'")) for v, r in rules)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, rule)")
    slash = F.instr("rule", "/")
    return table.select("verdict", F.substring("rule", F.lit(1), slash - 1).alias("host"), F.col("rule").substr(slash, F.length("rule")).alias("path"))


def _segments(rules: DataFrame) -> DataFrame:
    """key, stack: the rules that hold from this key on. An interval opens with its own chain and, where it ends, its parent's chain goes on."""
    r = rules.select(host_key(F.col("host")).alias("key"), (F.length("host") + F.length("path")).cast("int").alias("size"), "host", "path", "verdict")
    own = r.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("size", "host", "path", "verdict")), asc=False).alias("own"))
    # each interval looks up its ancestors by their exact keys: as many as it has labels
    labels = F.split(F.col("key"), "\x00", -1)
    ancestors = own.select(F.col("key").alias("inner"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "\x00"), F.lit("\x00")))).alias("depth", "key"))
    chain = ancestors.join(own, "key").groupBy("inner").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "own"))).alias("chain"))
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["own"]))
    opens = chain.select(F.col("inner").alias("key"), flat(F.col("chain")).cast(STACK).alias("stack"), F.lit(1).alias("kind"))
    parent = F.slice(F.col("chain"), F.lit(1), F.greatest(F.size("chain") - 1, F.lit(0)))
    close = F.concat(F.expr("substring(inner, 1, length(inner) - 1)"), F.lit("\x01"))
    ends = chain.select(close.alias("key"), flat(parent).cast(STACK).alias("stack"), F.lit(0).alias("kind"))
    return opens.unionByName(ends)


def match_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict``.

    rules: verdict, host, path; the longest fitting rule wins, by the length of host and
    path, then the larger host, path and verdict. Null urls and urls without :// have an
    empty host and path and, like those that no rule fits, rule null and verdict ``default``.
    Repeated rows are judged each by itself. Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(pages[url])
    p = pages.select(pages[page_id].alias("id"), host.alias("host"), path.alias("path"))
    events = p.select(host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), "id", "host", "path", F.lit(None).cast(STACK).alias("stack"))
    segments = _segments(rules).select("key", "kind", F.lit(None).cast(p.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    # the id and path are in the sort key so that one host can fill many ranges
    swept = events.unionByName(segments).repartitionByRange("key", "kind", "path", "id").sortWithinPartitions("key", "kind", "path", "id")
    swept = save(swept.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "sweep")
    inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # one row a range: the stack that its last rule leaves open
    last = swept.where("stack IS NOT NULL").groupBy("range").agg(F.max_by("stack", "at").alias("left"))
    ranges = swept.select("range").distinct().join(last, "range", "left")
    carried = ranges.select("range", F.last("left", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    stack = F.coalesce(F.last("stack", ignorenulls=True).over(inside), F.col("carried"))
    fits = lambda r: F.col("path").startswith(r["path"]) & ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"])))
    best = F.array_max(F.filter("open", fits))
    # a row a range: bounded by the number of shuffle partitions
    out = swept.join(F.broadcast(carried), "range").withColumn("open", stack).where("kind = 2").withColumn("best", best)
    return out.select("id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
