"""Comparisons without cells: digests, schemas, manifests, file lists, litmus checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, identity
from .reconcile import EXTRA, MISSING, VALUE

# --- digests ----------------------------------------------------------------


def row_hash(df: DataFrame, keys: Sequence[str], columns: Sequence[str], algorithm: str = "xxhash64") -> tuple[Column, Column]:
    """Canonical key text and the hash of key and cells."""
    key = identity.uid(identity.key_parts(df, keys))
    return key, identity.fingerprint([key, *[canon.text(df[c]) for c in columns]], algorithm)


def digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], partitions: int | None = None, algorithm: str = "xxhash64") -> DataFrame:
    """Order-free digest of all rows, or of each partition of keys: xor, sum and count.

    Pairs of equal rows cancel in the xor; the sum and the count do not let them.
    """
    key, h = row_hash(df, keys, columns, algorithm)
    total = F.sum(h.cast("decimal(38,0)"))
    aggs = [F.bit_xor(h).alias("xor_digest"), F.pmod(total, F.lit(1 << 62).cast("decimal(38,0)")).cast("long").alias("sum_digest"), F.count(F.lit(1)).alias("rows")]
    if partitions is None:
        return df.agg(*aggs)
    return df.groupBy(identity.partition_id(key, partitions, algorithm).alias("partition_id")).agg(*aggs)


def unlike_partitions(source: DataFrame, target: DataFrame) -> DataFrame:
    """partition_id of digests that differ: only these need to be joined."""
    cols = ["xor_digest", "sum_digest", "rows"]
    t = target.select("partition_id", *[F.col(c).alias(f"t_{c}") for c in cols])
    j = source.join(t, "partition_id", "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return j.where(~same).select("partition_id")


def identical(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> bool:
    """Whether both sides hold the same rows, by their digests."""
    return digest(source, keys, columns).first() == digest(target, keys, columns).first()


def identical_files(spark: SparkSession, source: str, target: str) -> bool:
    """Equal sizes, then equal content digests; contents are only read where all sizes agree."""

    def files(path: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def alike(*columns: Column) -> bool:
        """Whether both folders have the same files by these columns, each as often."""
        side = lambda p, n: files(p).select(*columns, F.lit(n).alias("n"))
        both = side(source, 1).unionByName(side(target, -1))
        return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()

    return alike(F.col("length")) and alike(F.col("length"), F.sha2("content", 256).alias("digest"))


# --- schemas ----------------------------------------------------------------


def schema_frame(df: DataFrame) -> DataFrame:
    """name, type, nullable, position, precision, scale of a DataFrame's columns."""
    rows = []
    for i, f in enumerate(df.schema):
        rows.append((f.name, f.dataType.simpleString(), f.nullable, i, getattr(f.dataType, "precision", None), getattr(f.dataType, "scale", None)))
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, position int, precision int, scale int")


def schema_diff(source: DataFrame, target: DataFrame, harmonized: bool = False, mapping: dict[str, str] | None = None) -> DataFrame:
    """column_name, issue, source_value, target_value.

    source, target: schema frames. ``harmonized`` compares type families and also nullability,
    precision and scale; ``mapping`` renames source columns.
    """
    families = [F.lit(x) for t, names in canon.FAMILIES.items() for n in names for x in (n, t)]
    bare = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\(.*\)", "")))
    family = lambda c: F.coalesce(F.create_map(*families)[bare(c)], bare(c)) if harmonized else c
    rename = F.create_map(*[F.lit(x) for kv in (mapping or {}).items() for x in kv]) if mapping else None
    name = F.coalesce(rename[F.col("name")], F.col("name")) if mapping else F.col("name")
    extra = ["nullable", "precision", "scale"]
    s = source.select(name.alias("column_name"), F.lit(True).alias("s"), F.col("type").alias("s_type"), *[F.col(c).cast("string").alias(f"s_{c}") for c in extra])
    t = target.select(F.col("name").alias("column_name"), F.lit(True).alias("t"), F.col("type").alias("t_type"), *[F.col(c).cast("string").alias(f"t_{c}") for c in extra])
    j = s.join(t, "column_name", "full_outer")
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    issue = lambda when, what, a, b: F.when(when, F.struct(F.lit(what).alias("issue"), a.alias("source_value"), b.alias("target_value")))
    no = F.lit(None).cast("string")
    found = [
        issue(F.col("t").isNull(), MISSING, F.col("s_type"), no), issue(F.col("s").isNull(), EXTRA, no, F.col("t_type")),
        issue(both & (family(F.col("s_type")) != family(F.col("t_type"))), "type_mismatch", F.col("s_type"), F.col("t_type")),
    ]
    if harmonized:
        found += [issue(both & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), f"{c}_mismatch", F.col(f"s_{c}"), F.col(f"t_{c}")) for c in extra]
    return j.select("column_name", F.explode(F.array_compact(F.array(*found))).alias("i")).select("column_name", "i.*")


# --- manifests and file lists -------------------------------------------------

MANIFEST_FIELDS = ("compressed_size", "uncompressed_size", "crc32", "compress_type")


def manifest_diff(source: DataFrame, target: DataFrame, fields: Sequence[str] = MANIFEST_FIELDS) -> DataFrame:
    """Entries of two archives joined by path: uid, mismatch_type, column_name, source_value, target_value."""
    pick = lambda df, t: df.where("path <> ''").select("path", F.lit(True).alias(t), *[F.col(f).cast("string").alias(f"{t}_{f}") for f in fields])
    j = pick(source, "s").join(pick(target, "t"), "path", "full_outer")
    no = F.lit(None).cast("string")
    cell = lambda kind, c, a, b: F.struct(F.lit(kind).alias("mismatch_type"), (F.lit(c) if c else no).alias("column_name"), a.alias("source_value"), b.alias("target_value"))
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    found = [F.when(F.col("t").isNull(), cell(MISSING, None, no, no)), F.when(F.col("s").isNull(), cell(EXTRA, None, no, no))]
    found += [F.when(both & ~F.col(f"s_{f}").eqNullSafe(F.col(f"t_{f}")), cell(VALUE, f, F.col(f"s_{f}"), F.col(f"t_{f}"))) for f in fields]
    return j.select(F.col("path").alias("uid"), F.explode(F.array_compact(F.array(*found))).alias("c")).select("uid", "c.*")


def pair_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_path, target_path: paths whose base names are unique on both sides are paired, the others are left over.

    source, target: path. Of several sources with one name the first path takes the target.
    """
    name = F.element_at(F.split("path", "/"), -1)
    t = target.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target_path")).where("n = 1").drop("n")
    s = source.groupBy(name.alias("name")).agg(F.min("path").alias("source_path"))
    pairs = s.join(t, "name").select("source_path", "target_path")
    no = F.lit(None).cast("string")
    left = source.join(pairs, source.path == pairs.source_path, "left_anti").select(F.col("path").alias("source_path"), no.alias("target_path"))
    right = target.join(pairs, target.path == pairs.target_path, "left_anti").select(no.alias("source_path"), F.col("path").alias("target_path"))
    return pairs.unionByName(left).unionByName(right)


def map_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_column, target_column of columns whose letters and digits agree, each used once, in order.

    source, target: name, position.
    """
    from pyspark.sql import Window

    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    nth = F.row_number().over(Window.partitionBy("k").orderBy("position"))
    side = lambda df, n: df.select(key.alias("k"), F.col("name").alias(n), "position").where("k <> ''").withColumn("nth", nth).drop("position")
    return side(source, "source_column").join(side(target, "target_column"), ["k", "nth"]).select("source_column", "target_column")


# --- litmus -----------------------------------------------------------------


def litmus(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_rows, target_rows, same_rows, same_columns: both counts in one job."""
    both = source.select(F.lit(1).alias("s")).unionByName(target.select(F.lit(0).alias("s")))
    out = both.agg(F.count_if(F.col("s") == 1).alias("source_rows"), F.count_if(F.col("s") == 0).alias("target_rows"))
    return out.withColumn("same_rows", F.col("source_rows") == F.col("target_rows")).withColumn("same_columns", F.lit(source.columns == target.columns))


def is_match(counts: DataFrame) -> DataFrame:
    """status counts with ``is_match``: nothing missing, extra or changed."""
    return counts.withColumn("is_match", F.col("missing") + F.col("extra") + F.col("changed") == 0)


def is_empty(lines: DataFrame, column: str = "value") -> bool:
    """No line with text."""
    return lines.where(canon.strip(F.col(column)) != "").isEmpty()


def parsed_enough(rows: int, size_bytes: int, least: int = 256 << 10, floor: int = 1) -> None:
    """Raises if a large input gave hardly any rows."""
    if size_bytes >= least and rows < floor:
        raise ValueError(f"{size_bytes} bytes gave {rows} rows")
