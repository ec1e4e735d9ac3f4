"""Readers: every supported format as a DataFrame.

Delimited and fixed-width inputs are all text columns; types are a matter of the comparison.
Paths are Hadoop paths, so object stores need no code of their own, and compressed files are
decompressed by Spark's codecs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import scratch_path, write_bytes

# File name endings by format.
SUFFIXES = {
    ".csv": "csv", ".tsv": "csv", ".psv": "csv", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".avro": "avro",
    ".xlsx": "excel", ".xls": "excel", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".zip": "zip", ".tar": "tar", ".tgz": "tar",
}
AMBIGUOUS = (".txt", ".dat")
COMPRESSED = (".gz", ".bz2", ".zip", ".zst")
# Other names of formats.
ALIASES = {
    "tsv": "csv", "psv": "csv", "text": "csv", "delimited": "csv", "ndjson": "json", "jsonl": "json", "fixedwidth": "fixed-width", "fixed": "fixed-width", "fw": "fixed-width",
    "xlsx": "excel", "xls": "excel", "pq": "parquet", "tgz": "tar", "tar.gz": "tar", "targz": "tar", "tar-gz": "tar", "detect": "auto", "": "csv",
}
#: Characters that do not occur in text, for readers that must not split or quote.
NO_CHAR = "\x00"


def normal_format(name: str | None) -> str:
    token = (name or "csv").strip().lower().replace("_", "-")
    return ALIASES.get(token, token if token in {"csv", "json", "parquet", "orc", "avro", "excel", "fixed-width", "zip", "tar", "auto"} else "csv")


def format_of_path(path: str, requested: str | None = None) -> str:
    """The requested format, or for auto and csv the one of the file name's ending."""
    fmt = normal_format(requested)
    if fmt not in ("auto", "csv"):
        return fmt
    name = path.rsplit("/", 1)[-1].lower()
    return next((f for s, f in SUFFIXES.items() if name.endswith(s)), "csv")


def synthetic_names(n: int) -> list[str]:
    return [f"column_{i}" for i in range(1, n + 1)]


def first_lines(spark: SparkSession, path: str | list[str], n: int = 100, skip: int = 0) -> list[str]:
    """The first non-blank lines of a text input after ``skip`` physical ones; limit stops after the first partitions."""
    lines = spark.read.text(path) if not skip else numbered_lines(spark, path).where(F.col("line") > skip).orderBy("line")
    return [r["value"].removeprefix("\ufeff").rstrip("\r") for r in lines.where(F.trim("value") != "").limit(n).collect()]


def read_delimited(
    spark: SparkSession, path: str | list[str], delimiter: str = ",", header: bool = True, names: Sequence[str] | None = None,
    skip_rows: int = 0, columns: Sequence[str] | None = None, encoding: str = "UTF-8", multi_line: bool | None = None, on_ragged: str = "pad",
    skip_end: int = 0, quote: str = '"',
) -> DataFrame:
    """Delimited text with any delimiter, RFC 4180 quotes, all columns text.

    Short rows are padded with null and long ones cut; with ``on_ragged="flag"`` a column ``_ragged`` marks them.
    ``multi_line`` allows quoted line breaks but makes a file one split; if it is not given, a parallel scan for a line
    with an odd number of quotes decides.
    ``skip_rows`` drops leading lines of the (single) file before the header, ``skip_end`` its last lines; such
    files are read by line, so quoted line breaks are not allowed in them. ``quote`` is the dialect's quote character.
    """
    if skip_rows or skip_end:
        return _skipped(spark, path, delimiter, header, names, skip_rows, skip_end, columns, quote)
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path, quote)
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("emptyValue", "").option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", multi_line)
    if names is None:
        probe = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("encoding", encoding).option("multiLine", multi_line).option("header", False)
        first = probe.csv(path).limit(1).collect()
        cells = [(c or "").removeprefix("\ufeff").strip() for c in first[0]] if first else []
        names = [c or f"column_{i + 1}" for i, c in enumerate(cells)] if header else synthetic_names(len(cells))
    names = unique(names)
    fields = [T.StructField(n, T.StringType()) for n in names]
    if on_ragged == "flag":
        reader = reader.option("columnNameOfCorruptRecord", "_broken")
        fields.append(T.StructField("_broken", T.StringType()))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    df = reader.option("header", header).option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
    if on_ragged == "flag":
        df = df.withColumn("_ragged", F.col("_broken").isNotNull()).drop("_broken")
    # rows without any cell are blank lines
    df = df.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def read_delimited_bytes(spark: SparkSession, content: bytes, **how: object) -> DataFrame:
    """Delimited text that the driver holds, such as an upload or an open file's content: it is put where executors can read it."""
    return read_delimited(spark, write_bytes(spark, scratch_path(spark, "upload.csv"), content), **how)


def has_quoted_breaks(spark: SparkSession, path: str | list[str], quote: str = '"') -> bool:
    """Whether a quote stays open at the end of some line; reading stops at the first."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(value.contains(quote) & (quotes % 2 == 1)).isEmpty()


def text_traits(spark: SparkSession, path: str | list[str], quote: str = '"') -> Row:
    """breaks (a quote stays open at the end of some line), brackets (some line has an opening bracket), lines (with text), in one pass."""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2 == 1
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    rows = spark.read.text(path).select(odd.alias("odd"), value.rlike(r"[\[{(]").alias("bracket"), (F.trim("value") != "").alias("text"))
    return rows.agg(any_("odd").alias("breaks"), any_("bracket").alias("brackets"), F.count_if("text").alias("lines")).first()


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, line: a file's physical lines with their numbers from 1, however many splits it has.

    The splits of one file are in order; a table with a row a split says where each begins. Lines of several files are numbered on.
    """
    at = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    parts = at.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    parts = F.broadcast(parts.select("_part", before.alias("_before")))
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("_part", F.shiftright("_at", 33)).join(parts, "_part").select("value", (F.col("_before") + low + 1).alias("line"))


def unique(names: Sequence[str]) -> list[str]:
    """Repeated names get a number."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _skipped(
    spark: SparkSession, path: str | list[str], delimiter: str, header: bool, names: Sequence[str] | None, skip: int, skip_end: int, columns: Sequence[str] | None, quote: str,
) -> DataFrame:
    """A file without its first and last lines: lines are dropped by their number and then parsed one by one."""
    lines = numbered_lines(spark, path)
    if skip_end:
        total = spark.read.text(path).count()
        lines = lines.where(F.col("line") <= total - skip_end)
    body = lines.where((F.col("line") > skip) & (F.trim("value") != ""))
    if header or names is None:
        first = body.orderBy("line").limit(1).collect()
        if not first:
            return spark.createDataFrame([], T.StructType([]))
        cells = split_line(first[0]["value"].removeprefix("\ufeff").rstrip("\r"), delimiter, quote)
        names = names or ([c.strip() or f"column_{i + 1}" for i, c in enumerate(cells)] if header else synthetic_names(len(cells)))
        body = body.where(F.col("line") != first[0]["line"]) if header else body
    names = unique(names)
    ddl = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    parsed = body.select(F.from_csv(F.regexp_replace("value", "\r$", ""), F.lit(ddl), {"sep": delimiter, "quote": quote, "escape": quote, "emptyValue": ""}).alias("r")).select("r.*")
    return parsed.select(*[f"`{c}`" for c in columns]) if columns else parsed


def _quote(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def split_line(line: str, delimiter: str, quote: str = '"') -> list[str]:
    """Fields of a physical line: delimiters inside quotes do not count, two quotes are one."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == quote and line[i + 1 : i + 2] == quote:
                cell, i = cell + quote, i + 1
            elif c == quote:
                quoted = False
            else:
                cell += c
        elif c == quote and not cell:
            quoted = True
        elif line.startswith(delimiter, i):
            out.append(cell)
            cell, i = "", i + len(delimiter) - 1
        else:
            cell += c
        i += 1
    return [*out, cell]


def column_count_errors(spark: SparkSession, path: str, delimiter: str, quote: str = '"') -> DataFrame:
    """Lines whose number of fields is not the first line's: line (its number in the file), fields, expected.

    What quotes enclose is every second piece between them; delimiters are counted in the others. Cells may be of any length.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    outside = F.filter(F.split("value", F.lit(_quote(quote)), -1), lambda piece, i: i % 2 == 0)
    n = F.size(F.split(F.array_join(outside, "\n"), F.lit(_quote(delimiter)), -1))
    head = lines.orderBy("line").limit(1).select(n.alias("n")).collect()
    expected = head[0]["n"] if head else 0
    return lines.select("line", n.alias("fields"), F.lit(expected).alias("expected")).where(F.col("fields") != expected)


def read_columnar(spark: SparkSession, path: str | list[str], fmt: str) -> DataFrame:
    """Parquet and ORC natively; Avro files and Excel workbooks are parsed where Spark reads their bytes."""
    fmt = normal_format(fmt)
    if fmt in ("parquet", "orc"):
        return getattr(spark.read, fmt)(*([path] if isinstance(path, str) else path)) if fmt == "parquet" else spark.read.orc(path)
    from .datasource import read_binary

    return read_binary(spark, path, fmt)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; nested ones as JSON with sorted keys."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    cell = lambda f: F.to_json(F.parse_json(F.to_json(f"`{f.name}`"))) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    return df.select(*[cell(f).alias(f.name) for f in df.schema])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``json`` (text); blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("json"))


def read_json(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """('document', one row per file) if the whole text parses, else ('ndjson', one row per line).

    A file that holds several lines of which the first is a whole value is not parsed as a whole.
    """
    lines = read_json_lines(spark, path)
    head = lines.limit(2).select(F.try_parse_json("json").isNotNull().alias("ok")).collect()
    if len(head) == 2 and head[0]["ok"] and head[1]["ok"]:
        return "ndjson", lines
    return "document", spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def read_fixed_width(spark: SparkSession, path: str, slices: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Slices (name, start, end) of non-blank lines, trimmed; empty where the end does not follow the start."""
    return slice_lines(spark.read.text(path).select(F.col("value").alias("line")), slices)


def slice_lines(lines: DataFrame, slices: Sequence[tuple[str, int, int]], line: str = "line") -> DataFrame:
    if not slices:
        raise ValueError("a fixed-width layout needs fields")
    from ..functions.canon import strip

    rows = lines.where(strip(F.col(line)) != "")
    cut = lambda a, b: strip(F.substring(F.col(line), a + 1, b - a)) if b > a else F.lit("")
    return rows.select(*[cut(a, b).alias(n) for n, a, b in slices])


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """A table or query of a database; ``partition`` (column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        return reader.option("dbtable", table or f"({query}) AS q").load()
    return (reader.option("query", query) if query else reader.option("dbtable", table)).load()


# URL forms of the databases.
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}", "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}", "teradata": "jdbc:teradata://{host}/DATABASE={database}",
    "snowflake": "jdbc:snowflake://{host}/?db={database}", "bigquery": "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={database}",
    "redshift": "jdbc:redshift://{host}:{port}/{database}", "hive": "jdbc:hive2://{host}:{port}/{database}",
}


def jdbc_url(kind: str, **parts: object) -> str:
    return JDBC_URLS[kind].format(**parts)


def list_files(spark: SparkSession, folder: str, fmt: str | None = None, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path, name, length, modified of files whose ending fits the format; compressed and extensionless names fit too. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", F.col("length"), F.col("modificationTime").alias("modified"))
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    fmt = normal_format(fmt) if fmt else "auto"
    if fmt != "auto":
        ends = [s for s, f in SUFFIXES.items() if f == fmt] + (list(AMBIGUOUS) if fmt in ("csv", "fixed-width") else [])
        low = F.lower("name")
        fits = ~low.contains(".")
        for e in ends:
            for c in ("", *COMPRESSED):
                fits = fits | low.endswith(e + c)
        files = files.where(fits)
    return files.orderBy("path").limit(limit) if limit else files


def read_any(spark: SparkSession, path: str | list[str], fmt: str | None = None, **options: object) -> DataFrame:
    """The reader of a format; several paths are read as one input."""
    fmt = format_of_path(path if isinstance(path, str) else path[0], fmt)
    if fmt == "csv":
        return read_delimited(spark, path, **options)
    if fmt in ("parquet", "orc", "avro", "excel"):
        return read_columnar(spark, path, fmt)
    if fmt == "json":
        return read_json_lines(spark, path)
    if fmt == "fixed-width":
        return read_fixed_width(spark, path, **options)
    raise ValueError(f"no table reader for {fmt}")


def estimated_lines(spark: SparkSession, path: str | list[str], sample: int = 10_000) -> int:
    """About how many lines a text input has: its size over the mean length of its first lines; exact if these are all. Compressed inputs are estimated by their compressed size."""
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    head = spark.read.text(path).limit(sample).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes")).first()
    return head["n"] if head["n"] < sample else round(size * head["n"] / head["bytes"])


def row_count(df: DataFrame) -> int:
    """Exact, over parsed rows; Parquet and ORC answer from their footers."""
    return df.count()
