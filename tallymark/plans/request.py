"""A validation request and its dispatch to an engine: read, resolve, reconcile, report."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mapping import ColumnMapping, key_columns, resolve_fields
from ..functions.structured import looks_structured
from ..operators import compare, fixed_width, json_diff, report
from ..operators.reconcile import MISSING, Reconciliation, multiset_difference
from ..sources import archives, detect, readers, sniff
from ..sources.scratch import save

LITMUS, FULL = "litmus", "full"
#: Endings of inputs that are opened here, as Spark's readers do not.
ARCHIVES, UNREAD = (".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2"), (".zst", ".xz")


@dataclass(frozen=True)
class Request:
    """Two inputs and how to compare them. ``uid`` may name several columns, comma-separated; empty compares whole records.

    Archives are compared by their entries; if a text format or the name of a ``leaf`` is given, by the file inside.
    ``header_leading_rows`` and ``footer_trailing_rows`` are lines of a delimited file that are left out.
    ``per_column_limit`` and ``sample_limit`` are the sizes of the samples that a result shows.
    """

    source: str | list[str]
    target: str | list[str]
    uid: str = ""
    file_format: str = "auto"
    delimiter: str | None = None
    has_header: bool | None = None
    header_leading_rows: int = 0
    footer_trailing_rows: int = 0
    column_mappings: tuple[ColumnMapping, ...] = ()
    layout: tuple[fixed_width.Slice, ...] = ()
    order_sensitive: bool = False
    on_duplicate: str = "cross"
    test_mode: str = FULL
    uid_gte: str | None = None
    per_column_limit: int | None = None
    sample_limit: int = 100
    leaf: str | None = None


@dataclass
class Result:
    mismatches: DataFrame
    summary: dict[str, int]
    is_match: bool
    source_rows: int
    target_rows: int
    schema_issues: list[dict] = field(default_factory=list)
    seconds: float = 0.0
    file_format: str = ""
    per_column_limit: int | None = None
    sample_limit: int = 100
    stages: dict[str, float] = field(default_factory=dict)

    def samples(self, per_column: int | None = None) -> DataFrame:
        return report.sample_grouped(self.mismatches, report.snippet_limit(per_column if per_column is not None else self.per_column_limit))

    def markdown(self, limit: int | None = None) -> str:
        most = self.sample_limit if limit is None else limit
        return report.markdown(self.summary, self.schema_issues, [r.asDict() for r in report.sample_mixed(self.mismatches, most).collect()], most=most)


def opened(spark: SparkSession, request: Request) -> Request:
    """The request with inputs that Spark's readers can open: the leaf of an archive, and files of other compressions, as text folders."""
    fmt = readers.normal_format(request.file_format)
    text = fmt in ("csv", "json", "fixed-width") or request.leaf is not None or bool(request.layout)

    def one(path: str | list[str]) -> str | list[str]:
        if not isinstance(path, str):
            return [one(p) for p in path]
        low = path.lower()
        inner = fmt if fmt in archives.LEAVES else readers.format_of_path(low.rsplit(".", 1)[0]) if low.endswith(UNREAD) else "csv"
        wanted = (low.endswith(ARCHIVES) and text) or low.endswith(UNREAD)
        return archives.materialize(spark, path, inner if inner in archives.LEAVES else "csv", request.leaf) if wanted else path

    return replace(request, source=one(request.source), target=one(request.target))


def head(spark: SparkSession, path: str | list[str]) -> tuple[str, bytes]:
    """Name and first bytes of an input's first file, of a compressed one those of what it holds; small files come whole."""
    p = path if isinstance(path, str) else path[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path", "length")
    first = files.agg(F.min(F.struct("path", "length")).alias("f")).select("f.*").first()
    if first["path"] is None:
        return p, b""
    one = spark.read.format("binaryFile").load(first["path"])
    content = F.col("content") if first["length"] <= (8 << 20) else F.substring("content", 1, detect.SAMPLE)
    return detect.peel(first["path"].rsplit("/", 1)[-1], bytes(one.select(content.alias("c")).first()["c"] or b""))


def resolve(spark: SparkSession, request: Request) -> str:
    """The format of both sides: by name where it is plain, else by content."""
    named = readers.normal_format(request.file_format)
    if request.layout:
        return "fixed-width"
    if named != "auto":
        return named
    by_name = {readers.format_of_path(p if isinstance(p, str) else p[0]) for p in (request.source, request.target)}
    first = request.source if isinstance(request.source, str) else request.source[0]
    if len(by_name) == 1 and by_name & {"parquet", "orc", "avro", "json", "zip", "tar"} and not first.lower().endswith(readers.AMBIGUOUS):
        return by_name.pop()
    return detect.resolve_format([detect.detect(*head(spark, p)) for p in (request.source, request.target)], "auto")


def read_side(spark: SparkSession, request: Request, path: str | list[str], fmt: str, delimiter: str | None, lines: Sequence[str] | None = None, traits: Row | None = None) -> DataFrame:
    """``lines``: the first ones of a delimited input, ``traits``: what a pass over its text told, if it has been read."""
    if fmt == "csv":
        lines = lines if lines is not None else readers.first_lines(spark, path, skip=request.header_leading_rows)
        if not lines:
            return spark.createDataFrame([], T.StructType([]))
        quote = sniff.quote_character(lines, delimiter)
        cells = [c.strip() for c in readers.split_line(lines[0], delimiter, quote)]
        header = request.has_header if request.has_header is not None else sniff.has_header(cells)
        names = [c or f"column_{i + 1}" for i, c in enumerate(cells)] if header else readers.synthetic_names(len(cells))
        broken = lines[0].count(quote) % 2
        df = readers.read_delimited(spark, path, delimiter, header, None if broken else names, request.header_leading_rows, multi_line=traits.breaks if traits else None, skip_end=request.footer_trailing_rows, quote=quote)
    else:
        df = readers.as_text(readers.read_columnar(spark, path, fmt))
    keys = key_columns(request.uid)
    if request.uid_gte is not None and keys:
        k = F.col(keys[0])
        df = df.where(F.coalesce(k.try_cast("double") >= F.lit(request.uid_gte).try_cast("double"), k >= request.uid_gte))
    return df


def _bracketed(c: Column) -> Column:
    """What every container literal looks like; no Python is needed for it."""
    return F.coalesce(c.rlike(r"(?s)^\s*(\[.*\]|\{.*\}|\(.*\))\s*$"), F.lit(False))


def complex_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns with a container literal in any row. One pass finds columns that have brackets; a literal is looked for in those only, up to the first."""
    text = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return []
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    seen = df.agg(*[F.max(_bracketed(col(c))).alias(f"c{i}") for i, c in enumerate(text)]).first()
    return [c for i, c in enumerate(text) if seen[i] and not df.where(_bracketed(col(c))).where(looks_structured(col(c))).isEmpty()]


def validate(spark: SparkSession, request: Request) -> Result:
    """Run a request. The mismatch relation is written once; counts, samples and exports come from it."""
    began = time.time()
    try:
        opened_ = opened(spark, request)
        fmt = resolve(spark, opened_)
        known = time.time()
        result = ENGINES[fmt](spark, opened_, fmt)
    except (PySparkException, Py4JJavaError) as e:
        named = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE|\n|$)", str(e))  # a record that names itself
        if named is None:
            raise
        raise ValueError(named[1]) from e
    result.seconds, result.file_format = time.time() - began, fmt
    result.per_column_limit, result.sample_limit = request.per_column_limit, request.sample_limit
    result.stages = {"resolve": known - began, "compare": time.time() - known}
    return result


def _tables(spark: SparkSession, request: Request, fmt: str) -> Result:
    delimiter, lines = sniff.delimiter_token(request.delimiter) if fmt == "csv" else None, [None, None]
    if fmt == "csv":
        lines = [readers.first_lines(spark, p, skip=request.header_leading_rows) for p in (request.source, request.target)]
    if fmt == "csv" and delimiter is None:
        filled = [x for x in lines if x]
        delimiter = sniff.shared_delimiter(*lines) if len(filled) == 2 and min(map(len, filled)) > 1 else next((sniff.detect_delimiter(x) for x in filled if len(x) > 1), ",")
    sides = list(zip((request.source, request.target), lines, strict=True))
    traits = [readers.text_traits(spark, p, sniff.quote_character(x, delimiter)) if fmt == "csv" and x else None for p, x in sides]
    s, t = (read_side(spark, request, p, fmt, delimiter, x, y) for (p, x), y in zip(sides, traits, strict=True))
    if not s.columns or not t.columns:  # an empty side has the other's columns and no rows
        s, t = (x if x.columns else spark.createDataFrame([], y.schema) for x, y in ((s, t), (t, s)))
    empty = lambda: spark.createDataFrame([], ", ".join(f"{c} string" for c in report.MISMATCH_COLUMNS))
    if not s.columns:
        return Result(empty(), report.normal_summary({}), True, 0, 0)
    same_schema = [(f.name, f.dataType) for f in s.schema] == [(f.name, f.dataType) for f in t.schema]
    issues = [] if same_schema or request.column_mappings else [r.asDict() for r in compare.schema_diff(compare.schema_frame(s), compare.schema_frame(t)).collect()]
    if request.test_mode == LITMUS:
        c = compare.litmus(s, t).first()
        if not (c["same_rows"] and c["same_columns"]):
            return Result(empty(), report.normal_summary({}), False, c["source_rows"], c["target_rows"], issues)
    keys = key_columns(request.uid)
    if not keys:
        columns = [c for c in s.columns if c in t.columns]
        diff = multiset_difference(s, t, columns)
        detail = F.to_json(F.struct(*columns, "source_count", "target_count"))
        rows = diff.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("uid"), "mismatch_type", *[F.lit(None).cast("string").alias(c) for c in report.MISMATCH_COLUMNS[2:5]], detail.alias("row_detail"))
        c = compare.litmus(s, t).first()
        return _finish(rows, c["source_rows"], c["target_rows"], issues)
    shared = [c for c in s.columns if c in t.columns]
    nested = []
    if fmt != "csv" or any(x.brackets for x in traits if x):
        nested = list(dict.fromkeys([*complex_columns(s, shared), *complex_columns(t, shared)]))
    fields = resolve_fields(request.column_mappings, keys, shared, nested)
    # rows are counted on their way into the join, and the summary on its way out; a plan over no rows has no such way
    left_out = 1 + request.header_leading_rows + request.footer_trailing_rows
    plain = request.uid_gte is None
    some = [y.lines > left_out or not x.isEmpty() if y and plain else not x.isEmpty() for x, y in zip((s, t), traits, strict=True)]
    for x, path, rows_there in ((s, request.source, some[0]), (t, request.target, some[1])):
        if not rows_there and fmt == "csv" and plain:
            compare.parsed_enough(0, _size(spark, path))
    if not all(some):
        r = Reconciliation(s, t, keys, fields, on_duplicate=request.on_duplicate)
        c = r.summary().first().asDict()
        return _result(save(r.mismatches(), "mismatches"), c, *(x.count() for x in (s, t)), issues)
    seen, counts = [Observation(), Observation()], Observation()
    s, t = (x.observe(o, F.count(F.lit(1)).alias("n")) for x, o in zip((s, t), seen, strict=True))
    rows = save(Reconciliation(s, t, keys, fields, on_duplicate=request.on_duplicate).mismatches(counts=counts), "mismatches")
    return _result(rows, counts.get, *(o.get["n"] for o in seen), issues)


def _size(spark: SparkSession, path: str | list[str]) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0


def _result(rows: DataFrame, counts: dict, source_rows: int, target_rows: int, issues: Sequence[dict]) -> Result:
    summary = report.normal_summary({**counts, "value_mismatch": counts["value_mismatch_cells"]})
    return Result(rows, summary, not any(summary.values()), source_rows, target_rows, list(issues))


def _finish(rows: DataFrame, source_rows: int, target_rows: int, issues: Sequence[dict] = ()) -> Result:
    rows = save(rows, "mismatches")
    return _result(rows, fixed_width.status_of(rows).first().asDict(), source_rows, target_rows, issues)


def _fixed_width(spark: SparkSession, request: Request, fmt: str) -> Result:
    from ..sources.layout import infer_layout

    layout = request.layout
    if not layout:
        cols = infer_layout(readers.first_lines(spark, request.source, 20), readers.first_lines(spark, request.target, 20))
        layout = tuple(fixed_width.Slice(c.name, c.source, c.target, c.type, c.source_date_format, c.target_date_format) for c in cols)
    s, t = (spark.read.text(p).select(F.col("value").alias("line")) for p in (request.source, request.target))
    rows = fixed_width.reconcile_fixed_width(s, t, layout, request.uid or None)
    n = [x.where(F.trim("line") != "").count() for x in (s, t)]
    return _finish(rows, *n)


def _json(spark: SparkSession, request: Request, fmt: str) -> Result:
    (s_mode, s), (t_mode, t) = (readers.read_json(spark, p) for p in (request.source, request.target))
    if s_mode != t_mode:
        raise ValueError("both sides must be documents or both JSON lines")
    mapping = [(m.source_column, m.target_column or m.source_column) for m in request.column_mappings]
    if s_mode == "document":
        rows = json_diff.diff_documents(s, t, request.order_sensitive, mapping)
    else:
        rows = json_diff.diff_json_lines(s, t, request.uid or "id", request.order_sensitive, mapping)
    return _finish(rows, s.count(), t.count())


def _archives(spark: SparkSession, request: Request, fmt: str) -> Result:
    s, t = (archives.read_manifest(spark, p) for p in (request.source, request.target))
    rows = compare.manifest_diff(s, t).withColumn("row_detail", F.lit(None).cast("string"))
    return _finish(rows, s.count(), t.count())


ENGINES: dict[str, Callable[[SparkSession, Request, str], Result]] = {
    "csv": _tables, "parquet": _tables, "orc": _tables, "avro": _tables, "excel": _tables,
    "fixed-width": _fixed_width, "json": _json, "zip": _archives, "tar": _archives,
}


def run_batch(spark: SparkSession, requests: Sequence[Request], stop_on_failure: bool = False) -> list[dict]:
    """One outcome per request: completed, failed or skipped."""
    out: list[dict] = []
    for r in requests:
        if stop_on_failure and any(o["status"] == "failed" for o in out):
            out.append({"status": "skipped", "is_match": None})
            continue
        try:
            result = validate(spark, r)
            out.append({"status": "completed", "is_match": result.is_match, "summary": result.summary, "seconds": result.seconds})
        except (ValueError, OSError) as e:
            out.append({"status": "failed", "is_match": None, "error": str(e)})
    return out


def preview(spark: SparkSession, request: Request, rows: int = 6, most: int = 200) -> dict:
    """Columns of both sides, their automatic mapping, leftovers, samples and complex columns."""
    from ..functions.mapping import auto_map

    request = opened(spark, request)
    fmt = resolve(spark, request)
    delimiter = sniff.delimiter_token(request.delimiter) or (sniff.shared_delimiter(*(readers.first_lines(spark, p) for p in (request.source, request.target))) if fmt == "csv" else None)
    s, t = (read_side(spark, request, p, fmt, delimiter) for p in (request.source, request.target))
    a, b = s.columns[:most], t.columns[:most]
    pairs = auto_map(a, b)
    used = {x for x, _ in pairs}, {y for _, y in pairs}
    sample = lambda df: [r.asDict() for r in df.limit(rows).collect()]
    return {
        "file_format": fmt, "delimiter": delimiter, "source_columns": a, "target_columns": b, "mappings": pairs,
        "unmatched_source": [c for c in a if c not in used[0]], "unmatched_target": [c for c in b if c not in used[1]],
        "source_sample": sample(s), "target_sample": sample(t), "complex_columns": list(dict.fromkeys([*complex_columns(s, a), *complex_columns(t, [c for c in b if c in a])])),
    }


def profile(spark: SparkSession, path: str) -> dict:
    """Name, size, label, format, columns and rows of an input."""
    name, content = head(spark, path)
    r = detect.detect(name, content)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    fmt = r.suggested_format or readers.format_of_path(name)
    out = {"name": name, "size": size, "label": detect.display_label(name, content), "file_format": fmt, "columns": [], "rows": None}
    if fmt in ("csv", "parquet", "orc", "avro", "excel"):
        lines = readers.first_lines(spark, path) if fmt == "csv" else []
        df = readers.read_delimited(spark, path, sniff.detect_delimiter(lines), sniff.has_header(readers.split_line(lines[0], sniff.detect_delimiter(lines)))) if fmt == "csv" else readers.read_columnar(spark, path, fmt)
        out |= {"columns": df.columns, "rows": df.count()}
    elif fmt == "json":
        mode, rows = readers.read_json(spark, path)
        out |= {"columns": sorted({r["key"] for r in json_diff.top_level_keys(rows).collect()}), "rows": rows.count()}
    elif fmt == "fixed-width":
        out["rows"] = spark.read.text(path).where(F.trim("value") != "").count()
    elif fmt in ("zip", "tar"):
        out["rows"] = archives.read_manifest(spark, path).count()
    return out


__all__ = ["MISSING", "Request", "Result", "preview", "profile", "run_batch", "validate"]
