"""Queries over files: each writes files made of the tables to the shared folder and reads them by the sources' own code."""

from __future__ import annotations

import gzip
import io
import json
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, json_diff
from ..operators.fixed_width import Slice, reconcile_fixed_width
from ..sources import archives, detect, readers, sniff
from ..sources.datasource import read_binary
from ..sources.scratch import scratch_path, write_bytes
from . import oracle
from .inputs import frame, load
from .request import Request, validate

NATIONS = "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS region FROM {nation}"


def _nations(spark: SparkSession, d: str) -> list[Row]:
    """The rows of the smallest table but one: 25."""
    return sorted(frame(spark, d, NATIONS).collect())


def _file(spark: SparkSession, name: str, data: bytes | str) -> str:
    return write_bytes(spark, scratch_path(spark, name), data.encode() if isinstance(data, str) else data)


def _csv(rows: Sequence[Row], changed: bool = False, delimiter: str = ",") -> str:
    """Nations as delimited text; the changed ones lack every ninth and have every fourth name in small letters."""
    line = lambda r: delimiter.join([str(r.n), f'"{r.name.lower() if changed and r.n % 4 == 0 else r.name}"', str(r.region)])
    return "\n".join([delimiter.join(("id", "name", "region")), *[line(r) for r in rows if not (changed and r.n % 9 == 0)]]) + "\n"


def _zip(entries: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def _tar(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _workbook(rows: Sequence[Row]) -> bytes:
    """A workbook whose second sheet has a text, a number and a date a row."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda v: f"<c t='inlineStr'><is><t>{escape(v)}</t></is></c>"
    body = "".join(f"<row><c><v>{r.n}</v></c>{text(r.name)}<c s='1'><v>{45292 + r.n}</v></c></row>" for r in rows)
    sheet = lambda cells: f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"
    return _zip({
        "xl/workbook.xml": f"<workbook {ns}><sheets><sheet name='Notes'/><sheet name='Nations'/></sheets></workbook>", "xl/styles.xml": f"<styleSheet {ns}><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></styleSheet>",
        "xl/worksheets/sheet1.xml": sheet(f"<row>{text('nothing')}</row>"), "xl/worksheets/sheet2.xml": sheet(f"<row>{text('id')}{text('name')}{text('day')}</row>{body}"),
    })


def _varint(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _avro(rows: Sequence[Row]) -> bytes:
    """An Avro file of nations: a number, a nullable text, a double and a date, deflated."""
    fields = [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "half", "type": "double"}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}]
    text = lambda b: _varint(len(b)) + b
    body = b"".join(_varint(r.n) + (_varint(0) if r.n % 5 == 0 else _varint(1) + text(r.name.encode())) + struct.pack("<d", r.n / 2) + _varint(19723 + r.n) for r in rows)
    packer = zlib.compressobj(wbits=-15)
    body = packer.compress(body) + packer.flush()
    schema = json.dumps({"type": "record", "name": "nation", "fields": fields}).encode()
    return b"Obj\x01" + _varint(2) + text(b"avro.schema") + text(schema) + text(b"avro.codec") + text(b"deflate") + _varint(0) + b"t" * 16 + _varint(len(rows)) + text(body) + b"t" * 16


# --- the queries: name, SQL and how it runs ---------------------------------------------------------

FIVE = "uid, mismatch_type, column_name, source_value, target_value"
#: What a comparison of the two nation files finds.
CHANGED = """SELECT CAST(n_nationkey AS STRING) AS uid, 'missing_in_target' AS mismatch_type, NULL AS column_name, NULL AS source_value, NULL AS target_value FROM nation WHERE n_nationkey % 9 = 0
    UNION ALL SELECT CAST(n_nationkey AS STRING), 'value_mismatch', 'name', n_name, lower(n_name) FROM nation WHERE n_nationkey % 9 <> 0 AND n_nationkey % 4 = 0 AND n_name <> lower(n_name)"""


def _validated(spark: SparkSession, source: str, target: str, **how: object) -> DataFrame:
    return validate(spark, Request(source, target, uid="id", **how)).mismatches.select(*FIVE.split(", "))


def column_count_errors(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a field too many or too few among lines with quoted delimiters."""
    more = "CASE WHEN n % 50 = 0 THEN ',more' ELSE '' END"
    rows = frame(spark, d, f"SELECT id || ',' || CASE WHEN n % 7 = 0 THEN '\"a, b\"' ELSE name END || CASE WHEN n % 50 = 1 THEN '' ELSE ',' || segment END || {more} AS value FROM {{customer_s}} AS s")
    spark.sql("SELECT 'id,name,segment' AS value").unionByName(rows).coalesce(1).write.text(path := scratch_path(spark, "faults"))
    return readers.column_count_errors(spark, path, ",").groupBy("fields", "expected").agg(F.count(F.lit(1)).alias("n"))


def avro_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_binary(spark, _file(spark, "n.avro", _avro(_nations(spark, d))), "avro")


def excel_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_binary(spark, _file(spark, "n.xlsx", _workbook(_nations(spark, d))), "excel", sheet="Nations")


def skipped_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    text = "a report, with notes\n\n" + _csv(_nations(spark, d)).replace("region", "region key") + "TOTAL,25,\n"
    return readers.read_delimited(spark, _file(spark, "report.csv", text), skip_rows=2, skip_end=1)


def json_file_diff(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines by file, joined by their id."""
    paths = []
    for n in ("props_s", "props_t"):
        rows = load(spark, d, n).select(F.concat(F.lit('{"id": '), "id", F.lit(', "p": '), "json", F.lit("}")).alias("value"))
        rows.write.text(path := scratch_path(spark, n))
        paths.append(readers.read_json_lines(spark, path))
    return json_diff.diff_json_lines(*paths, "id").drop("row_detail")


def fixed_width_file(spark: SparkSession, d: str) -> DataFrame:
    paths = []
    for n in ("fixed_s", "fixed_t"):
        load(spark, d, n).select("line").write.text(path := scratch_path(spark, n))
        paths.append(spark.read.text(path).withColumnRenamed("value", "line"))
    slices = (Slice("id", (0, 8)), Slice("name", (8, 32)), Slice("nation", (32, 38), type="integer"))
    return reconcile_fixed_width(*paths, slices, "id").drop("row_detail")


def zip_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two archives, nested archives included."""
    rows, paths = _nations(spark, d), []
    for changed in (False, True):
        inner = _zip({f"{r.name}.txt": r.name for r in rows if r.n % 2 and not (changed and r.n % 9 == 0)})
        data = _zip({"inner.zip": inner} | {f"d/{r.name}.txt": r.name + ("!" if changed and r.n % 4 == 0 else "") for r in rows if r.n % 2 == 0})
        paths.append(archives.read_manifest(spark, _file(spark, "m.zip", data)))
    return compare.manifest_diff(*paths, fields=("uncompressed_size",)).where("uid <> 'inner.zip'")


def tar_manifest(spark: SparkSession, d: str) -> DataFrame:
    data = gzip.compress(_tar({f"t/{r.name}": b"x" * r.n for r in _nations(spark, d)}))
    return archives.read_manifest(spark, _file(spark, "m.tar.gz", data)).select("path", "uncompressed_size", "is_dir")


def archive_leaf_recon(spark: SparkSession, d: str) -> DataFrame:
    """Delimited files in a tar in a zip."""
    rows = _nations(spark, d)
    paths = [_file(spark, "l.zip", _zip({"a.md": "no data", "in.tar": _tar({"deep/data.csv": _csv(rows, changed).encode()})})) for changed in (False, True)]
    return _validated(spark, *paths, file_format="csv")


def compressed_recon(spark: SparkSession, d: str) -> DataFrame:
    """Compressed delimited files of which neither format nor delimiter is given."""
    paths = [_file(spark, "c.csv.gz", gzip.compress(_csv(_nations(spark, d), changed, ";").encode())) for changed in (False, True)]
    return _validated(spark, *paths)


def dialect_recon(spark: SparkSession, d: str) -> DataFrame:
    """Files whose cells are in single quotes and hold delimiters."""
    paths = [_file(spark, "q.csv", _csv(_nations(spark, d), changed).replace('"', "'").replace("NATION_", "NATION, ").replace("nation_", "nation, ")) for changed in (False, True)]
    return _validated(spark, *paths, file_format="csv", delimiter=",")


def detected_formats(spark: SparkSession, d: str) -> DataFrame:
    """A folder of one file a nation, in eight formats by turn, under names that say nothing."""
    rows, folder = _nations(spark, d), scratch_path(spark, "unknown")
    lines = "\n".join(json.dumps({"id": r.n, "name": r.name}) for r in rows)
    fixed = "".join(f"{r.n:<6}{r.name:<20}{r.region:<4}\n" for r in rows)
    made = [_csv(rows).encode(), _csv(rows, delimiter="\t").encode(), lines.encode(), fixed.encode(), _avro(rows), _workbook(rows), _zip({"a.csv": _csv(rows)}), gzip.compress(_csv(rows).encode())]
    for r in rows:
        write_bytes(spark, f"{folder}/{r.name}", made[r.n % 8])
    found = detect.detect_files(spark, folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "format")


def inferred_headers(spark: SparkSession, d: str) -> DataFrame:
    """Delimiter and header of files with and without a header, by turn in four delimiters."""
    rows, out = _nations(spark, d), []
    for r in rows:
        delimiter = (",", ";", "|", "||")[r.n % 4]
        lines = _csv(rows, delimiter=delimiter).splitlines()[r.n % 3 == 0 :]
        found = sniff.detect_delimiter(lines)
        out.append((r.n, found, sniff.has_header(readers.split_line(lines[0], found))))
    return spark.createDataFrame(out, "n int, delimiter string, header boolean")


_formats = "CASE n_nationkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' WHEN 3 THEN 'fixed-width' WHEN 4 THEN 'avro' WHEN 5 THEN 'excel' WHEN 6 THEN 'zip' ELSE 'decompress_first' END"
_comma = "replace(replace({}, 'NATION_', 'NATION, '), 'nation_', 'nation, ')"
ALL = {
    "column_count_errors": (column_count_errors, "SELECT CASE WHEN c_custkey % 50 = 0 THEN 4 ELSE 2 END AS fields, 3 AS expected, count(*) AS n FROM customer WHERE c_custkey % 50 IN (0, 1) GROUP BY 1"),
    "avro_scan": (avro_scan, "SELECT CAST(n_nationkey AS STRING) AS id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name, CAST(n_nationkey / 2.0 AS STRING) AS half, CAST(DATE '2024-01-01' + n_nationkey AS STRING) AS day FROM nation"),
    "excel_scan": (excel_scan, "SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name, CAST(DATE '2024-01-01' + n_nationkey AS STRING) AS day FROM nation"),
    "skipped_lines_scan": (skipped_lines_scan, 'SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name, CAST(n_regionkey AS STRING) AS "region key" FROM nation'),
    "json_file_diff": (json_file_diff, f"""WITH s AS ({oracle.side('props_s')}), t AS ({oracle.side('props_t')}), j AS (SELECT id, json_extract_string(s.json, '$.k') AS a, json_extract_string(t.json, '$.k') AS b, json_extract_string(t.json, '$.j') AS c FROM s JOIN t USING (id))
        SELECT id AS uid, 'value_mismatch' AS mismatch_type, 'p.k' AS column_name, a AS source_value, b AS target_value FROM j WHERE b IS NOT NULL AND a <> b
        UNION ALL SELECT id, 'missing_in_target', 'p.k', a, NULL FROM j WHERE b IS NULL UNION ALL SELECT id, 'extra_in_target', 'p.j', NULL, c FROM j WHERE c IS NOT NULL"""),
    "fixed_width_file": (fixed_width_file, """SELECT CAST(s_suppkey AS STRING) AS uid, 'missing_in_target' AS mismatch_type, NULL AS column_name, NULL AS source_value, NULL AS target_value FROM supplier WHERE s_suppkey % 10 = 1
        UNION ALL SELECT CAST(s_suppkey AS STRING), 'value_mismatch', 'name', s_name, lower(s_name) FROM supplier WHERE s_suppkey % 10 <> 1 AND s_suppkey % 7 = 0"""),
    "zip_manifest": (zip_manifest, """SELECT 'inner.zip/' || n_name || '.txt' AS uid, 'missing_in_target' AS mismatch_type, NULL AS column_name, NULL AS source_value, NULL AS target_value FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 9 = 0
        UNION ALL SELECT 'd/' || n_name || '.txt', 'value_mismatch', 'uncompressed_size', CAST(length(n_name) AS STRING), CAST(length(n_name) + 1 AS STRING) FROM nation WHERE n_nationkey % 4 = 0"""),
    "tar_manifest": (tar_manifest, "SELECT 't/' || n_name AS path, CAST(n_nationkey AS BIGINT) AS uncompressed_size, false AS is_dir FROM nation"),
    "archive_leaf_recon": (archive_leaf_recon, CHANGED),
    "compressed_recon": (compressed_recon, CHANGED),
    "dialect_recon": (dialect_recon, f"SELECT uid, mismatch_type, column_name, {_comma.format('source_value')} AS source_value, {_comma.format('target_value')} AS target_value FROM ({CHANGED}) AS c"),
    "detected_formats": (detected_formats, f"SELECT n_name AS name, {_formats} AS format FROM nation"),
    "inferred_headers": (inferred_headers, "SELECT n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE '||' END AS delimiter, n_nationkey % 3 <> 0 AS header FROM nation"),
}
