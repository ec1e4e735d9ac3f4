import bz2
import gzip
import io
import json
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest

from tallymark.operators import compare, json_diff
from tallymark.operators.fixed_width import Slice, line_by_line, reconcile_fixed_width
from tallymark.operators.quality import Constraint, check
from tallymark.sources import archives, detect, layout, readers, sniff
from tallymark.sources.datasource import AvroFile, logical, read_binary, sheet_rows


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t", "||", "🚀", "~^|~", "::"])
def test_delimiters(spark, tmp_path, delimiter):
    rows = [["id", "name", "amount"], *[[str(i), f"näme {i}", f"{i}.5"] for i in range(20)]]
    lines = [delimiter.join(r) for r in rows]
    assert sniff.detect_delimiter(lines) == delimiter
    assert sniff.shared_delimiter(lines, lines[::-1]) == delimiter
    df = readers.read_delimited(spark, write(tmp_path / "a.csv", "\n".join(lines)), delimiter)
    assert df.columns == rows[0] and sorted(map(list, df.collect())) == sorted(rows[1:])


def test_quotes_breaks_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "q.csv", '﻿id,note,x\n1,"a, ""b""\nc",2\n\n2,short\n3,a,b,c\n')
    df = readers.read_delimited(spark, path)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a, "b"\nc', "2"), ("2", "short", None), ("3", "a", "b")]
    flagged = readers.read_delimited(spark, path, on_ragged="flag")
    assert {r["id"]: r["_ragged"] for r in flagged.collect()} == {"1": False, "2": True, "3": True}
    assert {(r["fields"], r["expected"]) for r in readers.column_count_errors(spark, write(tmp_path / "c.csv", 'a,b\n1,"x,y"\n1,2,3\n'), ",").collect()} == {(3, 2)}


def test_faults_of_long_and_odd_lines(spark, tmp_path):
    """Cells of a megabyte, many quotes, several delimiters; bad lines are named by their number."""
    long = "x," * 500_000
    path = write(tmp_path / "l.csv", f'a,b\n1,"{long}"\n\n1,2,3\n"{'""' * 100_000}",2\nonly\n')
    assert {(r["line"], r["fields"]) for r in readers.column_count_errors(spark, path, ",").collect()} == {(4, 3), (6, 1)}
    path = write(tmp_path / "m.csv", 'a||b\n"x||y"||2\n1||2||3\n1|2\n')
    assert {(r["line"], r["fields"]) for r in readers.column_count_errors(spark, path, "||").collect()} == {(3, 3), (4, 1)}
    numbers = readers.numbered_lines(spark, path).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in numbers][2] == (3, "1||2||3")
    assert readers.estimated_lines(spark, path) == 4 and readers.estimated_lines(spark, path, sample=2) in range(2, 8)


def test_headerless_skipped_and_compressed(spark, tmp_path):
    assert readers.read_delimited(spark, write(tmp_path / "h.csv", "R01,x\nR02,y\n"), ",", header=False).columns == ["column_1", "column_2"]
    df = readers.read_delimited(spark, write(tmp_path / "s.csv", "junk\nmore junk\nid,v\n1,a\n2,b\n"), ",", skip_rows=2)
    assert df.columns == ["id", "v"] and df.count() == 2
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"id,v\n1,a\n"))
    (tmp_path / "z.csv.bz2").write_bytes(bz2.compress(b"id,v\n1,a\n"))
    assert [readers.read_delimited(spark, str(tmp_path / n)).count() for n in ("z.csv.gz", "z.csv.bz2")] == [1, 1]
    assert readers.read_delimited(spark, write(tmp_path / "d.csv", "a,a,\n1,2,3\n")).columns == ["a", "a_2", "column_3"]
    assert [tuple(r) for r in readers.read_delimited_bytes(spark, "id;v\n1;é\n".encode(), delimiter=";").collect()] == [("1", "é")]


def test_split_line_and_tokens():
    assert readers.split_line('a,"b,""c""",d', ",") == ["a", 'b,"c"', "d"]
    assert readers.split_line('1||"x||y"||', "||") == ["1", "x||y", ""]
    assert [sniff.delimiter_token(t) for t in ("auto", r"\t", "tab", r"\x01", r"​", "||", None)] == [None, "\t", "\t", "\x01", "​", "||", None]
    with pytest.raises(ValueError):
        sniff.detect_delimiter(["nothing here", "to split"])


def test_quote_characters():
    assert sniff.quote_character(["a,b", "'x, y',1", "'z, w',2"], ",") == "'" and sniff.quote_character(["a,b", '"x, y",1', "it's,2"], ",") == '"'


@pytest.mark.parametrize(("cells", "want"), [(["id", "name"], True), (["customerId", "2019", "2020"], True), (["order_key", "SKU-1"], True), (["2026-01-02", "x"], False), (["x", "1.5", "y", "z"], True), (["name", "12", "3"], True), (["1", "x"], False), (["ID001", "x"], False), (["R01", "x"], False), (["a1", "SKU-5", "3"], False), (["Customer Name", "City"], True), ([], True)])
def test_headers(cells, want):
    assert sniff.has_header(cells) is want


def test_formats_and_listing(spark, tmp_path):
    assert [readers.format_of_path(p) for p in ("a.pq", "b.jsonl", "c", "d.tgz", "e.XLSX")] == ["parquet", "json", "csv", "tar", "excel"]
    assert readers.normal_format("Fixed_Width") == "fixed-width"
    (tmp_path / "in").mkdir()
    for n in ("a.csv", "b.csv.gz", "c.parquet", "dump"):
        (tmp_path / "in" / n).write_text("x")
    assert sorted(r["name"] for r in readers.list_files(spark, f"{tmp_path}/in", "csv").collect()) == ["a.csv", "b.csv.gz", "dump"]
    assert readers.jdbc_url("oracle", host="h", port=1, database="d") == "jdbc:oracle:thin:@//h:1/d"


def test_columnar_and_nested(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, named_struct('b', 2, 'a', array(1)) AS s, CAST(NULL AS STRING) AS n")
    df.write.parquet(f"{tmp_path}/p")
    assert tuple(readers.as_text(readers.read_columnar(spark, f"{tmp_path}/p", "parquet")).first()) == ("1", '{"a":[1],"b":2}', None)


def workbook(rows):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' if isinstance(c, str) else f"<c><v>{c}</v></c>" for c in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def avro(rows, codec="deflate", pack=None):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "v", "type": ["null", "string"]}, {"name": "x", "type": "double"}]}).encode()
    text = lambda b: zigzag(len(b)) + b
    data = b"".join(zigzag(i) + (zigzag(0) if v is None else zigzag(1) + text(v.encode())) + struct.pack("<d", x) for i, v, x in rows)
    c = zlib.compressobj(wbits=-15)
    data = pack(data) if pack else c.compress(data) + c.flush() if codec == "deflate" else data
    return b"Obj\x01" + zigzag(2) + text(b"avro.schema") + text(schema) + text(b"avro.codec") + text(codec.encode()) + zigzag(0) + b"s" * 16 + zigzag(len(rows)) + zigzag(len(data)) + data + b"s" * 16


def test_excel_and_avro(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook([["id", "name"], [1, "Ann"], [2, "Bob"]]))
    assert [tuple(r) for r in readers.read_columnar(spark, f"{tmp_path}/w.xlsx", "excel").collect()] == [("1", "Ann"), ("2", "Bob")]
    rows = [(1, "a", 0.5), (-7, None, 2.0)]
    for codec in ("deflate", "null"):
        assert [tuple(r.values()) for r in AvroFile(avro(rows, codec)).records()] == rows
    (tmp_path / "f.avro").write_bytes(avro(rows))
    assert [tuple(r) for r in readers.read_columnar(spark, f"{tmp_path}/f.avro", "avro").collect()] == [("1", "a", "0.5"), ("-7", None, "2.0")]


def test_dates_sheets_codecs_and_logical_types(spark, tmp_path):
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    body = lambda cells: f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="One"/><sheet name="Two"/></sheets></workbook>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", body("<row><c t='inlineStr'><is><t>a</t></is></c></row>"))
        z.writestr("xl/worksheets/sheet2.xml", body("<row><c t='inlineStr'><is><t>day</t></is></c><c t='inlineStr'><is><t>at</t></is></c><c t='inlineStr'><is><t>n</t></is></c></row><row><c s='1'><v>45292</v></c><c s='2'><v>45292.75</v></c><c s='0'><v>45292</v></c></row>"))
    assert sheet_rows((tmp_path / "d.xlsx").read_bytes(), "Two")[1] == ["2024-01-01", "2024-01-01T18:00:00", "45292"]
    assert [tuple(r) for r in read_binary(spark, f"{tmp_path}/d.xlsx", "excel", sheet="Two").collect()] == [("2024-01-01", "2024-01-01T18:00:00", "45292")]
    with pytest.raises(ValueError):
        sheet_rows((tmp_path / "d.xlsx").read_bytes(), "Three")
    with pytest.raises(ValueError):
        sheet_rows(b"\xd0\xcf\x11\xe0rest")
    import pyarrow as pa
    import zstandard

    rows = [(1, "a", 0.5), (-7, None, 2.0)] * 50
    snappy = lambda b: pa.compress(b, codec="snappy", asbytes=True) + b"sum!"
    for codec, pack in (("snappy", snappy), ("zstandard", zstandard.compress), ("bzip2", bz2.compress)):
        assert [tuple(r.values()) for r in AvroFile(avro(rows, codec, pack)).records()] == rows
    assert logical(19723, {"logicalType": "date"}).isoformat() == "2024-01-01" and logical(1, {"logicalType": "timestamp-millis"}).isoformat() == "1970-01-01T00:00:00.001000"
    assert str(logical(b"\xff\x38", {"logicalType": "decimal", "scale": 2})) == "-2.00" and logical(3_600_000_000, {"logicalType": "time-micros"}).isoformat() == "01:00:00"


# --- detection -----------------------------------------------------------------

TAR = io.BytesIO()
with tarfile.open(fileobj=TAR, mode="w") as _t:
    _i = tarfile.TarInfo("a/data.csv")
    _i.size = 8
    _t.addfile(_i, io.BytesIO(b"id,v\n1,2"))
ZIP = io.BytesIO()
with zipfile.ZipFile(ZIP, "w") as _z:
    _z.writestr("in.tar", TAR.getvalue())
FIXED = "ID      NAME                AMOUNT  \n" + "".join(f"{i:<8}{'Name' + str(i):<20}{i * 10:<8}\n" for i in range(12))


@pytest.mark.parametrize(
    ("name", "content", "want"),
    [
        ("a.csv", b"id,name\n1,x\n2,y\n", "csv"), ("a.tsv", b"id\tname\n1\tx\n2\ty\n", "csv"), ("a.psv", b"id|name\n1|x\n2|y\n", "csv"), ("a.txt", b"id;name\n1;x\n2;y\n", "csv"), ("a.dat", FIXED.encode(), "fixed-width"),
        ("a.json", b'{"a": 1}', "json"), ("a.json", b"[1, 2]", "json"), ("x", b'{"a":1}\n{"a":2}\n', "json"), ("a.csv", b"PAR1....PAR1", "parquet"), ("a.orc", b"ORC....", "orc"), ("a.avro", avro([(1, "a", 1.0)]), "avro"),
        ("a.xlsx", workbook([["a"]]), "excel"), ("a.csv", b'{"a": 1}', "json"),
    ],
)
def test_detect_formats(name, content, want):
    assert detect.detect(name, content).suggested_format == want


@pytest.mark.parametrize(
    ("content", "want"),
    [(gzip.compress(b"a,b\n1,2"), "decompress_first"), (bz2.compress(b"a"), "decompress_first"), (ZIP.getvalue(), "container"), (TAR.getvalue(), "container"), ("a,b\n".encode("utf-16"), "transcode_first"), (b"\x89PNG\r\n\x1a\n\0\0\0", "png"), (b"%PDF-1.7 x", "pdf"), (b"<?xml version='1.0'?><a/>", "xml"), (b"---\na: 1\n", "yaml")],
)
def test_detect_strategies(content, want):
    assert detect.detect("file", content).strategy.type == want


def test_detection_conflicts_labels_and_plugins(monkeypatch):
    r = detect.detect("a.csv", b"PAR1....PAR1")
    assert r.warnings and "parquet" in r.warnings[0]
    assert detect.display_label("x.zip", ZIP.getvalue()) == "zip -> tar -> csv"
    assert detect.resolve_format([detect.detect("a", b"id,v\n1,2\n3,4\n")] * 2, "auto") == "csv"
    with pytest.raises(ValueError):
        detect.resolve_format([detect.detect("a", b"id,v\n1,2\n3,4\n"), detect.detect("b", b'{"a":1}')], "auto")
    with pytest.raises(ValueError):
        detect.resolve_format([detect.detect("a", b"")], "auto")
    monkeypatch.setattr(detect, "PLUGINS", [lambda guesses: detect.Stage("json", 99)])
    assert detect.detect("a.csv", b"id,v\n1,2\n").suggested_format == "json"


def test_detect_many_files(spark, tmp_path):
    write(tmp_path / "a.csv", "id,v\n1,2\n")
    write(tmp_path / "b.json", '{"a": 1}')
    assert {r["path"][-6:]: r["format"] for r in detect.detect_files(spark, str(tmp_path)).collect()} == {"/a.csv": "csv", "b.json": "json"}


# --- archives --------------------------------------------------------------------


def test_manifests_and_leaves(spark, tmp_path):
    for name, value in (("s", "id,v\n1,a\n"), ("t", "id,v\n1,b\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("d/data.csv", value)
            z.writestr("same.txt", "same")
            z.writestr(f"only_{name}.txt", "x")
            z.writestr("inner.zip", ZIP.getvalue())
    s, t = (archives.read_manifest(spark, f"{tmp_path}/{n}.zip") for n in "st")
    assert {r["path"] for r in s.collect()} == {"d/data.csv", "same.txt", "only_s.txt", "inner.zip", "inner.zip/in.tar", "inner.zip/in.tar/a/data.csv"}
    got = {(r["uid"], r["mismatch_type"], r["column_name"]) for r in compare.manifest_diff(s, t).collect()}
    assert got == {("d/data.csv", "value_mismatch", "crc32"), ("only_s.txt", "missing_in_target", None), ("only_t.txt", "extra_in_target", None)}
    lines = archives.read_leaf_lines(spark, f"{tmp_path}/s.zip").orderBy("n").collect()
    assert [r["line"] for r in lines] == ["id,v", "1,2"] and lines[0]["member"] == "inner.zip/in.tar/a/data.csv"
    assert archives.leaf(gzip.compress(b"a,b"), "*.csv") == ("", b"a,b")


def test_bombs_are_refused():
    with pytest.raises(ValueError):
        archives.guard([("x", 10, 10**6, 0, 8, None, False)], ratio=100)
    with pytest.raises(ValueError):
        archives.guard([("x", 10**9, 10**9, 0, 8, None, False)], declared=10**6)


# --- fixed width -------------------------------------------------------------------

PEOPLE = (Slice("id", (0, 5)), Slice("name", (8, 28), sensitive=True), Slice("dob", (28, 38), type="date", source_date_format="DD/MM/YYYY", target_date_format="MM/DD/YYYY"), Slice("n", (38, 44), type="float"))


def people(spark, *rows):
    return spark.createDataFrame([(i, f"{a:<8}{b:<20}{c:<10}{d:>6}") for i, (a, b, c, d) in enumerate(rows)], "n long, line string")


def test_fixed_width_types(spark):
    s = people(spark, ("1", "Ann", "19/05/2026", "1.50"), ("2", "Bob", "01/02/2026", "x"), ("3", "Cy", "", "1"), ("1", "Ann", "19/05/2026", "1.5"))
    t = people(spark, ("1", "Ann", "05/19/2026", "1.500"), ("2", "Rob", "02/01/2026", "x"), ("4", "Di", "", "1"))
    got = {(r["uid"], r["mismatch_type"], r["column_name"], r["source_value"], r["target_value"]) for r in reconcile_fixed_width(s, t, PEOPLE, "id").collect()}
    assert got == {("2", "value_mismatch", "name", "***", "***"), ("2", "value_mismatch", "n", "x", "x"), ("3", "missing_in_target", None, None, None), ("4", "extra_in_target", None, None, None)}


def test_line_by_line(spark):
    s = spark.createDataFrame([(0, "19/05/2026"), (1, "20/05/2026"), (2, "xx"), (3, "1/1/2026")], "n long, line string")
    t = spark.createDataFrame([(0, "05/19/2026"), (1, "05/21/2026"), (2, "05/19/2026")], "n long, line string")
    got = {(r["n"], r["problem"]) for r in line_by_line(s, t, (0, 10, "DD/MM/YYYY"), (0, 10, "MM/DD/YYYY")).collect()}
    assert got == {(1, "value_mismatch"), (2, "parse_error"), (3, "missing_in_target")}


def test_layouts(spark, tmp_path):
    lines = [f"{i:<8}{'n' + str(i):<12}{'[1, 2]':<10}{'19/05/2026':<14}{i * 7:<6}" for i in range(100, 110)]
    cols = layout.infer_layout(lines, [x.replace("19/05/2026", "05/19/2026") for x in lines])
    assert [c.type for c in cols] == ["integer", "text", "structured", "date", "integer"]
    assert [c.name for c in cols] == ["record_id", "name", "metadata", "date", "field_5"]
    assert cols[3].source_date_format == "DD/MM/YYYY" and cols[3].target_date_format == "MM/DD/YYYY"
    assert layout.boundaries(["ab c", "d ef"]) == [(0, 4)]
    assert layout.word_columns(["ab c", "d ef"]) == [(0, 2), (2, 4)]
    path = write(tmp_path / "f.txt", "\n".join([*lines, "", "  "]))
    df = readers.read_fixed_width(spark, path, [("id", 0, 8), ("none", 5, 5), ("name", 8, 20)])
    assert df.count() == 10 and tuple(df.first()) == ("100", "", "n100")
    types = {r[0]: r[1] for r in layout.column_types(spark.createDataFrame([("1", "1.5", "2026-01-01", "{1}", "a"), ("2", "3", " ", "", None)], "a string, b string, c string, d string, e string"), list("abcde")).collect()}
    assert types == {"a": "integer", "b": "float", "c": "date", "d": "structured", "e": "text"}


# --- JSON ------------------------------------------------------------------------------


def errors(n):
    return [{"error": f"e{i}", "field": f"f{i}"} for i in range(n)]


def changed(n, k):
    out = errors(n)[::-1]
    for i in range(k):
        out[i] = {"error": f"changed{i}", "field": out[i]["field"]}
    return out


def test_documents_by_order():
    s, t = {"errors": errors(500), "success": True}, {"errors": changed(500, 25), "success": False}
    kinds = lambda ordered: [k for _, k, *_ in json_diff.differences(s, t, ordered)]
    free = kinds(False)
    assert (free.count("missing_in_target"), free.count("extra_in_target"), free.count("value_mismatch")) == (25, 25, 1)
    assert set(kinds(True)) == {"value_mismatch"} and len(kinds(True)) == 1001


def test_paths_and_details(spark):
    s, t = '{"a": {"b": [1, {"c": null}]}, "x": 1}', '{"a": {"b": [1, {"c": 2}]}, "y": [1]}'
    rows = list(json_diff.diff_rows("u", s, t, True))
    assert {(r[1], r[2], r[3], r[4]) for r in rows} == {("value_mismatch", "a.b[1].c", "__NULL__", "2"), ("missing_in_target", "x", "1", None), ("extra_in_target", "y", None, "[1]")}
    assert json.loads(rows[-1][5])["parent_path"] in ("a.b[1]", "$")
    assert list(json_diff.diff_rows("u", '{"items":["a","b"],"meta":{"x":1,"y":2}}', '{"meta":{"y":2,"x":1},"items":["b","a"]}', False)) == []
    assert list(json_diff.diff_rows("u", '{"p": 1, "q": 2}', '{"z": 1}', False, [("p", "z")])) == []


class Pairs:
    """In place of a DataFrame: gives the function that its batches would go through."""

    where = select = lambda self, *_: self

    def mapInArrow(self, run, schema):
        return run


def test_long_lists_leave_in_small_batches(spark):
    text = lambda n: json.dumps({"items": list(range(10000, 10000 + n))})
    pairs = pa.RecordBatch.from_pydict({"uid": ["a", "b"], "source": [text(5000), text(1)], "target": [text(4700), text(2)]})
    batches = list(json_diff.diff_json(Pairs())(iter([pairs])))
    assert sum(b.num_rows for b in batches) == 301 and max(b.nbytes for b in batches) < 1 << 23
    detail = json.loads(batches[0].column("row_detail")[0].as_py())
    assert len(detail["source_parent"]) == len(detail["source_sibling_keys"]) == 5000 and len(detail["target_parent"]) == 4700
    bare = list(json_diff.diff_json(Pairs(), details=False)(iter([pairs])))
    assert [b.num_rows for b in bare] == [301]
    assert json.loads(bare[0].column("row_detail")[0].as_py()) == {"json_path": "items[4700]", "parent_path": "items", "mismatch_type": "missing_in_target"}


def test_unordered_lists_pair_in_order():
    s, t = ["a", "b", "a", "a", 1, "c"], ["d", "a", "c", "b", "b", "a", "d", "b"]
    got = [(p[-1], k) for p, k, *_ in json_diff.differences(s, t, False)]
    assert got == [(3, "missing_in_target"), (4, "missing_in_target"), (0, "extra_in_target"), (4, "extra_in_target"), (6, "extra_in_target"), (7, "extra_in_target")]


def test_json_lines(spark, tmp_path):
    s = write(tmp_path / "s.ndjson", '{"id": 1, "v": [1,2]}\n\n{"id": 2, "v": 1}\n{"id": 3}\n')
    t = write(tmp_path / "t.ndjson", '{"id": 1, "v": [2,1]}\n{"id": 2, "v": 9}\n{"id": 4}\n')
    (a, left), (b, right) = readers.read_json(spark, s), readers.read_json(spark, t)
    assert a == b == "ndjson"
    got = {(r["uid"], r["mismatch_type"], r["column_name"]) for r in json_diff.diff_json_lines(left, right, "id").collect()}
    assert got == {("2", "value_mismatch", "v"), ("3", "missing_in_target", None), ("4", "extra_in_target", None)}
    assert readers.read_json(spark, write(tmp_path / "d.json", '{\n "a": [1,\n 2]}'))[0] == "document"
    keys = {(r["key"], r["type"]) for r in json_diff.top_level_keys(left).collect()}
    assert keys == {("id", "number"), ("v", "array"), ("v", "number")}
    assert json_diff.suggest_parents(json_diff.top_level_keys(left), json_diff.top_level_keys(right)).count() == 2


def test_constraints(spark):
    df = spark.createDataFrame([("1", " ", "12", "2026-01-01"), ("2", "ab", "1x", "01/02/2026"), ("3", "abcdef", "", "")], "id string, name string, n string, d string")
    rules = [Constraint("name", required=True, min_length=3, max_length=5), Constraint("n", "integer"), Constraint("d", "date"), Constraint("absent", required=True), Constraint("id", pattern="[12]")]
    got = {(r["row"], r["column"], r["message"]) for r in check(df, rules, "id").collect()}
    assert got == {("1", "name", "value is required"), ("2", "name", "length 2 is below 3"), ("3", "name", "length 6 is above 5"), ("2", "n", "not an integer"), ("2", "d", "not a date"), ("3", "id", "pattern does not match")}
