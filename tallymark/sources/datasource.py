"""Formats whose Spark modules may be absent: Excel workbooks and Avro files, parsed where Spark reads their bytes."""

from __future__ import annotations

import bz2
import io
import json
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Numbers of the built-in formats that show dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCH = datetime(1899, 12, 30)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates: built-in formats, and own ones with letters of dates outside quotes and brackets."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_X}numFmt")}
    dated = DATE_FORMATS | {n for n, code in own.items() if re.search(r"[ymdhs]", code, re.I) and "general" not in code.lower()}
    styles = root.find(f"{_X}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in dated}


def _serial(text: str) -> str:
    """A serial number as an ISO date, with the time if it has one."""
    at = EPOCH + timedelta(seconds=round(float(text) * 86_400))
    return at.date().isoformat() if at.time() == time() else at.isoformat()


def _sheet_file(z: zipfile.ZipFile, sheet: int | str) -> str:
    """The file of a sheet by its number from 1 or its name."""
    if isinstance(sheet, int) or sheet.isdigit():
        return f"xl/worksheets/sheet{sheet}.xml"
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
    if sheet not in names:
        raise ValueError(f"the workbook has no sheet {sheet}; it has {', '.join(map(str, names))}")
    return f"xl/worksheets/sheet{names.index(sheet) + 1}.xml"


def sheet_rows(content: bytes, sheet: int | str = 1) -> list[list[str | None]]:
    """Rows of a workbook's sheet as text cells; dates as ISO."""
    if content[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("workbooks of the old binary format (.xls) are not read; save them as .xlsx")
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_X}t")))
    dated, rows = _date_styles(z), []
    for row in ElementTree.fromstring(z.read(_sheet_file(z, sheet))).iter(f"{_X}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{_X}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "")) or None
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
            cells += [None] * (at + 1 - len(cells))
            v = c.find(f"{_X}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_X}t"))
            elif v is not None and v.text is not None:
                kind = c.get("t", "n")
                if kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = {"1": "true", "0": "false"}.get(v.text, v.text)
                else:
                    cells[at] = _serial(v.text) if kind == "n" and int(c.get("s", 0)) in dated else v.text
        rows.append(cells)
    return rows


def _snappy(data: bytes) -> bytes:
    """Raw snappy, followed by four bytes of a checksum; its size comes first."""
    size = shift = at = 0
    while True:
        size |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 128:
            return pa.decompress(data[:-4], size, codec="snappy", asbytes=True)


def _zstandard(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(data).read()


CODECS = {"null": lambda d: d, "deflate": lambda d: zlib.decompress(d, -15), "snappy": _snappy, "zstandard": _zstandard, "bzip2": bz2.decompress, "xz": lzma.decompress}


def logical(v: object, s: dict) -> object:
    """A value of a logical type; others as they are."""
    kind = s.get("logicalType")
    if v is None or kind is None:
        return v
    if kind == "decimal":
        return Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-s.get("scale", 0))
    if kind == "date":
        return date(1970, 1, 1) + timedelta(days=v)
    unit = {"millis": 1000, "micros": 1}.get(kind.rsplit("-", 1)[-1])
    if unit and "timestamp" in kind:
        return datetime(1970, 1, 1) + timedelta(microseconds=v * unit)
    if unit and kind.startswith("time-"):
        return (datetime(1970, 1, 1) + timedelta(microseconds=v * unit)).time()
    return v


class AvroFile:
    """A reader of Avro container files with records of primitives, unions, arrays, maps, enums and fixed."""

    def __init__(self, content: bytes):
        self.f = io.BytesIO(content)
        if self.f.read(4) != b"Obj\x01":
            raise ValueError("not an Avro file")
        meta = self.value({"type": "map", "values": "bytes"})
        self.named: dict[str, dict] = {}
        self.schema = json.loads(meta["avro.schema"])
        self.codec = meta.get("avro.codec", b"null").decode()
        self.sync = self.f.read(16)

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.f.read(1)[0]
            n |= (b & 127) << shift
            if not b & 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def blocks(self) -> Iterator[None]:
        while n := self.long():
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                yield

    def value(self, s: object) -> object:
        v = self.plain(s)
        return logical(v, s) if isinstance(s, dict) and "logicalType" in s else v

    def plain(self, s: object) -> object:
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(s, list):
            return self.value(s[self.long()])
        if isinstance(kind, dict | list):
            return self.value(kind)
        if isinstance(s, dict) and "name" in s:
            self.named[s["name"]] = s
        if kind == "null":
            return None
        if kind == "boolean":
            return self.f.read(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self.f.read(4 if kind == "float" else 8))[0]
        if kind in ("bytes", "string"):
            data = self.f.read(self.long())
            return data.decode() if kind == "string" else data
        if kind == "fixed":
            return self.f.read(s["size"])
        if kind == "enum":
            return s["symbols"][self.long()]
        if kind == "array":
            return [self.value(s["items"]) for _ in self.blocks()]
        if kind == "map":
            return {self.value("string"): self.value(s["values"]) for _ in self.blocks()}
        if kind in ("record", "error"):
            return {x["name"]: self.value(x["type"]) for x in s["fields"]}
        return self.value(self.named[kind])

    def records(self) -> Iterator[dict]:
        whole = self.f
        while whole.tell() < len(whole.getbuffer()):
            self.f = whole
            n, size = self.long(), self.long()
            data = whole.read(size)
            if self.codec not in CODECS:
                raise ValueError(f"Avro codec {self.codec} is not supported")
            data = CODECS[self.codec](data)
            self.f = io.BytesIO(data)
            for _ in range(n):
                yield self.value(self.schema)
            whole.read(16)


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    if isinstance(v, dict | list):
        return json.dumps(v, sort_keys=True, default=_text)
    return v.isoformat() if isinstance(v, date | time) else f"{v:f}" if isinstance(v, Decimal) else str(v)


def _excel(content: bytes, sheet: int | str) -> tuple[list[str], Iterable[list]]:
    rows = sheet_rows(content, sheet)
    names = [(c or f"column_{i + 1}").strip() for i, c in enumerate(rows[0])] if rows else []
    return names, rows[1:]


def _avro(content: bytes, _: object) -> tuple[list[str], Iterable[list]]:
    f = AvroFile(content)
    names = [x["name"] for x in f.schema["fields"]]
    return names, ([_text(r[n]) for n in names] for r in f.records())


PARSERS = {"excel": _excel, "avro": _avro}


def read_binary(spark: SparkSession, path: str | list[str], fmt: str, sheet: int | str = 1, rows_at_once: int = 10_000) -> DataFrame:
    """All files at ``path`` as text columns, named as in the first of them; a column that a file lacks is null. Any path that Spark reads."""
    from .readers import unique

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.agg(F.min("path")).first()[0]
    parse = PARSERS[fmt]

    def head(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(parse(content, sheet)[0], pa.string())], ["name"])

    if first is None:
        return spark.createDataFrame([], "")
    names = unique([r["name"] for r in spark.read.format("binaryFile").load(first).select("content").mapInArrow(head, "name string").collect()])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                own, found = parse(content, sheet)
                at, held = {n: i for i, n in enumerate(unique(own))}, []
                for r in found:
                    held.append([r[at[n]] if n in at and at[n] < len(r) else None for n in names])
                    if len(held) == rows_at_once:
                        yield table(held)
                        held = []
                if held:
                    yield table(held)

    def table(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)

    return files.select("content").mapInArrow(rows, ", ".join("`" + n.replace("`", "``") + "` string" for n in names))
