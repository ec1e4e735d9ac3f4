"""What a file is, from its name and at most 64 KiB of it.

Each layer gives a guess with a confidence; the surest one wins if it is sure enough.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import csv
import gzip
import io
import json
import lzma
import math
import re
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import boundaries
from .readers import AMBIGUOUS, SUFFIXES, normal_format, split_line

SAMPLE = 64 * 1024
# First bytes of formats, what they are, and how sure that is.
SIGNATURES = (
    (b"\x1f\x8b", "gzip", 92), (b"BZh", "bzip2", 90), (b"\xfd7zXZ\x00", "xz", 90), (b"\x28\xb5\x2f\xfd", "zstd", 90), (b"\x04\x22\x4d\x18", "lz4", 88),
    (b"PK\x03\x04", "zip", 95), (b"PK\x05\x06", "zip", 90), (b"PK\x07\x08", "zip", 90), (b"7z\xbc\xaf\x27\x1c", "7z", 95), (b"Rar!\x1a\x07", "rar", 95),
    (b"PAR1", "parquet", 98), (b"ORC", "orc", 95), (b"Obj\x01", "avro", 90), (b"\x89PNG\r\n\x1a\n", "png", 98), (b"%PDF", "pdf", 98),
    (b"<?xml", "xml", 85), (b"\xd0\xcf\x11\xe0", "excel", 90), (b"\xff\xd8\xff", "jpeg", 95), (b"GIF87a", "gif", 95), (b"GIF89a", "gif", 95),
    (b"BM", "bmp", 60), (b"\x7fELF", "elf", 95), (b"SQLite format 3\x00", "sqlite", 98), (b"ARROW1", "arrow", 95),
)
# Byte order marks.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8-bom"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
IMAGES = {"png", "jpeg", "gif", "bmp", "pdf"}
COMPRESSIONS, CONTAINERS, COLUMNAR = {"gzip", "bzip2", "xz", "zstd", "lz4"}, {"zip", "tar", "7z", "rar"}, {"parquet", "orc", "avro", "excel"}


@dataclass(frozen=True)
class Stage:
    type: str
    confidence: int
    evidence: str = ""
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Report:
    name: str
    stages: dict[str, Stage]
    strategy: Stage
    suggested_format: str | None
    warnings: tuple[str, ...] = ()


UNKNOWN = Stage("unknown", 0)
PLUGINS: list[Callable[[list[tuple[str, int]]], Stage | None]] = []


def register_format(plugin: Callable[[list[tuple[str, int]]], Stage | None]) -> None:
    """A function from the guesses to another guess or None; the first that gives one is heard."""
    PLUGINS.append(plugin)


def by_extension(name: str) -> Stage:
    low = name.lower()
    if low.endswith(AMBIGUOUS):
        return Stage("csv", 20, "ambiguous ending")
    hit = next((f for s, f in SUFFIXES.items() if low.endswith(s)), None)
    return Stage(hit, 35, "file name") if hit else UNKNOWN


def by_magic(head: bytes, tail: bytes = b"") -> Stage:
    for sig, kind, sure in SIGNATURES:
        if head.startswith(sig):
            return Stage(kind, sure, f"begins with {sig!r}")
    if tail[-4:] == b"PAR1" and len(head) >= 4:
        return Stage("parquet", 98, "ends with PAR1")
    if head[257:262] == b"ustar":
        return Stage("tar", 95, "ustar header")
    return UNKNOWN


def by_container(content: bytes, magic: Stage) -> Stage:
    """Members of a zip or tar, at most 1,000; a zip with a workbook is Excel."""
    names: list[str] = []
    try:
        if magic.type == "zip":
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()[:1000]
        elif magic.type == "tar":
            for m in tarfile.open(fileobj=io.BytesIO(content)):
                names.append(m.name)
                if len(names) == 1000:
                    break
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
        pass
    if magic.type not in ("zip", "tar"):
        return UNKNOWN
    if any(n.startswith("xl/") for n in names):
        return Stage("excel", 97, "workbook in a zip")
    nested = any(n.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz")) for n in names)
    return Stage(magic.type, 94, f"{len(names)} members", {"members": names, "nested": nested})


def by_encoding(head: bytes) -> Stage:
    for mark, name in MARKS:
        if head.startswith(mark):
            return Stage(name, 95, "byte order mark", {} if name == "utf-8-bom" else {"hint": "transcode_first"})
    text = head.strip()
    if len(text) >= 32 and len(text) % 2 == 0 and re.fullmatch(rb"[0-9A-Fa-f]+", text):
        return Stage("hex", 70, "hexadecimal digits", {"hint": "transcode_first"})
    if len(text) >= 32 and len(text) % 4 == 0 and re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", text):
        try:
            base64.b64decode(text, validate=True)
            return Stage("base64", 65, "base64 alphabet", {"hint": "transcode_first"})
        except binascii.Error:
            pass
    if len(re.findall(rb"%[0-9A-Fa-f]{2}", text)) * 3 > len(text) * 0.2 > 0:
        return Stage("url-encoding", 60, "percent escapes", {"hint": "transcode_first"})
    broken = head.decode("utf-8", "replace").count("�")
    share = 1 - broken / max(1, len(head))
    return Stage("utf-8", 90 if share >= 0.98 else 60, f"{share:.3f} valid") if share >= 0.85 else Stage("binary", 60, f"{share:.3f} valid")


def entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def text_or_binary(head: bytes) -> Stage:
    if not head:
        return Stage("empty", 90)
    nul = head.count(0) / len(head)
    printable = sum(32 <= b < 127 or b in (9, 10, 13) or b >= 128 for b in head) / len(head)
    kind = "binary" if nul > 0.05 or printable < 0.7 else "text"
    return Stage(kind, 80, f"nul {nul:.3f}, printable {printable:.3f}", {"entropy": round(entropy(head), 3)})


@dataclass(frozen=True)
class Shape:
    """What the tests of text formats look at, measured once."""

    text: str
    lines: list[str]

    def share(self, pattern: str) -> float:
        """Share of the lines that a pattern fits."""
        return sum(re.match(pattern, x) is not None for x in self.lines) / len(self.lines)

    def parsed(self, texts: list[str]) -> bool:
        for t in texts:
            if t.lstrip()[:1] not in ("{", "["):
                return False
            try:
                json.loads(t)
            except ValueError:
                return False
        return True

    def split_by(self, delimiter: str) -> int:
        """Fields of every line if all have the same number, else 0; the sample may end inside its last line."""
        whole = self.lines[:-1] if len(self.text) >= SAMPLE - 4 and len(self.lines) > 2 else self.lines
        widths = {len(split_line(x, delimiter)) for x in whole}
        return widths.pop() if len(widths) == 1 else 0

    def columns_by_position(self) -> int:
        """Columns between blank positions of lines that are equally long."""
        body = self.lines[1:] if len(self.lines) > 2 else self.lines
        return len(boundaries(body)) if len({len(x) for x in body}) == 1 else 0


def _json_lines(s: Shape) -> bool:
    return len(s.lines) > 1 and s.parsed(s.lines[:2])


def _truncated_json(s: Shape) -> bool:
    return len(s.text) >= SAMPLE - 4 and re.match(r'\s*(\{\s*"|\[\s*([\[{"\d-]|true|false|null))', s.text) is not None


def _fixed_width(s: Shape) -> bool:
    return len(s.lines) > 1 and s.columns_by_position() > 1 and not any(s.split_by(d) > 1 for _, d in DELIMITED)


def _yaml_keys(s: Shape) -> bool:
    return len(s.lines) > 2 and s.share(r"\s*(-\s+)?\w[\w -]*:(\s|$)|\s*-\s") >= 0.75


# Delimited formats by their delimiter, and how sure each text format is.
DELIMITED = (("tsv", "\t"), ("csv", ","), ("csv", ";"), ("psv", "|"))
SURE = {"json": 90, "json lines": 85, "truncated json": 80, "xml": 82, "yaml document": 75, "yaml": 68, "fixed-width": 70, "tsv": 88, "csv": 85, "psv": 80}
TESTS: dict[str, Callable[[Shape], bool]] = {
    "json": lambda s: s.parsed([s.text]), "json lines": _json_lines, "truncated json": _truncated_json,
    "xml": lambda s: re.match(r"\s*<[?!A-Za-z][^<>]*>", s.text) is not None, "yaml document": lambda s: s.lines[0].startswith("---"),
    "yaml": _yaml_keys, "fixed-width": _fixed_width,
}
NAMES = {"json lines": ("json", {"variant": "jsonl"}), "truncated json": ("json", {}), "yaml document": ("yaml", {})}


def by_structure(head: bytes, kind: Stage, magic: Stage) -> Stage:
    """The surest text format that fits; of delimited ones that with the most fields."""
    if kind.type == "binary":
        return magic if magic.type in COLUMNAR | IMAGES else Stage("binary", 55)
    text = head.decode("utf-8-sig", "replace")
    shape = Shape(text, [x for x in text.splitlines() if x.strip()][:40])
    if not shape.lines:
        return Stage("unknown", 20, "no text")
    fits = {name: SURE[name] for name, test in TESTS.items() if test(shape)}
    marked = any(n.startswith(("json", "truncated", "xml")) or n == "yaml document" for n in fits)
    if not marked and len(shape.lines) > 1:
        fields, name, delimiter = max((shape.split_by(d), n, d) for n, d in DELIMITED)
        if fields > 1:
            return Stage(name, SURE[name], f"{fields} fields in every line", {"delimiter": delimiter})
    if not fits:
        return Stage("unknown", 25)
    best = max(fits, key=fits.get)
    kind_, more = NAMES.get(best, (best, {}))
    return Stage(kind_, fits[best], best, more)


def schema_hint(head: bytes, structure: Stage) -> Stage:
    text = head.decode("utf-8-sig", "replace")
    lines = [x for x in text.splitlines() if x.strip()]
    if structure.type in ("csv", "tsv", "psv"):
        names = next(csv.reader(lines[:1], delimiter=structure.metadata["delimiter"]), [])
        return Stage("columns", 70, "", {"columns": [n.strip() for n in names]})
    if structure.type == "json":
        try:
            rows = [json.loads(x) for x in lines[:100]] if structure.metadata.get("variant") == "jsonl" else [json.loads(text)]
        except ValueError:
            return UNKNOWN
        rows = rows[0] if len(rows) == 1 and isinstance(rows[0], list) else rows
        return Stage("keys", 70, "", {"columns": list(dict.fromkeys(k for r in rows if isinstance(r, dict) for k in r))})
    return UNKNOWN


#: How sure each layer must be to be heard.
HEARD = {"structure": 60, "magic": 70, "compression": 80, "container": 70, "extension": 20}
#: A hint's weight, and what the winner needs.
HINT, NEEDED = 45, 50


def detect(name: str, content: bytes, hint: str | None = None) -> Report:
    """All layers over a file's head; ``content`` may be the whole of a small file."""
    head = content[:SAMPLE]
    magic, kind = by_magic(head, content[-4:]), text_or_binary(head)
    stages = {"extension": by_extension(name), "magic": magic, "container": by_container(content, magic), "encoding": by_encoding(head), "text": kind, "structure": by_structure(head, kind, magic)}
    stages |= {"compression": magic if magic.type in COMPRESSIONS else Stage("none", 50), "schema": schema_hint(head, stages["structure"])}
    votes = {}
    for layer, least in HEARD.items():
        vote = stages[layer]
        if vote.confidence >= least and vote.type not in ("none", "unknown"):
            votes[vote.type] = max(vote.confidence, votes.get(vote.type, 0))
    extra = next((found for plugin in PLUGINS if (found := plugin(list(votes.items())))), None)
    if extra:
        votes[extra.type] = max(extra.confidence, votes.get(extra.type, 0))
    if hint and normal_format(hint) != "auto":
        votes[normal_format(hint)] = max(HINT, votes.get(normal_format(hint), 0))
    best = max(votes, key=votes.get, default="unknown")
    return _report(name, stages, best, votes.get(best, 15))


def _report(name: str, stages: dict[str, Stage], best: str, sure: int) -> Report:
    """What is to be done with a file whose content is ``best``."""
    family, named, coded = {"tsv": "csv", "psv": "csv"}.get(best, best), stages["extension"], stages["encoding"]
    conflict = sure >= 70 and named.confidence >= 30 and named.type != family
    warnings = (f"the name suggests {named.type}, the content {best}",) if conflict else ()
    if coded.metadata.get("hint") and best not in COMPRESSIONS | COLUMNAR | CONTAINERS | {"json"}:
        return Report(name, stages, Stage(coded.metadata["hint"], coded.confidence), None, warnings)
    plain_csv = family == "csv" and named.confidence >= 35 and stages["text"].type == "text"
    if sure < NEEDED and not plain_csv:
        return Report(name, stages, Stage("unknown", sure), None, warnings)
    if best in COMPRESSIONS:
        return Report(name, stages, Stage("decompress_first", sure), None, warnings)
    if best in CONTAINERS:
        return Report(name, stages, Stage("container", sure, "", stages["container"].metadata), best, warnings)
    readable = family in COLUMNAR or family in ("csv", "json", "fixed-width")
    return Report(name, stages, Stage(best, sure), family if readable else None, warnings)


def resolve_format(reports: list[Report], declared: str | None) -> str:
    """The format of both sides: auto needs 55, content overrides a declared one from 75; the sides must agree."""
    out = []
    for r in reports:
        fmt = normal_format(declared)
        if fmt == "auto":
            if r.strategy.confidence < 55 or not r.suggested_format:
                raise ValueError(f"cannot tell the format of {r.name}; give it")
            fmt = r.suggested_format
        elif r.suggested_format and r.suggested_format != fmt and r.strategy.confidence >= 75:
            fmt = r.suggested_format
        out.append(fmt)
    if len(set(out)) > 1:
        raise ValueError(f"the sides differ in format: {', '.join(out)}")
    return out[0]


#: Members up to this size are opened for a label.
LABELLED = 64 << 20


def display_label(name: str, content: bytes, depth: int = 5) -> str:
    """The chain of containers and what they hold, as ``zip -> tar -> csv``."""
    report = detect(name, content)
    if depth and report.strategy.type == "container":
        for inner, _, read in members(content, report.suggested_format, LABELLED):
            return f"{report.suggested_format} -> {display_label(inner, read(), depth - 1)}"
        return report.suggested_format
    if depth and report.strategy.type == "decompress_first":
        bare, data = peel(name, content)
        kind = report.stages["magic"].type
        return f"{kind} -> {display_label(bare, data, depth - 1)}" if (bare, data) != (name, content) else kind
    if name.lower().endswith(AMBIGUOUS):
        return name.rsplit(".", 1)[-1].lower()
    return report.suggested_format or report.strategy.type


def peel(name: str, content: bytes) -> tuple[str, bytes]:
    """A compressed file's name without the compression's ending and the first bytes of what it holds; others as they are."""
    kind = by_magic(content).type
    if kind not in COMPRESSIONS or kind == "lz4":
        return name, content
    bare = re.sub(r"(?i)\.tgz$", ".tar", re.sub(r"(?i)\.(gz|bz2|xz|zst)$", "", name))
    return bare, unpacked(kind, content, SAMPLE * 16)


def unpacked(kind: str, content: bytes, most: int | None = None) -> bytes:
    """What a compressed file holds, at most its first ``most`` bytes; for that its content may be cut off."""
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read(-1 if most is None else most)
    if most is None:
        return {"gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress}[kind](content)
    if kind == "gzip":
        return zlib.decompressobj(31).decompress(content, most)
    return (bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()).decompress(content, most)


NESTED = (".zip", ".tar", ".tgz", ".tar.gz")


def members(content: bytes, kind: str, most: int | None = None) -> Iterator[tuple[str, int, Callable[[], bytes]]]:
    """Name, size and reader of a container's files, containers first, then by name; with ``most`` only files up to this size."""
    if kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(content))
        found = [(i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist() if not i.is_dir()]
    else:
        t = tarfile.open(fileobj=io.BytesIO(content))
        found = [(m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
    yield from sorted((f for f in found if most is None or f[1] <= most), key=lambda f: (not f[0].lower().endswith(NESTED), f[0]))


def detect_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, format, confidence of every file of a folder, detected where the files are read."""

    @F.pandas_udf("format string, confidence int")
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        found = [detect(p.rsplit("/", 1)[-1], bytes(c)) for p, c in zip(paths, contents, strict=True)]
        return pd.DataFrame({"format": [r.suggested_format or r.strategy.type for r in found], "confidence": [r.strategy.confidence for r in found]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    head = F.substring("content", 1, SAMPLE)
    whole = F.when(F.col("length") <= (8 << 20), F.col("content")).otherwise(head)
    return files.select("path", run("path", whole).alias("d")).select("path", "d.format", "d.confidence")
