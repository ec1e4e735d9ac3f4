"""Manifests and leaves of ZIP and TAR archives, nested ones too, read where Spark reads the files."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_path
from .detect import COMPRESSIONS, NESTED, by_magic, members, unpacked

# Limits of nested archives and of bombs.
DEPTH, MEMBER_BYTES, ENTRIES = 3, 64 << 20, 1000
DECLARED_BYTES, RATIO = 10 << 30, 1000.0
MANIFEST = "archive string, path string, compressed_size long, uncompressed_size long, crc32 long, compress_type int, mtime long, is_dir boolean"
NAMES = ("archive", "path", "compressed_size", "uncompressed_size", "crc32", "compress_type", "mtime", "is_dir")


def entries(content: bytes, prefix: str = "", depth: int = DEPTH) -> Iterator[tuple]:
    """Manifest rows of an archive; members that are archives are followed by their own, as ``outer/inner``."""
    kind = by_magic(content).type
    if kind == "gzip":
        yield from entries(gzip.decompress(content), prefix, depth)
        return
    if kind == "zip":
        z = zipfile.ZipFile(io.BytesIO(content))
        rows = [(i.filename.replace("\\", "/").strip("/"), i.compress_size, i.file_size, i.CRC, i.compress_type, None, i.is_dir()) for i in z.infolist()]
    elif kind == "tar":
        rows = [(m.name.strip("/"), m.size, m.size, None, None, int(m.mtime), m.isdir()) for m in tarfile.open(fileobj=io.BytesIO(content)) if m.isfile() or m.isdir()]
    else:
        return
    guard(rows)
    for r in rows:
        yield (prefix + r[0], *r[1:])
    if depth > 1:
        for name, size, read in members(content, kind):
            if not name.lower().endswith(NESTED) and size > MEMBER_BYTES:
                continue  # listed above; only archives are looked into
            data = read()
            if by_magic(data).type in ("zip", "tar") or name.lower().endswith((".tgz", ".tar.gz")):
                if size > MEMBER_BYTES:
                    raise ValueError(f"{prefix}{name} is a nested archive of over {MEMBER_BYTES} bytes")
                yield from entries(data, f"{prefix}{name.strip('/')}/", depth - 1)


def guard(rows: Iterable[tuple], declared: int = DECLARED_BYTES, ratio: float = RATIO) -> None:
    """Refuses archives that declare too much or shrink too well, before anything is unpacked."""
    files = [r for r in rows if not r[6]]
    if sum(r[2] for r in files) > declared:
        raise ValueError(f"the archive declares over {declared} bytes")
    for r in files:
        if r[2] > ratio * max(1, r[1]):
            raise ValueError(f"{r[0]} unpacks to over {ratio:g} times its size")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of each archive at ``path``."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [(p, *e) for e in entries(content)]
                if found:
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], list(NAMES))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MANIFEST)


def leaf(content: bytes, pattern: str = "*", depth: int = DEPTH) -> tuple[str, bytes] | None:
    """The first file inside that fits: nested containers first, then names in order. Leaves may be of any size, nested containers of MEMBER_BYTES."""
    kind = by_magic(content).type
    if kind in COMPRESSIONS and kind != "lz4":
        inner = unpacked(kind, content)
        return leaf(inner, pattern, depth) or ("", inner)
    if kind not in ("zip", "tar") or depth < 1:
        return None
    guard([(name, size if kind == "tar" else packed, size, None, None, None, False) for name, size, packed in _sizes(content, kind)])
    for name, size, read in members(content, kind):
        fits = fnmatch(name.rsplit("/", 1)[-1].lower(), pattern.lower())
        if name.lower().endswith(NESTED):
            if size > MEMBER_BYTES:
                raise ValueError(f"{name} is a nested archive of over {MEMBER_BYTES} bytes")
            inner = leaf(read(), pattern, depth - 1)
            if inner:
                return f"{name}/{inner[0]}".rstrip("/"), inner[1]
        if fits:
            return name, read()
    return None


def _sizes(content: bytes, kind: str) -> list[tuple[str, int, int]]:
    """Name, unpacked and packed size of each file."""
    if kind == "zip":
        return [(i.filename, i.file_size, i.compress_size) for i in zipfile.ZipFile(io.BytesIO(content)).infolist() if not i.is_dir()]
    return [(name, size, size) for name, size, _ in members(content, kind)]


def read_leaf_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """archive, member, n, line: the physical lines of each archive's leaf, or of a compressed file; an archive without a leaf has none."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = leaf(content, pattern)
                if found:
                    lines = io.TextIOWrapper(io.BytesIO(found[1]), "utf-8-sig", "replace")
                    at = 0
                    while part := [x.rstrip("\n") for _, x in zip(range(10_000), lines, strict=False)]:
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array([found[0]] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part)], ["archive", "member", "n", "line"])
                        at += len(part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, n long, line string")


# Which members are leaves of a text format.
LEAVES = {"csv": ("*.csv", "*.tsv", "*.psv", "*.txt", "*.dat", "*"), "json": ("*.json", "*.jsonl", "*.ndjson", "*"), "fixed-width": ("*.dat", "*.txt", "*")}


def materialize(spark: SparkSession, path: str, fmt: str, pattern: str | None = None) -> str:
    """A folder of text with the lines of an archive's leaf; later stages read it like any text input.

    Without a pattern the first of the format's names that some member has is taken.
    """
    for wanted in [pattern] if pattern else LEAVES[fmt]:
        lines = read_leaf_lines(spark, path, wanted)
        if not lines.limit(1).isEmpty():
            out = scratch_path(spark, "leaf")
            lines.select("line").write.text(out)
            return out
    raise ValueError(f"{path} holds no {pattern or fmt} file")
