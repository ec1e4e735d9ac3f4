"""Differences of JSON documents and of JSON lines, by path.

Documents with a key are joined first (a full-outer join of the raw texts); pairs whose texts
are equal, or equal as variants, never reach Python. The recursive comparison of the others
has no built-in expression and runs Arrow-batched; a worker holds one pair, and rows of a bounded size.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from json.encoder import encode_basestring as quoted

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import NULL
from ..functions.structured import signature
from .reconcile import EXTRA, MISMATCH_COLUMNS, MISSING, VALUE, last_by_key

DOCUMENT = "document"
SCHEMA = ", ".join(f"{c} string" for c in MISMATCH_COLUMNS)
#: Characters of the rows that leave a worker at once, besides the last row.
BATCH = 1 << 22


def _joined(path: Sequence[str | int]) -> str:
    return "".join([f"[{p}]" if isinstance(p, int) else f".{p}" for p in path])


def path_text(path: Sequence[str | int]) -> str:
    return _joined(path).removeprefix(".") or "$"


class Absent:
    """The value that a side does not have."""


def leaf_text(v: object) -> str | None:
    """Containers as JSON with sorted keys; a null has a name, and what is not there is None."""
    if v is Absent:
        return None
    if v is None:
        return NULL
    return json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, dict | list) else str(v)


def _inside(path: list, keys: Iterable[str | int], s: dict | list, t: dict | list) -> Iterator[tuple]:
    for k in keys:
        yield [*path, k], s[k], t[k], s, t


def differences(source: object, target: object, ordered: bool) -> Iterator[tuple[list, str, object, object, object, object]]:
    """(path, kind, source value, target value, source parent, target parent), depth first; ``Absent`` is the value of a side without one."""
    todo: list[Iterator[tuple]] = [iter([([], source, target, None, None)])]
    while todo:
        if (pair := next(todo[-1], None)) is None:
            todo.pop()
            continue
        path, s, t, sp, tp = pair
        if isinstance(s, dict) and isinstance(t, dict):
            names = [*s, *(k for k in t if k not in s)]
            both = []
            for k in names if ordered else sorted(names, key=str):
                if k in s and k in t:
                    both.append(k)
                else:
                    yield [*path, k], MISSING if k in s else EXTRA, s.get(k, Absent), t.get(k, Absent), s, t
            todo.append(_inside(path, both, s, t))
        elif isinstance(s, list) and isinstance(t, list) and ordered:
            both = range(min(len(s), len(t)))
            for i in range(len(both), max(len(s), len(t))):
                yield [*path, i], MISSING if i < len(s) else EXTRA, s[i] if i < len(s) else Absent, t[i] if i < len(t) else Absent, s, t
            todo.append(_inside(path, both, s, t))
        elif isinstance(s, list) and isinstance(t, list):
            # elements of one signature are interchangeable: they are paired off in order, the rest has no partner
            signs = [signature(x) for x in t]
            free = Counter(signs)
            for i, x in enumerate(s):
                if free[sign := signature(x)]:
                    free[sign] -= 1
                else:
                    yield [*path, i], MISSING, x, Absent, s, t
            extra = []
            for i in reversed(range(len(t))):
                if free[signs[i]]:
                    free[signs[i]] -= 1
                    extra.append(i)
            for i in reversed(extra):
                yield [*path, i], EXTRA, Absent, t[i], s, t
        elif signature(s, ordered) != signature(t, ordered):
            yield path, VALUE, s, t, sp, tp


def diff_rows(uid: str, source: str, target: str, ordered: bool, mapping: Sequence[tuple[str, str]] = (), details: bool = True) -> Iterator[tuple]:
    """Mismatch rows of one pair of JSON texts; ``mapping`` keeps and renames mapped top-level keys.

    ``row_detail`` names the paths and, with ``details``, holds the parent on both sides: a list of n changed elements gives n copies of it.
    """
    s, t = json.loads(source), json.loads(target)
    if mapping and isinstance(s, dict) and isinstance(t, dict):
        s = {b: s[a] for a, b in mapping if a in s}
        t = {b: t[b] for _, b in mapping if b in t}
    last: dict[str, tuple] = {}
    above = stem = parent_path = None
    for path, kind, a, b, sp, tp in differences(s, t, ordered):
        if (outer := path[:-1]) != above:
            above, stem, parent_path = outer, _joined(outer), path_text(outer)
        at = (stem + _joined(path[-1:])).removeprefix(".") or "$"
        detail = f'{{"json_path": {quoted(at)}, "parent_path": {quoted(parent_path)}, "mismatch_type": "{kind}"}}'
        if details:
            for side, parent in (("source", sp), ("target", tp)):
                if parent is not None:
                    # elements of one list follow each other: their parent becomes text once
                    if side not in last or last[side][0] is not parent:
                        keys = list(parent) if isinstance(parent, dict) else list(range(len(parent)))
                        last[side] = parent, json.dumps({f"{side}_parent": parent, f"{side}_sibling_keys": keys}, ensure_ascii=False)[1:]
                    detail = f"{detail[:-1]}, {last[side][1]}"
        yield uid, kind, at, leaf_text(a), leaf_text(b), detail


def diff_json(pairs: DataFrame, ordered: bool = False, mapping: Sequence[tuple[str, str]] = (), details: bool = True) -> DataFrame:
    """pairs: uid, source, target (JSON texts, both there). The long-form relation; without ``details``, ``row_detail`` has no parents."""
    mapping = list(mapping)
    unlike = pairs.where((F.col("source") != F.col("target")) & (F.coalesce(F.to_json(F.try_parse_json("source")) != F.to_json(F.try_parse_json("target")), F.lit(True)) | F.lit(ordered)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], list(MISMATCH_COLUMNS))
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                u, s, t = (batch.column(c)[i].as_py() for c in ("uid", "source", "target"))
                for row in diff_rows(u, s, t, ordered, mapping, details):
                    out.append(row)
                    size += sum(len(x) for x in row if x)
                    if size >= BATCH:
                        yield made(out)
                        out, size = [], 0
            if out:
                yield made(out)

    return unlike.select("uid", "source", "target").mapInArrow(run, SCHEMA)


def diff_json_lines(source: DataFrame, target: DataFrame, uid: str, ordered: bool = False, mapping: Sequence[tuple[str, str]] = (), number: str | None = None) -> DataFrame:
    """source, target: ``json``, one object a row. Joined by a top-level key, the last of repeated ids (by ``number``, else input order).

    A record without the key, with a null key, or that is no JSON object, makes the result fail and names itself: nothing is folded or dropped.
    Input order is that of one file's splits; records of several files need a ``number``.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        # numbered first: in a branch, the number would count only the rows that come to it
        df = df.select("json", (F.col(number) if number else F.monotonically_increasing_id()).alias("_n"))
        at = F.concat(F.lit(f"{name} record "), (F.col("_n") if number else F.col("_n") + 1).cast("string"))
        key = F.get_json_object("json", f"$['{uid}']")
        broken = F.raise_error(F.concat(at, F.lit(" is not a JSON object: "), F.substring("json", 1, 80)))
        lacking = F.raise_error(F.concat(at, F.lit(f" has no {uid}: "), F.substring("json", 1, 80)))
        key = F.when(key.isNotNull(), key).when(F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False)), lacking).otherwise(broken)
        rows = df.select(key.alias("uid"), F.col("json").alias(name), "_n")
        return last_by_key(rows, [rows["uid"]], [rows["_n"]]).select("uid", name)

    j = side(source, "source").join(side(target, "target"), "uid", "full_outer")
    alone = j.where("source IS NULL OR target IS NULL")
    detail = F.to_json(F.struct(F.parse_json("source").alias("source_record"), F.parse_json("target").alias("target_record")))
    presence = alone.select("uid", F.when(F.col("target").isNull(), MISSING).otherwise(EXTRA).alias("mismatch_type"), *[F.lit(None).cast("string").alias(c) for c in MISMATCH_COLUMNS[2:5]], detail.alias("row_detail"))
    return presence.unionByName(diff_json(j.where("source IS NOT NULL AND target IS NOT NULL"), ordered, mapping))


def diff_documents(source: DataFrame, target: DataFrame, ordered: bool = False, mapping: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Two tables of one ``json`` document each."""
    one = lambda df, name: df.limit(1).select(F.lit(DOCUMENT).alias("uid"), F.col("json").alias(name))
    return diff_json(one(source, "source").join(one(target, "target"), "uid"), ordered, mapping)


def top_level_keys(rows: DataFrame, json_column: str = "json") -> DataFrame:
    """key, type, n: the top-level keys of objects with a coarse type."""
    v = rows.select(F.parse_json(json_column).alias("v"))
    each = v.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    coarse = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").otherwise("number")
    return each.where("key IS NOT NULL").groupBy(F.col("key"), coarse.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def suggest_parents(source: DataFrame, target: DataFrame) -> DataFrame:
    """source_key, target_key: same names are paired, others stand alone."""
    s = source.select(F.col("key").alias("source_key")).distinct()
    t = target.select(F.col("key").alias("target_key")).distinct()
    return s.join(t, s.source_key == t.target_key, "full_outer")
