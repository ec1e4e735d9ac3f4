"""Fixed-width reconciliation: slices, last row of each id, typed cell comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.mapping import SOURCE, TARGET
from ..functions.structured import structured
from ..sources.readers import slice_lines
from .reconcile import EXTRA, MATCH, MISSING, VALUE, last_by_key


@dataclass(frozen=True)
class Slice:
    """A field with its place on either side (start inclusive, end exclusive)."""

    name: str
    source: tuple[int, int]
    target: tuple[int, int] | None = None
    type: str = "text"  # text, integer, float, date, structured
    source_date_format: str | None = None
    target_date_format: str | None = None
    source_regex: tuple[str, str] | None = None
    target_regex: tuple[str, str] | None = None
    sensitive: bool = False
    compare: bool = True
    order_sensitive: bool = False

    def place(self, side: str) -> tuple[int, int]:
        return self.source if side == SOURCE or self.target is None else self.target

    def value(self, c: Column, side: str) -> Column:
        pair = self.source_regex if side == SOURCE else self.target_regex
        return canon.transform(c, *pair) if pair else c

    def equal(self, a: Column, b: Column) -> Column:
        """Equality by type; numbers that do not parse are unequal."""
        if self.type == "integer":
            same = a.try_cast("decimal(38,0)") == b.try_cast("decimal(38,0)")
        elif self.type == "float":
            same = a.try_cast("double") == b.try_cast("double")
        elif self.type == "date":
            same = canon.same_day(a, b, self.source_date_format, self.target_date_format)
        elif self.type == "structured":
            same = structured(a, self.order_sensitive) == structured(b, self.order_sensitive)
        else:
            same = canon.strip(a) == canon.strip(b)
        return F.coalesce(same, F.lit(False))


def sliced(lines: DataFrame, layout: Sequence[Slice], side: str, line: str = "line") -> DataFrame:
    return slice_lines(lines, [(s.name, *s.place(side)) for s in layout], line)


def reconcile_fixed_width(source: DataFrame, target: DataFrame, layout: Sequence[Slice], uid: str | None = None, order: Column | None = None) -> DataFrame:
    """The long-form mismatch relation of two tables of lines.

    source, target: ``line`` and, if repeated ids matter, ``n``, the line's number: of repeated
    ids the last line counts. The id is the named field, else the first.
    """
    names = [s.name for s in layout]
    uid = uid if uid in names else names[0]
    fields = [s for s in layout if s.name != uid and s.compare]

    def side(lines: DataFrame, which: str) -> DataFrame:
        rows = lines.where(canon.strip(F.col("line")) != "")
        cut = lambda a, b: canon.strip(F.substring(F.col("line"), a + 1, b - a)) if b > a else F.lit("")
        n = F.col("n") if "n" in lines.columns else F.monotonically_increasing_id()
        rows = rows.select(*[cut(*s.place(which)).alias(s.name) for s in layout], n.alias("_n"))
        rows = last_by_key(rows, [rows[uid]], [rows["_n"]])
        return rows.select(F.col(uid).alias("uid"), F.struct(*names).alias(which))

    j = side(source, SOURCE).join(side(target, TARGET), "uid", "full_outer")
    cells = []
    for f in fields:
        a, b = f.value(F.col(f"source.{f.name}"), SOURCE), f.value(F.col(f"target.{f.name}"), TARGET)
        show = canon.mask_length if f.sensitive else (lambda c: c)
        cells.append(F.when(~f.equal(a, b), F.struct(F.lit(f.name).alias("column_name"), show(a).alias("source_value"), show(b).alias("target_value"))))
    status = F.when(F.col("target").isNull(), MISSING).when(F.col("source").isNull(), EXTRA).otherwise(VALUE)
    none = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("column_name", "source_value", "target_value")]))
    found = F.when(F.col("source").isNull() | F.col("target").isNull(), none).otherwise(F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column_name:string,source_value:string,target_value:string>>"))
    record = lambda c: F.transform_values(F.create_map(*[x for s in layout for x in (F.lit(s.name), (canon.mask_length if s.sensitive else (lambda v: v))(F.col(f"{c}.{s.name}")))]), lambda k, v: v)
    detail = F.to_json(F.struct(F.when(F.col("source").isNotNull(), record("source")).alias("source_record"), F.when(F.col("target").isNotNull(), record("target")).alias("target_record")))
    return j.select("uid", status.alias("mismatch_type"), F.explode(found).alias("c"), detail.alias("row_detail")).select("uid", "mismatch_type", "c.column_name", "c.source_value", "c.target_value", "row_detail")


def line_by_line(source: DataFrame, target: DataFrame, source_date: tuple[int, int, str], target_date: tuple[int, int, str]) -> DataFrame:
    """Lines paired by number ``n``: which side ends early, whose date slice does not parse, whose days differ.

    source, target: n, line. Dates are (start, end, format).
    """
    pair = source.select("n", F.col("line").alias("s")).join(target.select("n", F.col("line").alias("t")), "n", "full_outer")
    cut = lambda c, d: canon.strip(F.substring(F.col(c), d[0] + 1, d[1] - d[0]))
    day = lambda c, d: F.try_to_date(cut(c, d), canon.java_format(d[2]))
    a, b = day("s", source_date), day("t", target_date)
    problem = F.when(F.col("t").isNull(), MISSING).when(F.col("s").isNull(), EXTRA).when(a.isNull() | b.isNull(), "parse_error").when(a != b, VALUE)
    return pair.select("n", problem.alias("problem"), cut("s", source_date).alias("source_value"), cut("t", target_date).alias("target_value")).where("problem IS NOT NULL")


def split_name_check(source: DataFrame, target: DataFrame, full: str, parts: Sequence[str]) -> DataFrame:
    """Rows, paired by number ``n``, whose full value is not its parts joined by a space; a side that ends early is null."""
    joined = F.concat_ws(" ", *[F.col(p) for p in parts])
    pair = source.select("n", F.col(full).alias("source_value")).join(target.select("n", joined.alias("target_value")), "n", "full_outer")
    return pair.where(~F.col("source_value").eqNullSafe(F.col("target_value")))


def status_of(mismatches: DataFrame) -> DataFrame:
    """missing, extra, changed cells and changed ids of a long-form relation."""
    kind = F.col("mismatch_type")
    return mismatches.agg(F.count_if(kind == MISSING).alias(MISSING), F.count_if(kind == EXTRA).alias(EXTRA), F.count_if(kind == VALUE).alias("value_mismatch_cells"), F.count_distinct(F.when(kind == VALUE, F.col("uid"))).alias("value_mismatch_rows"))


__all__ = ["MATCH", "Slice", "line_by_line", "reconcile_fixed_width", "sliced", "split_name_check", "status_of"]
