"""Reconciliation of two datasets on a key, in one full-outer join.

Both sides are cut down to key parts, canonical values of the compared fields and, only when
a report needs it, the raw record; then one shuffle per side classifies every key as
matching, changed, missing or extra. Cells travel with the join, so nothing is looked up again.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import canon, identity
from ..functions.mapping import SOURCE, TARGET, Field, resolve_fields
from ..sources.scratch import save

MISSING, EXTRA, VALUE, MATCH = "missing_in_target", "extra_in_target", "value_mismatch", "value_match"
MISMATCH_COLUMNS = ("uid", "mismatch_type", "column_name", "source_value", "target_value", "row_detail")


def last_by_key(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one candidate a key and task."""
    row = F.struct(*[df[c] for c in df.columns])
    last = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return last.select("_row.*")


def _canonical(rule: Field):
    """A change with both values in a rule's canonical form."""
    return lambda c: F.struct(c["field"].alias("field"), rule.cell(c["source_value"], SOURCE).alias("source_value"), rule.cell(c["target_value"], TARGET).alias("target_value"))


@dataclass
class Reconciliation:
    """A source and a target, their key columns and compared fields.

    ``on_duplicate``: ``cross`` pairs repeated keys m by n, ``last`` keeps each key's last row by
    ``order``, ``pair`` pairs the first with the first and so on by ``order``, so rows do not multiply,
    and ``error`` raises. Without an ``order`` it is that of all columns. Keys are compared in canonical form,
    so null keys meet null keys. ``how``: ``right_outer`` leaves out what the target lacks.
    """

    source: DataFrame
    target: DataFrame
    keys: Sequence[str]
    fields: list[Field] = field(default_factory=list)
    target_keys: Sequence[str] | None = None
    on_duplicate: str = "cross"
    order: Sequence[str] = ()
    how: str = "full_outer"

    def __post_init__(self) -> None:
        self.keys = tuple(self.keys)
        self.target_keys = tuple(self.target_keys or self.keys)
        if not self.keys:
            raise ValueError("no key columns")
        for side, df, keys in ((SOURCE, self.source, self.keys), (TARGET, self.target, self.target_keys)):
            lacking = [c for c in (*keys, *(c for f in self.fields for c in f.columns(side))) if c not in df.columns]
            if lacking:
                raise ValueError(f"{side} has no column {', '.join(lacking)}")
        if not self.fields:
            self.fields = resolve_fields(None, self.keys, [c for c in self.source.columns if c in self.target.columns])
        if self.on_duplicate not in ("cross", "last", "pair", "error"):
            raise ValueError(f"on_duplicate: {self.on_duplicate}")

    # -- the join ------------------------------------------------------------

    def _side(self, df: DataFrame, keys: Sequence[str], side: str, raw: bool) -> DataFrame:
        """Key parts and cells of a side. What repeated keys need is grouped by these parts, so the join finds the rows dealt as it wants them."""
        parts = [p.alias(f"_k{i}") for i, p in enumerate(identity.key_parts(df, keys))]
        names = [f"_k{i}" for i in range(len(parts))]
        if self.on_duplicate == "error" and not df.groupBy(*parts).count().where("count > 1").isEmpty():
            raise ValueError(f"{side} has repeated keys")
        t = side[0]
        cells = [(df[f.columns(side)[0]].cast("string") if self._alike(f) else f.value(df, side)).alias(f"_{t}{i}") for i, f in enumerate(self.fields)]
        if raw:
            cells.append(self._record(df, keys, side).alias(f"_{side}_record"))
        order = [df[c] for c in (self.order or df.columns)]
        if self.on_duplicate == "last" and cells:
            rows = df.select(*parts, F.struct(*cells).alias("_cells"), F.struct(*order).alias("_order"))
            df = rows.groupBy(*names).agg(F.max_by("_cells", "_order").alias("_cells")).select(*names, "_cells.*")
        elif self.on_duplicate == "last":
            df = df.select(*parts).distinct()
        elif self.on_duplicate == "pair":
            nth = F.row_number().over(Window.partitionBy(*names).orderBy("_order"))
            df = df.select(*parts, *cells, F.struct(*order).alias("_order")).withColumn("_nth", nth).drop("_order")
        else:
            df = df.select(*parts, *cells)
        return df.withColumn(f"_in_{side}", F.lit(True))

    def _record(self, df: DataFrame, keys: Sequence[str], side: str) -> Column:
        """The raw record as text cells; sensitive ones are masked here too."""
        hidden = {c for f in self.fields if f.sensitive for c in f.columns(side)}
        wanted = dict.fromkeys([*keys, *(c for f in self.fields for c in f.columns(side))])
        cell = lambda c: canon.mask(df[c].cast("string")) if c in hidden else df[c].cast("string")
        return F.struct(*[cell(c).alias(c) for c in wanted])

    def joined(self, raw: bool = False) -> DataFrame:
        """Key parts, both sides' cells, ``uid``, ``changes`` (canonical cells that differ) and ``status``."""
        s = self._side(self.source, self.keys, SOURCE, raw)
        t = self._side(self.target, self.target_keys, TARGET, raw)
        parts = [f"_k{i}" for i in range(len(self.keys))]
        on = [*parts, "_nth"] if self.on_duplicate == "pair" else parts
        j = s.join(t, on, self.how).withColumn("changes", self._changes())
        status = F.when(F.col("_in_target").isNull(), F.lit(MISSING)).when(F.col("_in_source").isNull(), F.lit(EXTRA)).when(F.size("changes") > 0, F.lit(VALUE)).otherwise(F.lit(MATCH))
        return j.withColumn("uid", identity.uid([F.col(p) for p in parts])).withColumn("status", status)

    @staticmethod
    def _alike(f: Field) -> bool:
        """Whether equal raw cells are equal canonical ones: then raw cells travel, and only those that differ are made canonical."""
        return len(f.source_columns) == len(f.target_columns) == 1 and f.source == f.target and f.mode != "structured"

    def _changes(self) -> Column:
        """Cells of a pair that differ: number of the field, canonical source and target value.

        Comparing raw cells is generated code; the canonical form of those that differ is written once for all
        fields of a rule, inside a lambda, so that a wide table's plan stays small.
        """
        groups: dict[Field | None, list[int]] = {}
        for i, f in enumerate(self.fields):
            rule = replace(f, key="", source_columns=(), target_columns=(), sensitive=False) if self._alike(f) else None
            groups.setdefault(rule, []).append(i)
        found = []
        for rule, numbers in groups.items():
            pair = lambda i: F.struct(F.lit(i).alias("field"), F.col(f"_s{i}").alias("source_value"), F.col(f"_t{i}").alias("target_value"))
            unlike = F.array_compact(F.array(*[F.when(~F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}")), pair(i)) for i in numbers]))
            if rule is not None:
                unlike = F.filter(F.transform(unlike, _canonical(rule)), lambda c: c["source_value"] != c["target_value"])
            found.append(unlike)
        none = F.array().cast("array<struct<field:int,source_value:string,target_value:string>>")
        every = none if not found else found[0] if len(found) == 1 else F.concat(*found)
        raw_differ = reduce(lambda a, b: a | b, [~F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}")) for i in range(len(self.fields))], F.lit(False))
        return F.when(F.col("_in_source") & F.col("_in_target") & raw_differ, every).otherwise(none)

    @cached_property
    def _joined(self) -> DataFrame:
        return self.joined()

    # -- results -------------------------------------------------------------

    def status_counts(self) -> DataFrame:
        """One row: matching, changed, missing, extra."""
        j = self._joined
        count = lambda s: F.count_if(F.col("status") == s)
        return j.agg(count(MATCH).alias("matching"), count(VALUE).alias("changed"), count(MISSING).alias("missing"), count(EXTRA).alias("extra"))

    def missing(self) -> DataFrame:
        """uid of source records whose key the target lacks: an anti-join, the target is cut to its key."""
        return self._only(self.source, self.keys, self.target, self.target_keys)

    def extra(self) -> DataFrame:
        return self._only(self.target, self.target_keys, self.source, self.keys)

    def _only(self, a: DataFrame, a_keys: Sequence[str], b: DataFrame, b_keys: Sequence[str]) -> DataFrame:
        names = [f"_k{i}" for i in range(len(self.keys))]
        left = a.select(*[p.alias(n) for p, n in zip(identity.key_parts(a, a_keys), names, strict=True)])
        right = b.select(*[p.alias(n) for p, n in zip(identity.key_parts(b, b_keys), names, strict=True)])
        return left.join(right, names, "left_anti").select(identity.uid([F.col(n) for n in names]).alias("uid"))

    def _named(self, rows: DataFrame, change: str) -> tuple[Column, Column, Column]:
        """Column name and shown values of a change, null without one; sensitive values are masked."""
        at = rows[change]["field"]
        pick = lambda values: F.when(rows[change].isNotNull(), F.get(F.array(*[F.lit(v) for v in values]), at))
        hidden = pick([f.sensitive for f in self.fields])
        masks = any(f.sensitive for f in self.fields)
        shown = lambda c: F.when(hidden, canon.mask(rows[change][c])).otherwise(rows[change][c]) if masks else rows[change][c]
        return pick([f.key for f in self.fields]).alias("column_name"), shown("source_value").alias("source_value"), shown("target_value").alias("target_value")

    def changed_cells(self) -> DataFrame:
        """uid, column_name, source_value, target_value of every cell that differs, canonical, sensitive ones masked."""
        rows = self._joined.where(F.col("status") == VALUE).select("uid", F.explode("changes").alias("c"))
        return rows.select("uid", *self._named(rows, "c"))

    def mismatches(self, details: bool = True, counts: Observation | None = None) -> DataFrame:
        """The long-form relation: a row for each missing and extra record and each changed cell.

        ``row_detail`` is JSON with the raw records. The join is made once: presence rows get one cell without a column,
        and ``counts`` observes the summary on its way.
        """
        j = self.joined(raw=details)
        j = (j.observe(counts, *self._summary()) if counts is not None else j).where(F.col("status") != MATCH)
        # a row without changes is kept by the outer explode
        rows = j.withColumn("c", F.explode_outer("changes"))
        detail = F.to_json(F.struct("uid", F.col("_source_record").alias("source_record"), F.col("_target_record").alias("target_record"))) if details else F.lit(None).cast("string")
        return rows.select("uid", F.col("status").alias("mismatch_type"), *self._named(rows, "c"), detail.alias("row_detail"))

    def presence_detail(self, side: str = SOURCE) -> DataFrame:
        """uid and raw record columns of the missing (source) or extra (target) records."""
        j = self.joined(raw=True).where(F.col("status") == (MISSING if side == SOURCE else EXTRA))
        return j.select("uid", f"_{side}_record.*")

    def match_samples(self, per_column: int = 10) -> DataFrame:
        """Up to ``per_column`` agreeing cells of each field, by uid; none if anything differs."""
        same = self._joined.where(F.col("status") == MATCH)
        if not self._joined.where(F.col("status") != MATCH).isEmpty():
            same = same.limit(0)
        value = lambda i, f: f.cell(F.col(f"_s{i}"), SOURCE) if self._alike(f) else F.col(f"_s{i}")
        cells = F.array(*[F.struct(F.lit(f.key).alias("column_name"), (canon.mask(value(i, f)) if f.sensitive else value(i, f)).alias("v")) for i, f in enumerate(self.fields)])
        rows = same.select("uid", F.explode(cells).alias("c"))
        n = F.row_number().over(Window.partitionBy("c.column_name").orderBy("uid", "c.v"))
        rows = rows.withColumn("n", n).where(F.col("n") <= per_column)
        return rows.select("uid", F.lit(MATCH).alias("mismatch_type"), "c.column_name", F.col("c.v").alias("source_value"), F.col("c.v").alias("target_value"))

    @staticmethod
    def _summary() -> list[Column]:
        changed = F.col("status") == VALUE
        count = lambda s: F.count_if(F.col("status") == s)
        cells = F.coalesce(F.sum(F.when(changed, F.size("changes"))), F.lit(0)).cast("long")
        return [count(MISSING).alias(MISSING), count(EXTRA).alias(EXTRA), cells.alias("value_mismatch_cells"), F.count_if(changed).alias("value_mismatch_rows")]

    def summary(self) -> DataFrame:
        """One row: missing, extra, changed cells and changed rows."""
        return self._joined.agg(*self._summary())

    def partition_stats(self, partitions: int = 16, algorithm: str = "md5") -> DataFrame:
        """For each partition of keys its source, target, missing, extra and changed records."""
        pid = identity.partition_id(F.col("uid"), partitions, algorithm)
        has = lambda c: F.count_if(F.col(c).isNotNull())
        count = lambda s: F.count_if(F.col("status") == s)
        return self._joined.groupBy(pid.alias("partition_id")).agg(
            has("_in_source").alias("source_rows"), has("_in_target").alias("target_rows"), count(MISSING).alias("missing"), count(EXTRA).alias("extra"), count(VALUE).alias("changed"))

    def mismatched_partitions(self, partitions: int = 16, algorithm: str = "md5") -> DataFrame:
        return self.partition_stats(partitions, algorithm).agg(F.count_if(F.col("missing") + F.col("extra") + F.col("changed") > 0).alias("mismatched_partitions"), F.count(F.lit(1)).alias("partitions"))


def multiset_difference(source: DataFrame, target: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Records without a key: how often each distinct record is too rare or too frequent in the target.

    Both sides are counted before they meet, so copies are folded before the shuffle.
    """
    columns = list(columns)
    both = source.select(*columns, F.lit(1).alias("_n")).unionByName(target.select(*columns, F.lit(-1).alias("_n")))
    counts = both.groupBy(*columns).agg(F.count_if(F.col("_n") > 0).alias("source_count"), F.count_if(F.col("_n") < 0).alias("target_count"))
    return counts.where("source_count <> target_count").withColumn("mismatch_type", F.when(F.col("source_count") > F.col("target_count"), F.lit(MISSING)).otherwise(F.lit(EXTRA)))


def positional(source: DataFrame, target: DataFrame, fields: list[Field], order: Sequence[str], target_order: Sequence[str] | None = None) -> DataFrame:
    """Rows aligned by their number in the given order; rows beyond the shorter side are missing or extra."""
    s, t = numbered(source, order), numbered(target, target_order or order)
    return Reconciliation(s, t, ["_row"], fields).mismatches(details=False)


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_row`` from 0 in total order: range-sorted, each range's first number from a table with a row a range."""
    s = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    s = s.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    n = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    n = F.broadcast(n.select("_part", before.alias("_before")))  # as many rows as ranges
    return s.join(n, "_part").withColumn("_row", F.col("_before") + F.col("_in")).drop("_at", "_part", "_in", "_before")
