"""Row constraints of delimited inputs: required values, lengths, patterns and types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon


@dataclass(frozen=True)
class Constraint:
    column: str
    type: str = "string"  # string, integer, float, date
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    date_format: str = "YYYY-MM-DD"

    def message(self, c: Column) -> Column:
        """The first broken rule, or null. A blank value breaks nothing but ``required``."""
        v, t, n = F.coalesce(c.cast("string"), F.lit("")), canon.strip(F.coalesce(c.cast("string"), F.lit(""))), F.length(c.cast("string"))
        out = F.when(t == "", F.lit("value is required") if self.required else F.lit(None).cast("string"))
        if self.min_length is not None:
            out = out.when(n < self.min_length, F.concat(F.lit("length "), n.cast("string"), F.lit(f" is below {self.min_length}")))
        if self.max_length is not None:
            out = out.when(n > self.max_length, F.concat(F.lit("length "), n.cast("string"), F.lit(f" is above {self.max_length}")))
        if self.pattern is not None:
            out = out.when(~v.rlike(f"^(?:{self.pattern})$"), F.lit("pattern does not match"))
        if self.type == "integer":
            out = out.when(t.try_cast("decimal(38,0)").isNull() | ~t.rlike(r"^[+-]?\d+$"), F.lit("not an integer"))
        elif self.type == "float":
            out = out.when(t.try_cast("double").isNull(), F.lit("not a number"))
        elif self.type == "date":
            out = out.when(F.try_to_date(t, canon.java_format(self.date_format)).isNull(), F.lit("not a date"))
        return out


def check(df: DataFrame, constraints: Sequence[Constraint], row: str) -> DataFrame:
    """row, column, value, message of every broken rule; ``row`` is the column that identifies a row."""
    known = [c for c in constraints if c.column in df.columns]
    cells = [F.struct(F.lit(c.column).alias("column"), df[c.column].cast("string").alias("value"), c.message(df[c.column]).alias("message")) for c in known]
    bad = F.filter(F.array(*cells), lambda x: x["message"].isNotNull())
    return df.select(F.col(row).alias("row"), F.explode(bad).alias("e")).select("row", "e.*")
