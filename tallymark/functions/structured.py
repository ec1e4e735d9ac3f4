"""Canonical signatures of cells that hold list, dict or tuple literals.

JSON is tried first, then Python's literal syntax. Neither nested sorting nor Python's syntax
has a built-in expression, so this is an Arrow-batched UDF; it is only put on columns that a
rule or the complex-column scan names, and cells that do not start with a bracket never parse.
"""

from __future__ import annotations

import ast
import json
import re
from datetime import date, datetime
from json.encoder import encode_basestring
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import NULL, NULL_TOKENS

# The date formats, in strptime's letters.
STRPTIME_FORMATS = (
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d-%b-%Y", "%d-%B-%Y",
    "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y", "%d.%m.%Y", "%Y/%m/%d",
)

#: Each of the formats has two separators: what lacks them is no date, and is not tried by all of them.
_SEPARATED = re.compile(r"[-/.\s].*[-/.\s]", re.DOTALL)


def parse_literal(value: Any) -> Any:
    """A container if the text is a literal of one; else the value itself."""
    if not isinstance(value, str) or not (t := value.strip()) or t[0] not in "[{(":
        return value
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(t)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
    return value


def dates_of(text: str) -> list[date]:
    out = []
    if 8 <= len(text) <= 20 and _SEPARATED.search(text) and any(c.isdigit() for c in text):
        for f in STRPTIME_FORMATS:
            try:
                out.append(datetime.strptime(text, f).date())
            except ValueError:
                continue
    return out


def signature(value: Any, ordered: bool = False) -> str:
    """Equal for values that mean the same: nested literals, dates, null tokens; order only counts if ``ordered``."""
    if type(value) is int:
        return f'"{value}"'
    v = parse_literal(value)
    if isinstance(v, dict):
        items = [(json.dumps(str(k)), signature(x, ordered)) for k, x in v.items()]
        return "{" + ",".join(f"{k}:{x}" for k, x in (items if ordered else sorted(items))) + "}"
    if isinstance(v, list | tuple):
        items = [signature(x, ordered) for x in v]
        return "[" + ",".join(items if ordered else sorted(items)) + "]"
    t = "" if v is None else str(v).strip()
    if t.lower() in NULL_TOKENS:
        return NULL
    found = dates_of(t)
    return min(found).isoformat() if found else encode_basestring(t)


def structured(c: Column, ordered: bool = False) -> Column:
    @F.pandas_udf("string")
    def sign(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: signature(x, ordered))

    return F.coalesce(sign(c.cast("string")), F.lit(NULL))


def looks_structured(c: Column) -> Column:
    """Whether a cell parses as a container literal."""

    @F.pandas_udf("boolean")
    def test(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: isinstance(parse_literal(x), dict | list | tuple)).astype(bool)

    return F.trim(c).rlike(r"^[\[{(]") & test(c)
