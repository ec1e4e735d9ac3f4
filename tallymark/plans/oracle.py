"""DuckDB SQL for reconciliations, written apart from the engine: plain joins over canonical cells."""

from __future__ import annotations

from collections.abc import Sequence

from .inputs import SQL, expand


def canon(c: str) -> str:
    t = f"trim(CAST({c} AS STRING))"
    return f"CASE WHEN {c} IS NULL OR lower({t}) IN ('', 'null', 'none', 'na', 'n/a') THEN '__NULL__' ELSE {t} END"


def side(name: str) -> str:
    return expand(SQL[name])


def joined(source: str, target: str, keys: Sequence[str], cells: Sequence[tuple[str, str, str]]) -> str:
    """CTEs ending in j(uid, status, s0, t0, ...); cells: name, source expression, target expression, already canonical."""
    k = ", ".join(f"{canon(c)} AS k{i}" for i, c in enumerate(keys))
    s = ", ".join(f"{a} AS s{i}" for i, (_, a, _) in enumerate(cells)) or "0 AS s_"
    t = ", ".join(f"{b} AS t{i}" for i, (_, _, b) in enumerate(cells)) or "0 AS t_"
    on = " AND ".join(f"s.k{i} = t.k{i}" for i in range(len(keys)))
    uid = " || '|' || ".join(f"coalesce(s.k{i}, t.k{i})" for i in range(len(keys)))
    differ = " OR ".join(f"s{i} <> t{i}" for i in range(len(cells))) or "false"
    return f"""s AS (SELECT {k}, {s} FROM ({side(source)}) AS x), t AS (SELECT {k}, {t} FROM ({side(target)}) AS x),
        j AS (SELECT {uid} AS uid, s.*, t.*, s.k0 IS NOT NULL AS in_s, t.k0 IS NOT NULL AS in_t,
              CASE WHEN t.k0 IS NULL THEN 'missing_in_target' WHEN s.k0 IS NULL THEN 'extra_in_target' WHEN {differ} THEN 'value_mismatch' ELSE 'value_match' END AS status
              FROM s FULL OUTER JOIN t ON {on})"""


def same(names: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(n, canon(n), canon(n)) for n in names]


COUNTS = """SELECT count(*) FILTER (WHERE status = 'value_match') AS matching, count(*) FILTER (WHERE status = 'value_mismatch') AS changed,
    count(*) FILTER (WHERE status = 'missing_in_target') AS missing, count(*) FILTER (WHERE status = 'extra_in_target') AS extra FROM j"""


def changed(cells: Sequence[tuple[str, str, str]]) -> str:
    """c(uid, column_name, source_value, target_value)."""
    rows = " UNION ALL ".join(f"SELECT uid, '{n}' AS column_name, s{i} AS source_value, t{i} AS target_value FROM j WHERE status = 'value_mismatch' AND s{i} <> t{i}" for i, (n, _, _) in enumerate(cells))
    return f"c AS ({rows})"


def mismatches(source: str, target: str, keys: Sequence[str], cells: Sequence[tuple[str, str, str]]) -> str:
    """CTEs ending in m(uid, mismatch_type, column_name, source_value, target_value)."""
    return f"""{joined(source, target, keys, cells)}, {changed(cells)},
        m AS (SELECT uid, status AS mismatch_type, CAST(NULL AS STRING) AS column_name, CAST(NULL AS STRING) AS source_value, CAST(NULL AS STRING) AS target_value
              FROM j WHERE status IN ('missing_in_target', 'extra_in_target')
              UNION ALL SELECT uid, 'value_mismatch', column_name, source_value, target_value FROM c)"""
