"""Inputs of the catalogue's queries: pairs of sides derived from the tables by SQL that Spark and DuckDB both run.

Targets are deterministic perturbations: keys by modulus are dropped, added and changed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {}


def _define(name: str, sql: str) -> None:
    """``{other}`` in ``sql`` is a table or another input."""
    SQL[name] = " ".join(sql.split())


def expand(text: str) -> str:
    """SQL with inputs as subqueries and tables by name."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({expand(SQL[m[1]])})" if m[1] in SQL else m[1], text)


def tables_of(text: str) -> set[str]:
    return {t for n in re.findall(r"\{(\w+)\}", text) for t in (tables_of(SQL[n]) if n in SQL else {n})}


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an input's SQL over the Parquet tables; only the columns it uses are read."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)}
    inlined = re.sub(r"\{(\w+)\}", lambda m: f"({_inline(SQL[m[1]])})" if m[1] in SQL else m[0], text)
    return spark.sql(inlined, **used) if used else spark.sql(inlined)


def _inline(text: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"({_inline(SQL[m[1]])})" if m[1] in SQL else m[0], text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, SQL[name])


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)"


def _dmy(c: str, sep: str) -> str:
    part = lambda f, n: f"lpad(CAST({f}({c}) AS STRING), {n}, '0')"
    return f"{part('day', 2)} || '{sep}' || {part('month', 2)} || '{sep}' || {part('year', 4)}"


def _mdy(c: str) -> str:
    return f"CAST(month({c}) AS STRING) || '/' || CAST(day({c}) AS STRING) || '/' || CAST(year({c}) AS STRING)"


_define("orders_s", f"SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS n, o_orderstatus AS status, {_money('o_totalprice')} AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS odate, o_orderpriority AS priority FROM {{orders}}")
_define("orders_t", """
    SELECT id, n, CASE WHEN n % 7 = 0 THEN 'X' ELSE status END AS status, CASE WHEN n % 11 = 0 THEN price || '9' ELSE price END AS price, odate,
           CASE WHEN n % 13 = 0 THEN '  ' || priority || ' ' ELSE priority END AS priority FROM {orders_s} AS s WHERE n % 97 <> 0
    UNION ALL SELECT CAST(n + 100000000 AS STRING), n + 100000000, status, price, odate, priority FROM {orders_s} AS s WHERE n % 89 = 0""")
_define("orders_dates_s", "SELECT CAST(o_orderkey AS STRING) AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS odate FROM {orders}")
_define("orders_dates_t", f"SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 5 = 0 THEN {_dmy('o_orderdate', '.')} WHEN o_orderkey % 50 = 1 THEN {_mdy("(o_orderdate + INTERVAL '1' DAY)")} ELSE {_mdy('o_orderdate')} END AS odate FROM {{orders}}")
_define("customer_s", f"SELECT CAST(c_custkey AS STRING) AS id, c_custkey AS n, c_name AS name, {_money('c_acctbal')} AS balance, c_mktsegment AS segment FROM {{customer}}")
_define("customer_t", """
    SELECT id, n, CASE WHEN n % 10 = 0 THEN name || '!' ELSE name END AS name, balance, CASE WHEN n % 15 = 0 THEN lower(segment) ELSE segment END AS segment FROM {customer_s} AS s WHERE n % 50 <> 0
    UNION ALL SELECT CAST(n + 10000000 AS STRING), n + 10000000, name, balance, segment FROM {customer_s} AS s WHERE n % 40 = 0""")
_define("customer_renamed", "SELECT id, name AS full_name, segment AS market FROM {customer_t} AS t")
_define("customer_parts_s", "SELECT id, 'cust' AS first_part, substr(name, 10) AS last_part FROM {customer_s} AS s")
_define("customer_parts_t", "SELECT id, 'cust ' || substr(name, 10) AS full_name FROM {customer_t} AS t")
_define("customer_twice_t", "SELECT id, segment AS a, CASE WHEN n % 20 = 0 THEN segment || 'x' ELSE segment END AS b FROM {customer_t} AS t")
_define("customer_null_s", "SELECT CASE WHEN n % 9 = 0 THEN ' NULL ' WHEN n % 9 = 1 THEN '' ELSE segment END AS segment, id FROM {customer_s} AS s")
_define("customer_null_t", "SELECT CASE WHEN n % 9 = 0 THEN 'n/a' WHEN n % 9 = 1 THEN CAST(NULL AS STRING) WHEN n % 9 = 2 THEN 'None' ELSE segment END AS segment, id FROM {customer_s} AS s")
_define("keys_null_s", "SELECT CASE WHEN s_suppkey = 1 THEN CAST(NULL AS STRING) ELSE CAST(s_suppkey AS STRING) END AS id, s_name AS name FROM {supplier}")
_define("keys_null_t", "SELECT CASE WHEN s_suppkey = 1 THEN ' na ' ELSE ' ' || CAST(s_suppkey AS STRING) END AS id, s_name AS name FROM {supplier} WHERE s_suppkey % 10 <> 3")
_define("phones_s", "SELECT CAST(s_suppkey AS STRING) AS id, '+91-' || lpad(CAST(s_suppkey AS STRING), 5, '9') || '-' || lpad(CAST(s_suppkey AS STRING), 5, '8') AS phone, 'SUP-' || CAST(s_suppkey AS STRING) AS code FROM {supplier}")
_define("phones_t", "SELECT CAST(s_suppkey AS STRING) AS id, '91' || lpad(CAST(s_suppkey AS STRING), 5, '9') || CASE WHEN s_suppkey % 6 = 0 THEN '00000' ELSE lpad(CAST(s_suppkey AS STRING), 5, '8') END AS phone, CASE WHEN s_suppkey % 4 = 0 THEN 'X' ELSE '' END || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 9 = 0 THEN '0' ELSE '' END AS code FROM {supplier}")
_define("turns_s", "SELECT CAST(conv_id AS STRING) AS conv, CAST(turn AS STRING) AS turn, role, md5(text) AS hash, conv_id AS c, turn AS t FROM {conversations}")
_define("turns_t", "SELECT conv, turn, CASE WHEN c % 8 = 0 AND t = 1 THEN 'changed' ELSE role END AS role, hash, c, t FROM {turns_s} AS s WHERE NOT (c % 9 = 0 AND t = 0)")
_define("lines_s", f"SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id, l_partkey AS p, {_money('l_quantity')} AS qty, l_returnflag AS flag FROM {{lineitem}}")
_define("lines_t", "SELECT id, p, qty, CASE WHEN p % 23 = 0 THEN 'Z' ELSE flag END AS flag FROM {lines_s} AS s WHERE p % 31 <> 0")
_define("bag_s", "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey AS STRING) AS supp FROM {lineitem}")
_define("bag_t", "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey AS STRING) AS supp FROM {lineitem} WHERE l_partkey % 41 <> 0")
_define("nation_s", "SELECT n_nationkey AS n, n_name AS name, CAST(n_regionkey AS STRING) AS region FROM {nation}")
_define("nation_t", "SELECT n_nationkey AS n, CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS name, CAST(n_regionkey AS STRING) AS region FROM {nation} WHERE n_nationkey < 23")
_define("fixed_s", "SELECT s_suppkey AS n, rpad(CAST(s_suppkey AS STRING), 8, ' ') || rpad(s_name, 24, ' ') || lpad(CAST(s_nationkey AS STRING), 6, '0') AS line FROM {supplier}")
_define("fixed_t", "SELECT s_suppkey AS n, rpad(CAST(s_suppkey AS STRING), 8, ' ') || rpad(CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE s_name END, 24, ' ') || lpad(CAST(s_nationkey AS STRING), 6, ' ') AS line FROM {supplier} WHERE s_suppkey % 10 <> 1")
_define("runs", """
    SELECT event_id AS run_id, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 29 = 0 THEN 'skipped' ELSE 'completed' END AS status, event_id % 3 <> 0 AS is_match,
           ts AS created_at, event_type AS entity, event_type || '_source_20260528.csv' AS source_name, event_type || '_target_20260529.csv' AS target_name FROM {events}""")
_define("props_s", "SELECT CAST(event_id AS STRING) AS id, props AS json FROM {events}")
# braces are written by code, as both engines' templates use them
_define("props_t", """
    SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 12 = 0 THEN chr(123) || '"k": -1' || chr(125) WHEN event_id % 15 = 0 THEN chr(123) || '"j": 1' || chr(125) ELSE props END AS json
    FROM {events}""")
