"""Registry of the reconciliation queries, one per operator group, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, identity
from ..functions.mapping import Field, SideRule
from ..operators import compare, fixed_width, history, json_diff, quality, report
from ..operators.reconcile import Reconciliation, multiset_difference, positional
from ..sources import layout, readers
from ..sources.scratch import scratch_path
from . import file_queries, oracle
from .inputs import SQL, expand, frame, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _pair(spark: SparkSession, d: str, s: str, t: str, fields: list[Field], keys: tuple[str, ...] = ("id",), **how: object) -> Reconciliation:
    return Reconciliation(load(spark, d, s), load(spark, d, t), keys, fields, **how)


def _plain(*names: str, mode: str = "auto") -> list[Field]:
    return [Field(n, (n,), (n,), mode) for n in names]


ORDER_CELLS, CUSTOMER_CELLS = ("status", "price", "odate", "priority"), ("name", "balance", "segment")


def _orders(spark: SparkSession, d: str) -> Reconciliation:
    return _pair(spark, d, "orders_s", "orders_t", _plain(*ORDER_CELLS))


def _customers(spark: SparkSession, d: str) -> Reconciliation:
    return _pair(spark, d, "customer_s", "customer_t", _plain(*CUSTOMER_CELLS))


O_ORDERS = oracle.joined("orders_s", "orders_t", ["id"], oracle.same(ORDER_CELLS))
O_ORDER_M = oracle.mismatches("orders_s", "orders_t", ["id"], oracle.same(ORDER_CELLS))
O_CUSTOMERS = oracle.joined("customer_s", "customer_t", ["id"], oracle.same(CUSTOMER_CELLS))

# --- the join and its counts --------------------------------------------------


@query("recon_status_counts", f"WITH {O_ORDERS} {oracle.COUNTS}")
def _(spark, d):
    return _orders(spark, d).status_counts()


@query("recon_missing", f"WITH {O_ORDERS} SELECT uid FROM j WHERE status = 'missing_in_target'")
def _(spark, d):
    return _orders(spark, d).missing()


@query("recon_extra", f"WITH {O_ORDERS} SELECT uid FROM j WHERE status = 'extra_in_target'")
def _(spark, d):
    return _orders(spark, d).extra()


@query("recon_changed_cells", f"WITH {O_ORDERS}, {oracle.changed(oracle.same(ORDER_CELLS))} SELECT * FROM c")
def _(spark, d):
    return _orders(spark, d).changed_cells()


@query("recon_presence_detail", f"WITH {O_CUSTOMERS} SELECT x.id AS uid, x.id, x.name, x.balance, x.segment FROM j JOIN ({oracle.side('customer_s')}) AS x ON j.uid = x.id WHERE status = 'missing_in_target'")
def _(spark, d):
    return _customers(spark, d).presence_detail()


@query("recon_mismatch_long", f"WITH {oracle.mismatches('customer_s', 'customer_t', ['id'], oracle.same(CUSTOMER_CELLS))} SELECT * FROM m")
def _(spark, d):
    return _customers(spark, d).mismatches(details=False).drop("row_detail")


_record = lambda side, kind: ", ".join(f"CASE WHEN status <> '{kind}' THEN {side}{i} END AS {side}_{n}" for i, n in enumerate(CUSTOMER_CELLS))


@query("recon_row_detail", f"""WITH {oracle.joined('customer_s', 'customer_t', ['id'], [(n, f"CAST({n} AS STRING)", f"CAST({n} AS STRING)") for n in CUSTOMER_CELLS])}
    SELECT uid, status AS mismatch_type, {_record('s', 'extra_in_target')}, {_record('t', 'missing_in_target')} FROM j WHERE status <> 'value_match'""")
def _(spark, d):
    raw = lambda side, t, n: F.get_json_object("row_detail", f"$.{side}_record.{n}").alias(f"{t}_{n}")
    rows = _customers(spark, d).mismatches()
    return rows.select("uid", "mismatch_type", *[raw(side, side[0], n) for side in ("source", "target") for n in CUSTOMER_CELLS]).distinct()


@query("recon_summary", f"""WITH {O_ORDER_M} SELECT count(*) FILTER (WHERE mismatch_type = 'missing_in_target') AS missing_in_target, count(*) FILTER (WHERE mismatch_type = 'extra_in_target') AS extra_in_target,
    count(*) FILTER (WHERE mismatch_type = 'value_mismatch') AS value_mismatch_cells, count(DISTINCT CASE WHEN mismatch_type = 'value_mismatch' THEN uid END) AS value_mismatch_rows FROM m""")
def _(spark, d):
    return _orders(spark, d).summary()


@query("recon_composite_key", f"WITH {oracle.mismatches('turns_s', 'turns_t', ['conv', 'turn'], oracle.same(('role', 'hash')))} SELECT * FROM m")
def _(spark, d):
    return _pair(spark, d, "turns_s", "turns_t", _plain("role", "hash"), ("conv", "turn")).mismatches(details=False).drop("row_detail")


# --- mappings, modes and transforms ---------------------------------------------


def _mapped(name: str, s: str, t: str, fields: list[Field], cells: list[tuple[str, str, str]], keys: tuple[str, ...] = ("id",)) -> None:
    """A query of the changed cells of a mapped pair."""

    @query(name, f"WITH {oracle.mismatches(s, t, list(keys), cells)} SELECT * FROM m")
    def _(spark, d):
        return _pair(spark, d, s, t, fields, keys).mismatches(details=False).drop("row_detail")


C = oracle.canon
_mapped("recon_rename_map", "customer_s", "customer_renamed", [Field("name", ("name",), ("full_name",)), Field("segment", ("segment",), ("market",))], [("name", C("name"), C("full_name")), ("segment", C("segment"), C("market"))])
_mapped("recon_many_to_one", "customer_parts_s", "customer_parts_t", [Field("first_part", ("first_part", "last_part"), ("full_name",))], [("first_part", f"{C('first_part')} || ' ' || {C('last_part')}", C("full_name"))])
_mapped("recon_one_to_many", "customer_s", "customer_twice_t", [Field("segment", ("segment",), ("a", "b"))], [("segment", C("segment"), f"CASE WHEN {C('a')} = {C('b')} THEN {C('a')} ELSE {C('a')} || chr(31) || {C('b')} END")])
_mapped("recon_null_tokens", "customer_null_s", "customer_null_t", _plain("segment"), oracle.same(["segment"]))
_mapped("recon_null_safe_key", "keys_null_s", "keys_null_t", _plain("name"), oracle.same(["name"]))
_mapped("recon_text_mode", "nation_s", "nation_t", _plain("name", "region", mode="text"), oracle.same(["name", "region"]), ("n",))
_mapped("recon_case_fold", "customer_s", "customer_t", [replace(f, fold_case=True) for f in _plain("name", "segment")], [(c, *[f"CASE WHEN {C(c)} = '__NULL__' THEN '__NULL__' ELSE lower({C(c)}) END"] * 2) for c in ("name", "segment")])
_digits = "CASE WHEN regexp_replace(phone, '[^0-9]+', '', 'g') = '' THEN '__NULL__' ELSE regexp_replace(phone, '[^0-9]+', '', 'g') END"
_mapped("recon_digits_mode", "phones_s", "phones_t", _plain("phone", mode="digits"), [("phone", _digits, _digits)])
_clean = SideRule(pattern="REGEXP_REPLACE(phone, '[^0-9]', '')")
_mapped("recon_regex_normalize", "phones_s", "phones_t", [Field("phone", ("phone",), ("phone",), "text", source=_clean, target=_clean)], [("phone", _digits, _digits)])
_mapped("recon_strip_prefix", "phones_s", "phones_t", [Field("code", ("code",), ("code",), "text", source=SideRule(strip_prefix="SUP-"), target=SideRule(strip_prefix="X"))], [("code", "substr(code, 5)", "CASE WHEN starts_with(code, 'X') THEN substr(code, 2) ELSE code END")])
_iso = "CAST(CAST(odate AS DATE) AS STRING)"
_any = "CAST(coalesce(try_strptime(odate, '%d.%m.%Y'), least(try_strptime(odate, '%m/%d/%Y'), try_strptime(odate, '%d/%m/%Y')))::DATE AS STRING)"
_mapped("recon_date_auto", "orders_dates_s", "orders_dates_t", _plain("odate"), [("odate", _iso, _any)])
_known = "CAST(coalesce(try_strptime(odate, '%m/%d/%Y'), try_strptime(odate, '%d.%m.%Y'))::DATE AS STRING)"
_mapped("recon_date_mode", "orders_dates_s", "orders_dates_t", [Field("odate", ("odate",), ("odate",), "date", target=SideRule(date_format="MM/DD/YYYY"))], [("odate", _iso, _known)])


@query("recon_date_overlap", f"""WITH s AS ({oracle.side('orders_dates_s')}), t AS ({oracle.side('orders_dates_t')}) SELECT count(*) AS n, count(*) FILTER (WHERE CAST(s.odate AS DATE) IN
    (try_strptime(t.odate, '%d.%m.%Y')::DATE, try_strptime(t.odate, '%m/%d/%Y')::DATE, try_strptime(t.odate, '%d/%m/%Y')::DATE)) AS equal FROM s JOIN t USING (id)""")
def _(spark, d):
    s, t = load(spark, d, "orders_dates_s"), load(spark, d, "orders_dates_t").withColumnRenamed("odate", "other")
    return s.join(t, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(canon.overlap(F.col("odate"), F.col("other"))).alias("equal"))


@query("recon_masked", f"WITH {O_CUSTOMERS}, {oracle.changed(oracle.same(CUSTOMER_CELLS))} SELECT uid, column_name, CASE column_name WHEN 'name' THEN '****' ELSE source_value END AS source_value, CASE column_name WHEN 'name' THEN '****' ELSE target_value END AS target_value FROM c")
def _(spark, d):
    fields = [replace(f, sensitive=f.key == "name") for f in _plain(*CUSTOMER_CELLS)]
    return _pair(spark, d, "customer_s", "customer_t", fields).changed_cells()


# --- repeated, missing and no keys -------------------------------------------------


@query("recon_duplicate_keys", f"WITH {oracle.joined('lines_s', 'lines_t', ['id'], oracle.same(('qty', 'flag')))} {oracle.COUNTS}")
def _(spark, d):
    return _pair(spark, d, "lines_s", "lines_t", _plain("qty", "flag")).status_counts()


_last = {n: f"SELECT id, qty, flag FROM (SELECT *, row_number() OVER (PARTITION BY {C('id')} ORDER BY p DESC, qty DESC, flag DESC) AS nth FROM ({{{n}}}) AS x) AS y WHERE nth = 1" for n in ("lines_s", "lines_t")}
SQL["lines_last_s"], SQL["lines_last_t"] = _last["lines_s"], _last["lines_t"]


@query("recon_last_wins", f"WITH {oracle.joined('lines_last_s', 'lines_last_t', ['id'], oracle.same(('qty', 'flag')))} {oracle.COUNTS}")
def _(spark, d):
    return _pair(spark, d, "lines_s", "lines_t", _plain("qty", "flag"), on_duplicate="last", order=("p", "qty", "flag")).status_counts()


_bag = "flag, status, supp"


@query("recon_multiset", f"""WITH s AS (SELECT {_bag}, count(*) AS a FROM ({oracle.side('bag_s')}) AS x GROUP BY ALL), t AS (SELECT {_bag}, count(*) AS b FROM ({oracle.side('bag_t')}) AS x GROUP BY ALL)
    SELECT flag, status, supp, coalesce(a, 0) AS source_count, coalesce(b, 0) AS target_count, CASE WHEN coalesce(a, 0) > coalesce(b, 0) THEN 'missing_in_target' ELSE 'extra_in_target' END AS mismatch_type
    FROM s FULL OUTER JOIN t USING ({_bag}) WHERE coalesce(a, 0) <> coalesce(b, 0)""")
def _(spark, d):
    return multiset_difference(load(spark, d, "bag_s"), load(spark, d, "bag_t"), ["flag", "status", "supp"])


@query("recon_except_all", f"SELECT {_bag}, count(*) AS n FROM (({expand(SQL['bag_s'])}) EXCEPT ALL ({expand(SQL['bag_t'])})) AS x GROUP BY ALL")
def _(spark, d):
    left = load(spark, d, "bag_s").exceptAll(load(spark, d, "bag_t"))
    return left.groupBy("flag", "status", "supp").agg(F.count(F.lit(1)).alias("n"))


SQL["nation_row_s"] = "SELECT row_number() OVER (ORDER BY n) - 1 AS row_, name, region FROM {nation_s} AS s"
SQL["nation_row_t"] = "SELECT row_number() OVER (ORDER BY n) - 1 AS row_, name, region FROM {nation_t} AS t"


@query("recon_positional", f"WITH {oracle.mismatches('nation_row_s', 'nation_row_t', ['row_'], oracle.same(('name', 'region')))} SELECT * FROM m")
def _(spark, d):
    return positional(load(spark, d, "nation_s"), load(spark, d, "nation_t"), _plain("name", "region"), ["n"]).drop("row_detail")


@query("empty_target", f"SELECT 0 AS matching, 0 AS changed, count(*) AS missing, 0 AS extra FROM ({oracle.side('nation_s')}) AS x")
def _(spark, d):
    s = load(spark, d, "nation_s")
    return Reconciliation(s, s.where("false"), ["n"], _plain("name")).status_counts()


@query("empty_source", f"SELECT 0 AS matching, 0 AS changed, 0 AS missing, count(*) AS extra FROM ({oracle.side('nation_s')}) AS x")
def _(spark, d):
    s = load(spark, d, "nation_s")
    return Reconciliation(s.where("false"), s, ["n"], _plain("name")).status_counts()


@query("both_empty", "SELECT 0 AS matching, 0 AS changed, 0 AS missing, 0 AS extra, true AS is_match")
def _(spark, d):
    s = load(spark, d, "nation_s").where("false")
    return compare.is_match(Reconciliation(s, s, ["n"], _plain("name")).status_counts())


# --- partitions, digests, fingerprints -----------------------------------------------

_pid = "CAST(('0x' || substr(md5(uid), 1, 15))::BIGINT % 16 AS INTEGER)"


@query("partition_stats", f"""WITH {O_ORDERS} SELECT {_pid} AS partition_id, count(*) FILTER (WHERE in_s) AS source_rows, count(*) FILTER (WHERE in_t) AS target_rows, count(*) FILTER (WHERE status = 'missing_in_target') AS missing,
    count(*) FILTER (WHERE status = 'extra_in_target') AS extra, count(*) FILTER (WHERE status = 'value_mismatch') AS changed FROM j GROUP BY 1""")
def _(spark, d):
    return _orders(spark, d).partition_stats(16)


@query("mismatched_partitions", f"WITH {O_ORDERS}, p AS (SELECT {_pid} AS pid, bool_or(status <> 'value_match') AS bad FROM j GROUP BY 1) SELECT count(*) FILTER (WHERE bad) AS mismatched_partitions, count(*) AS partitions FROM p")
def _(spark, d):
    return _orders(spark, d).mismatched_partitions(16)


def _hashed(name: str, cols: tuple[str, ...]) -> str:
    line = " || chr(31) || ".join([C("id"), *[C(c) for c in cols]])
    return f"SELECT {C('id')} AS uid, ('0x' || substr(md5({line}), 1, 15))::BIGINT AS h FROM ({oracle.side(name)}) AS x"


_digest = f"bit_xor(h) AS xor_digest, CAST(sum(CAST(h AS HUGEINT)) % {1 << 62} AS BIGINT) AS sum_digest, count(*) AS rows"


@query("dataset_digest", f"SELECT {_digest} FROM ({_hashed('orders_s', ORDER_CELLS)}) AS h")
def _(spark, d):
    return compare.digest(load(spark, d, "orders_s"), ["id"], ORDER_CELLS, algorithm="md5")


@query("partition_digest", f"SELECT {_pid} AS partition_id, {_digest} FROM ({_hashed('orders_s', ORDER_CELLS)}) AS h GROUP BY 1")
def _(spark, d):
    return compare.digest(load(spark, d, "orders_s"), ["id"], ORDER_CELLS, 16, "md5")


@query("unlike_partitions", f"""WITH a AS (SELECT {_pid} AS partition_id, {_digest} FROM ({_hashed('orders_s', ORDER_CELLS)}) AS h GROUP BY 1), b AS (SELECT {_pid} AS partition_id, {_digest} FROM ({_hashed('orders_t', ORDER_CELLS)}) AS h GROUP BY 1)
    SELECT partition_id FROM a FULL OUTER JOIN b USING (partition_id) WHERE a.xor_digest IS DISTINCT FROM b.xor_digest OR a.sum_digest IS DISTINCT FROM b.sum_digest OR a.rows IS DISTINCT FROM b.rows""")
def _(spark, d):
    a, b = (compare.digest(load(spark, d, n), ["id"], ORDER_CELLS, 16, "md5") for n in ("orders_s", "orders_t"))
    return compare.unlike_partitions(a, b)


_PART = "SELECT CAST(p_partkey AS STRING) AS id, p_name AS name, p_brand AS brand, p_type AS kind FROM {part}"
_part_line = " || chr(31) || ".join(C(c) for c in ("id", "name", "brand", "kind"))


@query("row_fingerprint_sha256", f"SELECT id, sha256({_part_line}) AS fingerprint FROM ({expand(_PART)}) AS x")
def _(spark, d):
    df = frame(spark, d, _PART)
    return df.select("id", identity.fingerprint([canon.text(df[c]) for c in df.columns], "sha256").alias("fingerprint"))


@query("row_fingerprint_xx64")
def _(spark, d):
    df = frame(spark, d, _PART)
    return df.select("id", identity.fingerprint([canon.text(df[c]) for c in df.columns]).alias("fingerprint"))


@query("row_identity_all_columns", f"SELECT id, sha256('brand=' || {C('brand')} || chr(31) || 'id=' || {C('id')} || chr(31) || 'kind=' || {C('kind')} || chr(31) || 'name=' || {C('name')}) AS identity FROM ({expand(_PART)}) AS x")
def _(spark, d):
    df = frame(spark, d, _PART)
    return df.select("id", identity.row_identity(df, df.columns).alias("identity"))


@query("pair_key", f"SELECT run_id, sha256(source_name || chr(0) || target_name) AS pair_key FROM ({oracle.side('runs')}) AS r")
def _(spark, d):
    return load(spark, d, "runs").select("run_id", history.pair_key(F.col("source_name"), F.col("target_name")).alias("pair_key"))


# --- litmus and schemas ---------------------------------------------------------------


_columns = lambda name: f"(SELECT list(column_name) FROM (DESCRIBE {oracle.side(name)}))"


@query("litmus_counts", f"""WITH c AS (SELECT (SELECT count(*) FROM ({oracle.side('orders_s')}) AS a) AS source_rows, (SELECT count(*) FROM ({oracle.side('orders_t')}) AS b) AS target_rows)
    SELECT source_rows, target_rows, source_rows = target_rows AS same_rows, {_columns('orders_s')} = {_columns('orders_t')} AS same_columns FROM c""")
def _(spark, d):
    return compare.litmus(load(spark, d, "orders_s"), load(spark, d, "orders_t"))


@query("is_match", f"WITH {O_ORDERS} SELECT *, missing + extra + changed = 0 AS is_match FROM ({oracle.COUNTS}) AS c")
def _(spark, d):
    return compare.is_match(_orders(spark, d).status_counts())


_SCHEMA_S = """SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(20)' ELSE 'decimal(10,2)' END AS type, n_nationkey % 4 <> 0 AS nullable,
    n_nationkey AS position, CASE WHEN n_nationkey % 3 = 2 THEN 10 END AS precision, CASE WHEN n_nationkey % 3 = 2 THEN 2 END AS scale FROM {nation} WHERE n_nationkey % 7 <> 1"""
_SCHEMA_T = """SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'date' WHEN n_nationkey % 3 = 0 THEN 'int' WHEN n_nationkey % 3 = 1 THEN 'text' WHEN n_nationkey % 2 = 0 THEN 'decimal(10,2)' ELSE 'numeric(12,2)' END AS type,
    n_nationkey % 8 <> 0 AS nullable, n_nationkey AS position, CASE WHEN n_nationkey % 3 = 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 12 END END AS precision, CASE WHEN n_nationkey % 3 = 2 THEN 2 END AS scale FROM {nation} WHERE n_nationkey % 5 <> 2"""


def _schemas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, d, _SCHEMA_S), frame(spark, d, _SCHEMA_T)


_family = lambda c: f"CASE WHEN {c} IN ('bigint', 'int') THEN 'integer' WHEN {c} LIKE 'varchar%' OR {c} = 'text' THEN 'string' WHEN {c} LIKE 'decimal%' OR {c} LIKE 'numeric%' THEN 'decimal' ELSE {c} END"
_schema_both = f"""WITH s AS ({expand(_SCHEMA_S)}), t AS ({expand(_SCHEMA_T)}), j AS (SELECT coalesce(s.name, t.name) AS column_name, s.type AS a, t.type AS b, s.nullable AS an, t.nullable AS bn, s.precision AS ap, t.precision AS bp,
    s.scale AS az, t.scale AS bz, s.name IS NOT NULL AS x, t.name IS NOT NULL AS y FROM s FULL OUTER JOIN t ON s.name = t.name)"""
_presence = "SELECT column_name, 'missing_in_target' AS issue, a AS source_value, NULL AS target_value FROM j WHERE NOT y UNION ALL SELECT column_name, 'extra_in_target', NULL, b FROM j WHERE NOT x"


@query("schema_diff", f"{_schema_both} {_presence} UNION ALL SELECT column_name, 'type_mismatch', a, b FROM j WHERE x AND y AND a <> b")
def _(spark, d):
    return compare.schema_diff(*_schemas(spark, d))


@query("schema_diff_harmonized", f"""{_schema_both} {_presence} UNION ALL SELECT column_name, 'type_mismatch', a, b FROM j WHERE x AND y AND {_family('a')} <> {_family('b')}
    UNION ALL SELECT column_name, 'nullable_mismatch', CAST(an AS STRING), CAST(bn AS STRING) FROM j WHERE x AND y AND an <> bn
    UNION ALL SELECT column_name, 'precision_mismatch', CAST(ap AS STRING), CAST(bp AS STRING) FROM j WHERE x AND y AND ap IS DISTINCT FROM bp
    UNION ALL SELECT column_name, 'scale_mismatch', CAST(az AS STRING), CAST(bz AS STRING) FROM j WHERE x AND y AND az IS DISTINCT FROM bz""")
def _(spark, d):
    return compare.schema_diff(*_schemas(spark, d), harmonized=True)


# --- counts, samples, pages -------------------------------------------------------------


def _mismatches(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).mismatches(details=False).drop("row_detail")


@query("value_mismatch_by_column", f"WITH {O_ORDER_M} SELECT coalesce(nullif(column_name, ''), '(unknown)') AS column_name, count(DISTINCT uid) AS n FROM m WHERE mismatch_type = 'value_mismatch' GROUP BY 1")
def _(spark, d):
    return report.counts_by_column(_mismatches(spark, d))


@query("mismatch_by_type", f"WITH {O_ORDER_M} SELECT mismatch_type, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return report.counts_by_type(_mismatches(spark, d))


@query("mismatched_rows", f"WITH {O_ORDER_M} SELECT count(DISTINCT uid) AS value_mismatch_rows FROM m WHERE mismatch_type = 'value_mismatch'")
def _(spark, d):
    return report.mismatched_rows(_mismatches(spark, d))


_nth = "row_number() OVER (PARTITION BY {} ORDER BY uid, column_name, source_value, target_value)"
_five = "uid, mismatch_type, column_name, source_value, target_value"


@query("sample_per_column", f"WITH {O_ORDER_M} SELECT {_five} FROM (SELECT *, {_nth.format('column_name')} AS nth FROM m WHERE mismatch_type = 'value_mismatch') AS r WHERE nth <= 10")
def _(spark, d):
    return report.sample_per_column(_mismatches(spark, d), 10).drop("row_detail")


@query("sample_stratified", f"WITH {O_ORDER_M} SELECT {_five} FROM (SELECT *, {_nth.format('column_name')} AS nth FROM m WHERE mismatch_type = 'value_mismatch') AS r ORDER BY nth, column_name LIMIT 25")
def _(spark, d):
    return report.sample_stratified(_mismatches(spark, d), 25).drop("row_detail")


@query("sample_grouped", f"WITH {O_ORDER_M} SELECT {_five} FROM (SELECT *, {_nth.format('mismatch_type, column_name')} AS nth FROM m) AS r WHERE nth <= 10")
def _(spark, d):
    return report.sample_grouped(_mismatches(spark, d), 10).drop("row_detail")


@query("sample_mixed", f"""WITH {O_ORDER_M}, n AS (SELECT count(*) FILTER (WHERE mismatch_type = 'missing_in_target') AS a, count(*) FILTER (WHERE mismatch_type = 'extra_in_target') AS b, count(*) FILTER (WHERE mismatch_type = 'value_mismatch') AS c FROM m),
    p AS (SELECT {_five}, row_number() OVER (PARTITION BY mismatch_type ORDER BY uid, column_name) AS turn FROM m WHERE mismatch_type <> 'value_mismatch'
          UNION ALL SELECT {_five}, row_number() OVER (ORDER BY nth, column_name) FROM (SELECT *, {_nth.format('column_name')} AS nth FROM m WHERE mismatch_type = 'value_mismatch') AS v),
    q AS (SELECT *, row_number() OVER (ORDER BY turn, CASE mismatch_type WHEN 'missing_in_target' THEN 0 WHEN 'extra_in_target' THEN 1 ELSE 2 END) AS place FROM p)
    SELECT {_five} FROM q WHERE place <= 30""")
def _(spark, d):
    return report.sample_mixed(_mismatches(spark, d), 30).drop("row_detail")


@query("match_sample", f"WITH s AS ({oracle.side('nation_s')}), c AS (SELECT n, 'name' AS column_name, name AS v FROM s UNION ALL SELECT n, 'region', region FROM s) SELECT CAST(n AS STRING) AS uid, 'value_match' AS mismatch_type, column_name, v AS source_value, v AS target_value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY CAST(n AS STRING)) AS nth FROM c) AS r WHERE nth <= 5")
def _(spark, d):
    return _pair(spark, d, "nation_s", "nation_s", _plain("name", "region"), ("n",)).match_samples(5)


@query("page_mismatches", f"WITH {O_ORDER_M} SELECT {_five} FROM m ORDER BY mismatch_type, uid, column_name NULLS FIRST LIMIT 50 OFFSET 100")
def _(spark, d):
    return report.page(_mismatches(spark, d), 50, 100).drop("row_detail")


@query("dedupe_mismatches", f"WITH {O_ORDER_M} SELECT DISTINCT {_five} FROM m")
def _(spark, d):
    m = _mismatches(spark, d)
    return report.dedupe(m.unionByName(m)).drop("row_detail")


# --- history ------------------------------------------------------------------------------

_R = f"r AS ({oracle.side('runs')})"


def _stats(unit: str, first: str, last: str) -> str:
    return f"""WITH {_R}, c AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{first}'), date_trunc('{unit}', TIMESTAMP '{last}'), INTERVAL 1 {unit.upper()})) AS bucket),
        g AS (SELECT date_trunc('{unit}', created_at) AS bucket, count(*) AS total, count(*) FILTER (WHERE is_match) AS passed, count(*) FILTER (WHERE NOT is_match) AS failed FROM r WHERE created_at BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}' GROUP BY 1)
        SELECT bucket, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed FROM c LEFT JOIN g USING (bucket)"""


def _bounded(spark: SparkSession, d: str, unit: str, first: str, last: str) -> DataFrame:
    return history.run_stats(load(spark, d, "runs"), unit, F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))


DAYS, HOURS = ("2024-01-01 00:00:00", "2024-03-31 23:59:59"), ("2024-01-02 00:00:00", "2024-01-02 23:59:59")


@query("daily_stats", _stats("day", *DAYS))
def _(spark, d):
    return _bounded(spark, d, "day", *DAYS)


@query("hourly_stats", _stats("hour", *HOURS))
def _(spark, d):
    return _bounded(spark, d, "hour", *HOURS)


@query("recent_runs", f"WITH {_R} SELECT run_id, status, created_at FROM r WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 20 OFFSET 10")
def _(spark, d):
    return history.recent(load(spark, d, "runs"), 20, 10, "completed").select("run_id", "status", "created_at")


@query("entity_insights", f"WITH {_R} SELECT entity, count(*) FILTER (WHERE is_match) AS success, count(*) FILTER (WHERE NOT is_match) AS failed, count(*) AS total FROM r GROUP BY 1")
def _(spark, d):
    return history.entity_insights(load(spark, d, "runs")).drop("runs")


@query("batch_summary", f"WITH {_R} SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'completed' AND is_match) AS passed FROM r")
def _(spark, d):
    return history.batch_summary(load(spark, d, "runs"))


@query("delete_runs", f"WITH {_R} SELECT count(*) AS n, count(DISTINCT entity) AS entities FROM r WHERE status <> 'failed'")
def _(spark, d):
    runs = load(spark, d, "runs")
    kept, _ = history.delete_runs(runs, runs.select("run_id"), runs.where("status = 'failed'").select("run_id"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))


FILES = "SELECT n_nationkey AS n, 'in/' || lower(n_name) || '_20251231.csv' AS source_name, 'out/target_' || lower(n_name) || '_final.csv' AS target_name FROM {nation}"


@query("entity_tokens", f"SELECT source_name, array_to_string(list_filter(string_split_regex(regexp_replace(string_split(source_name, '/')[-1], '\\.[^.]*$', ''), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('source','target','src','tgt','file','final','raw','data') AND NOT (regexp_full_match(w, '[0-9]+') AND length(w) IN (6,8,10,12,14))), ' ') AS words FROM ({expand(FILES)}) AS f")
def _(spark, d):
    f = frame(spark, d, FILES)
    return f.select("source_name", F.array_join(history.tokens(F.col("source_name")), " ").alias("words"))


_KNOWN = "SELECT lower(n_name) AS name FROM {nation} WHERE n_nationkey % 3 <> 0"


@query("infer_entities", f"""WITH k AS ({expand(_KNOWN)}), f AS ({expand(FILES)}), w AS (SELECT f.*, split_part(lower(string_split(source_name, '/')[-1]), '_2025', 1) AS own FROM f)
    SELECT source_name, target_name, CASE WHEN n % 3 <> 0 THEN own ELSE (SELECT min(name) FROM k) END AS entity, CASE WHEN n % 3 <> 0 THEN 2 ELSE 1 END AS score, CASE WHEN n % 3 <> 0 THEN 'high' ELSE 'medium' END AS confidence FROM w""")
def _(spark, d):
    known = frame(spark, d, _KNOWN).withColumns({"display_name": F.upper("name"), "aliases": F.lit(None).cast("array<string>")})
    return history.infer_entities(frame(spark, d, FILES).drop("n"), known).withColumn("score", F.col("score").cast("int"))


@query("upsert_entities", """SELECT regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g') AS name, r_name AS display_name, array_to_string(list_sort(['zone', lower(r_name)]), ',') AS aliases FROM region""")
def _(spark, d):
    known = frame(spark, d, "SELECT lower(r_name) AS name, r_name AS display_name, array(lower(r_name)) AS aliases FROM {region}")
    new = frame(spark, d, "SELECT r_name AS name, CAST(NULL AS STRING) AS display_name, array('zone', lower(r_name)) AS aliases FROM {region}")
    return history.upsert_entities(known, new).select("name", "display_name", F.array_join("aliases", ",").alias("aliases"))


# --- typed canonicalization, quality, layouts --------------------------------------------------

_TYPED = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price, CAST(CAST(l_quantity AS DECIMAL(18,1)) AS STRING) AS qty, CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE 'F' END AS flag, CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T01:02:03.5Z' AS moment FROM {lineitem}"


@query("typed_decimal", f"SELECT id, rtrim(rtrim(price, '0'), '.') AS v FROM ({expand(_TYPED)}) AS x")
def _(spark, d):
    return frame(spark, d, _TYPED).select("id", canon.decimal(F.col("price")).alias("v"))


@query("typed_integer", f"SELECT id, CAST(CAST(trunc(CAST(qty AS DOUBLE)) AS BIGINT) AS STRING) AS v FROM ({expand(_TYPED)}) AS x")
def _(spark, d):
    return frame(spark, d, _TYPED).select("id", canon.integer(F.col("qty")).alias("v"))


@query("typed_boolean", f"SELECT id, CASE flag WHEN 'Yes' THEN 'true' ELSE 'false' END AS v FROM ({expand(_TYPED)}) AS x")
def _(spark, d):
    return frame(spark, d, _TYPED).select("id", canon.boolean(F.col("flag")).alias("v"))


@query("typed_timestamp", f"SELECT id, substr(moment, 1, 19) AS v FROM ({expand(_TYPED)}) AS x")
def _(spark, d):
    return frame(spark, d, _TYPED).select("id", canon.timestamp(F.col("moment")).alias("v"))


_QUALITY = "SELECT id, CASE WHEN n % 20 = 0 THEN ' ' ELSE name END AS name, segment, CASE WHEN n % 30 = 0 THEN 'x' ELSE id END AS num FROM {customer_s} AS s"


@query("quality_errors", f"""WITH q AS ({expand(_QUALITY)}) SELECT id AS row, 'name' AS "column", name AS value, 'value is required' AS message FROM q WHERE trim(name) = ''
    UNION ALL SELECT id, 'segment', segment, 'length ' || length(segment) || ' is above 9' FROM q WHERE length(segment) > 9 UNION ALL SELECT id, 'num', num, 'not an integer' FROM q WHERE num = 'x'""")
def _(spark, d):
    rules = [quality.Constraint("name", required=True), quality.Constraint("segment", max_length=9), quality.Constraint("num", "integer")]
    return quality.check(frame(spark, d, _QUALITY), rules, "id")


SUPPLIER_LAYOUT = (
    fixed_width.Slice("record_id", (0, 8)),
    fixed_width.Slice("name", (8, 32)),
    fixed_width.Slice("nation", (32, 38), type="integer"),
)


@query("fixed_width_slice", f"SELECT trim(substr(line, 1, 8)) AS record_id, trim(substr(line, 9, 24)) AS name, trim(substr(line, 33, 6)) AS nation FROM ({oracle.side('fixed_s')}) AS x")
def _(spark, d):
    return fixed_width.sliced(load(spark, d, "fixed_s"), SUPPLIER_LAYOUT, "source")


@query("fixed_width_recon", f"""WITH s AS (SELECT trim(substr(line, 1, 8)) AS id, trim(substr(line, 9, 24)) AS name, trim(substr(line, 33, 6)) AS nation FROM ({oracle.side('fixed_s')}) AS x), t AS (SELECT trim(substr(line, 1, 8)) AS id, trim(substr(line, 9, 24)) AS name, trim(substr(line, 33, 6)) AS nation FROM ({oracle.side('fixed_t')}) AS x)
    SELECT s.id AS uid, 'missing_in_target' AS mismatch_type, NULL AS column_name, NULL AS source_value, NULL AS target_value FROM s ANTI JOIN t USING (id) UNION ALL SELECT t.id, 'extra_in_target', NULL, NULL, NULL FROM t ANTI JOIN s USING (id)
    UNION ALL SELECT s.id, 'value_mismatch', 'name', s.name, t.name FROM s JOIN t USING (id) WHERE s.name <> t.name UNION ALL SELECT s.id, 'value_mismatch', 'nation', s.nation, t.nation FROM s JOIN t USING (id) WHERE s.nation::INT <> t.nation::INT""")
def _(spark, d):
    return fixed_width.reconcile_fixed_width(load(spark, d, "fixed_s"), load(spark, d, "fixed_t"), SUPPLIER_LAYOUT).drop("row_detail")


@query("line_by_line_dates", f"""WITH s AS (SELECT id, odate FROM ({oracle.side('orders_dates_s')}) AS x), t AS (SELECT id, odate FROM ({oracle.side('orders_dates_t')}) AS x)
    SELECT CAST(id AS BIGINT) AS n, CASE WHEN try_strptime(t.odate, '%m/%d/%Y') IS NULL THEN 'parse_error' ELSE 'value_mismatch' END AS problem, s.odate AS source_value, t.odate AS target_value
    FROM s JOIN t USING (id) WHERE try_strptime(t.odate, '%m/%d/%Y')::DATE IS DISTINCT FROM CAST(s.odate AS DATE)""")
def _(spark, d):
    side = lambda n: load(spark, d, n).select(F.col("id").cast("long").alias("n"), F.col("odate").alias("line"))
    return fixed_width.line_by_line(side("orders_dates_s"), side("orders_dates_t"), (0, 10, "YYYY-MM-DD"), (0, 10, "MM/DD/YYYY"))


@query("split_name_check", f"SELECT n, s.full_name AS source_value, t.a || ' ' || t.b AS target_value FROM (SELECT CAST(id AS BIGINT) AS n, full_name FROM ({oracle.side('customer_parts_t')}) AS x) AS s FULL OUTER JOIN (SELECT CAST(id AS BIGINT) AS n, first_part AS a, last_part AS b FROM ({oracle.side('customer_parts_s')}) AS y) AS t USING (n) WHERE s.full_name IS DISTINCT FROM t.a || ' ' || t.b")
def _(spark, d):
    full = load(spark, d, "customer_parts_t").withColumn("n", F.col("id").cast("long"))
    parts = load(spark, d, "customer_parts_s").withColumn("n", F.col("id").cast("long"))
    return fixed_width.split_name_check(full, parts, "full_name", ["first_part", "last_part"])


@query("layout_boundaries", f"SELECT pos, bool_and(c = ' ') AS blank FROM (SELECT unnest(range(0, 38)) AS pos, unnest(string_split(rpad(line, 38, ' '), '')) AS c FROM ({oracle.side('fixed_s')}) AS x) AS y GROUP BY pos")
def _(spark, d):
    return layout.blank_positions(load(spark, d, "fixed_s"))


_kind = lambda c: f"CASE WHEN bool_or(try_strptime({c}, '%Y-%m-%d') IS NOT NULL) THEN 'date' WHEN bool_and(regexp_full_match({c}, '-?[0-9]+')) THEN 'integer' WHEN bool_and(regexp_full_match({c}, '-?[0-9]+(\\.[0-9]+)?')) THEN 'float' ELSE 'text' END"


@query("field_type_inference", f"WITH x AS ({oracle.side('orders_s')}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_kind(c)} AS field_type FROM x" for c in ("id", "price", "odate", "priority")))
def _(spark, d):
    return layout.column_types(load(spark, d, "orders_s"), ["id", "price", "odate", "priority"])


@query("date_format_inference", f"WITH x AS ({oracle.side('orders_dates_t')}) SELECT * FROM (SELECT 'MM/DD/YYYY' AS format, count(try_strptime(odate, '%m/%d/%Y')) AS hits FROM x UNION ALL SELECT 'DD/MM/YYYY', count(try_strptime(odate, '%d/%m/%Y')) FROM x UNION ALL SELECT 'DD.MM.YYYY', count(try_strptime(odate, '%d.%m.%Y')) FROM x) AS y WHERE hits > 0")
def _(spark, d):
    return layout.date_format_hits(load(spark, d, "orders_dates_t"), "odate")


# --- names, files, JSON ---------------------------------------------------------------------------


_NAMES = "SELECT n_name || ' Id' AS name, n_nationkey AS position FROM {nation}", "SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'other_' ELSE '' END || lower(n_name) || '_id' AS name, 99 - n_nationkey AS position FROM {nation} WHERE n_nationkey % 7 <> 3"
_bare = "regexp_replace(lower({}.name), '[^a-z0-9]', '', 'g')"


@query("automap_columns", f"WITH s AS ({expand(_NAMES[0])}), t AS ({expand(_NAMES[1])}) SELECT s.name AS source_column, t.name AS target_column FROM s JOIN t ON {_bare.format('s')} = {_bare.format('t')}")
def _(spark, d):
    return compare.map_columns(*[frame(spark, d, n) for n in _NAMES])


_PATHS = "SELECT 'a/' || lower(n_name) || '.csv' AS path FROM {nation}", "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'b/other/' ELSE 'b/' END || lower(n_name) || '.csv' AS path FROM {nation} WHERE n_nationkey % 5 <> 0"


@query("file_pairing", f"WITH s AS (SELECT path, string_split(path, '/')[-1] AS n FROM ({expand(_PATHS[0])}) AS x), t AS (SELECT path, string_split(path, '/')[-1] AS n FROM ({expand(_PATHS[1])}) AS y) SELECT s.path AS source_path, t.path AS target_path FROM s FULL OUTER JOIN t USING (n)")
def _(spark, d):
    return compare.pair_files(frame(spark, d, _PATHS[0]), frame(spark, d, _PATHS[1]))


@query("json_top_keys", f"SELECT key, 'number' AS type, count(*) AS n FROM (SELECT unnest(json_keys(json)) AS key FROM ({oracle.side('props_t')}) AS x) AS k GROUP BY 1")
def _(spark, d):
    return json_diff.top_level_keys(load(spark, d, "props_t"))


@query("json_flat_diff", f"""WITH s AS ({oracle.side('props_s')}), t AS ({oracle.side('props_t')}), j AS (SELECT id, json_extract_string(s.json, '$.k') AS a, json_extract_string(t.json, '$.k') AS b, json_extract_string(t.json, '$.j') AS c FROM s JOIN t USING (id))
    SELECT id AS uid, 'value_mismatch' AS mismatch_type, 'k' AS column_name, a AS source_value, b AS target_value FROM j WHERE b IS NOT NULL AND a <> b
    UNION ALL SELECT id, 'missing_in_target', 'k', a, NULL FROM j WHERE b IS NULL UNION ALL SELECT id, 'extra_in_target', 'j', NULL, c FROM j WHERE c IS NOT NULL""")
def _(spark, d):
    s, t = load(spark, d, "props_s"), load(spark, d, "props_t")
    pairs = s.withColumnRenamed("json", "source").join(t.withColumnRenamed("json", "target"), "id").withColumnRenamed("id", "uid")
    return json_diff.diff_json(pairs).drop("row_detail")


def _nested(spark: SparkSession, d: str, change: str) -> DataFrame:
    """Nested documents: a list of the day's values and an object, per event type and user."""
    e = frame(spark, d, f"SELECT user_id % 50 AS u, event_type, event_id, {change} AS v FROM {{events}}")
    return e.groupBy("u").agg(F.to_json(F.struct(F.sort_array(F.collect_list("v")).alias("items"), F.struct(F.min("event_type").alias("first"), F.count(F.lit(1)).alias("n")).alias("meta"))).alias("json")).select(F.col("u").cast("string").alias("uid"), "json")


def _deep(spark: SparkSession, d: str, ordered: bool) -> DataFrame:
    s, t = _nested(spark, d, "event_id"), _nested(spark, d, "CASE WHEN event_id % 40 = 0 THEN -event_id ELSE event_id END")
    return json_diff.diff_json(s.withColumnRenamed("json", "source").join(t.withColumnRenamed("json", "target"), "uid"), ordered, details=False)


_paths = lambda: F.json_tuple("row_detail", "json_path", "parent_path").alias("json_path", "parent_path")
_items = """WITH e AS (SELECT user_id % 50 AS u, event_id, CASE WHEN event_id % 40 = 0 THEN -event_id ELSE event_id END AS v FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY event_id) - 1 AS si, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS ti FROM e)"""
_at = "'items[' || CAST({} AS STRING) || ']'"


@query("json_deep_diff_ordered", f"""{_items} SELECT CAST(a.u AS STRING) AS uid, 'value_mismatch' AS mismatch_type, {_at.format('a.si')} AS column_name, CAST(a.event_id AS STRING) AS source_value, CAST(b.v AS STRING) AS target_value,
    {_at.format('a.si')} AS json_path, 'items' AS parent_path FROM i AS a JOIN i AS b ON a.u = b.u AND a.si = b.ti WHERE a.event_id <> b.v""")
def _(spark, d):
    return _deep(spark, d, True).select("uid", "mismatch_type", "column_name", "source_value", "target_value", _paths())


@query("json_deep_diff", f"""{_items} SELECT CAST(u AS STRING) AS uid, 'missing_in_target' AS mismatch_type, {_at.format('si')} AS column_name, CAST(event_id AS STRING) AS source_value, NULL AS target_value, {_at.format('si')} AS json_path, 'items' AS parent_path FROM i WHERE event_id <> v
    UNION ALL SELECT CAST(u AS STRING), 'extra_in_target', {_at.format('ti')}, NULL, CAST(v AS STRING), {_at.format('ti')}, 'items' FROM i WHERE event_id <> v""")
def _(spark, d):
    return _deep(spark, d, False).select("uid", "mismatch_type", "column_name", "source_value", "target_value", _paths())


_LISTS = "SELECT CAST(o_orderkey AS STRING) AS id, '[' || CAST(o_orderkey AS STRING) || ', ' || CAST(o_custkey AS STRING) || ']' AS a, '[' || CASE WHEN o_orderkey % 10 = 0 THEN '0' ELSE CAST(o_custkey AS STRING) END || ',' || CAST(o_orderkey AS STRING) || ']' AS b FROM {orders}"


@query("structured_cells", "SELECT count(*) FILTER (WHERE NOT (o_orderkey % 10 = 0 AND o_custkey <> 0)) AS matching, count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_custkey <> 0) AS changed, 0 AS missing, 0 AS extra FROM orders")
def _(spark, d):
    df = frame(spark, d, _LISTS)
    return Reconciliation(df, df, ["id"], [Field("a", ("a",), ("b",), "structured")]).status_counts()


# --- files: written to the shared folder and read back -----------------------------------------------


@query("csv_roundtrip_recon", f"WITH {oracle.joined('customer_s', 'customer_t', ['id'], oracle.same(CUSTOMER_CELLS))} {oracle.COUNTS}")
def _(spark, d):
    sides = []
    for n in ("customer_s", "customer_t"):
        load(spark, d, n).drop("n").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path := scratch_path(spark, n))
        sides.append(readers.read_delimited(spark, path))
    return Reconciliation(*sides, ["id"], _plain(*CUSTOMER_CELLS)).status_counts()


@query("multichar_csv_scan", f"SELECT id, name, balance, segment FROM ({oracle.side('customer_s')}) AS x")
def _(spark, d):
    df = load(spark, d, "customer_s").select("id", "name", "balance", "segment")
    lines = df.select(F.concat_ws("||", *df.columns).alias("value"))
    head = spark.sql("SELECT 'id||name||balance||segment' AS value")
    head.unionByName(lines).coalesce(1).write.text(path := scratch_path(spark, "multi"))
    return readers.read_delimited(spark, path, "||", multi_line=False)


@query("orc_roundtrip", "SELECT CAST(r_regionkey AS STRING) AS r_regionkey, r_name FROM region")
def _(spark, d):
    spark.read.parquet(f"{d}/region.parquet").write.orc(path := scratch_path(spark, "orc"))
    return readers.as_text(readers.read_columnar(spark, path, "orc"))


@query("ndjson_roundtrip", f"WITH {oracle.mismatches('customer_s', 'customer_t', ['id'], oracle.same(CUSTOMER_CELLS))} SELECT mismatch_type, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    report.write_ndjson(_customers(spark, d).mismatches(), path := scratch_path(spark, "ndjson"))
    return report.counts_by_type(report.read_ndjson(spark, path))


@query("manifest_diff", "SELECT CAST(p_partkey AS STRING) AS uid, CASE WHEN p_partkey % 9 = 0 THEN 'missing_in_target' ELSE 'value_mismatch' END AS mismatch_type, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'crc32' END AS column_name, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS source_value, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size + 1 AS STRING) END AS target_value FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 8 = 0")
def _(spark, d):
    s = frame(spark, d, "SELECT CAST(p_partkey AS STRING) AS path, p_partkey AS k, 1 AS compressed_size, 2 AS uncompressed_size, p_size AS crc32, 8 AS compress_type FROM {part}")
    t = s.where("k % 9 <> 0").withColumn("crc32", F.expr("CASE WHEN k % 8 = 0 THEN crc32 + 1 ELSE crc32 END"))
    return compare.manifest_diff(s, t)


@query("encrypt_roundtrip", "SELECT r_regionkey AS k, r_name AS name FROM region")
def _(spark, d):
    df = spark.read.parquet(f"{d}/region.parquet")
    key = "0123456789abcdef"
    return df.select(F.col("r_regionkey").alias("k"), report.decrypt(report.encrypt(F.col("r_name"), key), key).alias("name"))


for _name, (_run, _sql) in file_queries.ALL.items():
    query(_name, _sql)(_run)
