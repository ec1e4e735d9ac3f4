import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.mapping import Field, SideRule
from tallymark.operators import compare, report
from tallymark.operators.reconcile import Reconciliation, multiset_difference, numbered, positional
from tallymark.sources.scratch import Phase, save


def frame(spark, columns, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split(","))) if rows else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns.split(",")))


def counts(r):
    return tuple(r.status_counts().first())


def test_composite_keys(spark):
    s = frame(spark, "region,country,dept,team,emp,name", ("APAC", "IN", "ENG", "ALPHA", "E001", "A"), ("APAC", "IN", "ENG", "ALPHA", "E002", "B"), ("EU", "DE", "X", "Y", "E1", "C"))
    t = frame(spark, "region,country,dept,team,emp,name", ("APAC", "IN", "ENG", "ALPHA", "E001", "A"), ("APAC", "IN", "ENG", "ALPHA", "E002", "Z"))
    r = Reconciliation(s, t, ["region", "country", "dept", "team", "emp"])
    assert counts(r) == (1, 1, 1, 0)
    assert [x["uid"] for x in r.changed_cells().collect()] == ["APAC|IN|ENG|ALPHA|E002"]


def test_pipes_in_keys_do_not_collide(spark):
    s, t = frame(spark, "a,b,v", ("a|b", "c", "1")), frame(spark, "a,b,v", ("a", "b|c", "1"))
    assert counts(Reconciliation(s, t, ["a", "b"])) == (0, 0, 1, 1)


def test_mapping_shapes(spark):
    assert counts(Reconciliation(frame(spark, "id,name", ("1", "x")), frame(spark, "id,full", ("1", " x ")), ["id"], [Field("name", ("name",), ("full",))])) == (1, 0, 0, 0)
    s, t = frame(spark, "id,first,last", ("1", "Ann", "Lee")), frame(spark, "id,full", ("1", "Ann Lee"))
    assert counts(Reconciliation(s, t, ["id"], [Field("n", ("first", "last"), ("full",))])) == (1, 0, 0, 0)
    s, t = frame(spark, "id,phone", ("1", "5"), ("2", "6")), frame(spark, "id,mobile,land", ("1", "5", "5"), ("2", "6", "7"))
    assert counts(Reconciliation(s, t, ["id"], [Field("phone", ("phone",), ("mobile", "land"))])) == (1, 1, 0, 0)


def test_per_side_patterns(spark):
    s, t = frame(spark, "id,m", ("1", "+911234567890")), frame(spark, "id,m", ("1", "1234567890"))
    rule = lambda a, b: [Field("m", ("m",), ("m",), source=SideRule(a), target=SideRule(b))]
    assert counts(Reconciliation(s, t, ["id"], rule(r"^\+91", None))) == (1, 0, 0, 0)
    assert counts(Reconciliation(s, t, ["id"], rule(None, None))) == (0, 1, 0, 0)


def test_sensitive_cells_are_masked_everywhere(spark):
    s, t = frame(spark, "id,ssn", ("1", "111"), ("2", "5")), frame(spark, "id,ssn", ("1", "222"))
    rows = Reconciliation(s, t, ["id"], [Field("ssn", ("ssn",), ("ssn",), sensitive=True)]).mismatches().collect()
    changed = next(r for r in rows if r["column_name"] == "ssn")
    assert (changed["source_value"], changed["target_value"]) == ("****", "****")
    assert not any("111" in r["row_detail"] or "222" in r["row_detail"] for r in rows)


def test_null_keys_meet(spark):
    s, t = frame(spark, "id,v", (None, "1"), (" 7 ", "2")), frame(spark, "id,v", ("N/A", "1"), ("7", "3"))
    assert counts(Reconciliation(s, t, ["id"])) == (1, 1, 0, 0)


def test_duplicates(spark):
    s, t = frame(spark, "id,v,n", ("1", "a", "1"), ("1", "b", "2")), frame(spark, "id,v,n", ("1", "b", "1"), ("1", "b", "2"))
    f = [Field("v", ("v",), ("v",))]
    assert counts(Reconciliation(s, t, ["id"], f)) == (2, 2, 0, 0)
    assert counts(Reconciliation(s, t, ["id"], f, on_duplicate="last", order=["n"])) == (1, 0, 0, 0)
    with pytest.raises(ValueError):
        Reconciliation(s, t, ["id"], f, on_duplicate="error").status_counts()


def test_bad_requests(spark):
    s = frame(spark, "id,v", ("1", "a"))
    for keys, kw in (([], {}), (["no"], {}), (["id"], {"on_duplicate": "guess"}), (["id"], {"fields": [Field("x", ("x",), ("v",))]})):
        with pytest.raises(ValueError):
            Reconciliation(s, s, keys, **kw)


@pytest.fixture(scope="module")
def pair(spark):
    """A generated pair with known differences."""
    rng = random.Random(42)
    s = [(str(i), f"SKU-{i:05}", f"{rng.random() * 1000:.2f}", rng.choice(["north", "süd", "東", None])) for i in range(1, 401)]
    t = [list(r) for r in s[:-20]] + [[str(i), f"SKU-{i:05}", "1.00", "x"] for i in range(401, 411)]
    for r in t[:30]:
        r[2] = "wrong"
    for r in t[10:15]:
        r[3] = "elsewhere"
    rng.shuffle(t)
    return frame(spark, "id,sku,amount,region", *s), frame(spark, "id,sku,amount,region", *[tuple(r) for r in t])


def test_generated_pair(pair):
    r = Reconciliation(*pair, ["id"])
    assert counts(r) == (350, 30, 20, 10)
    assert tuple(r.summary().first()) == (20, 10, 35, 30)
    m = r.mismatches()
    assert {x["mismatch_type"]: x["n"] for x in report.counts_by_type(m).collect()} == {"missing_in_target": 20, "extra_in_target": 10, "value_mismatch": 35}
    assert {x["column_name"]: x["n"] for x in report.counts_by_column(m).collect()} == {"amount": 30, "region": 5}
    assert report.mismatched_rows(m).first()[0] == 30
    assert r.missing().count() == 20 and r.extra().count() == 10 and r.presence_detail("target").count() == 10
    detail = json.loads(m.where("column_name = 'amount'").first()["row_detail"])
    assert detail["target_record"]["amount"] == "wrong" and detail["source_record"]["sku"].startswith("SKU-")


def test_metamorphic_laws(pair):
    s, t = pair
    assert counts(Reconciliation(s, s, ["id"])) == (400, 0, 0, 0)
    a, b = counts(Reconciliation(s, t, ["id"])), counts(Reconciliation(t, s, ["id"]))
    assert a[:2] == b[:2] and a[2:] == (b[3], b[2])
    assert counts(Reconciliation(s.repartition(7), t.orderBy("sku").coalesce(1), ["id"])) == a
    assert a[0] + a[1] + a[2] == s.count()


def test_samples(pair):
    m = Reconciliation(*pair, ["id"]).mismatches(details=False)
    per = report.sample_per_column(m, 3).collect()
    assert sorted(r["column_name"] for r in per) == ["amount"] * 3 + ["region"] * 3
    assert [r["column_name"] for r in report.sample_stratified(m, 12).collect()].count("region") == 5
    assert report.sample_grouped(m, 4).count() == 16
    mixed = {r["mismatch_type"]: r["n"] for r in report.counts_by_type(report.sample_mixed(m, 9)).collect()}
    assert mixed == {"missing_in_target": 3, "extra_in_target": 3, "value_mismatch": 3}
    assert report.page(m, 10, 60).count() == 5 and report.page(m, 100, 0, "extra_in_target").count() == 10
    assert report.dedupe(m.unionByName(m)).count() == 65
    assert Reconciliation(pair[0], pair[0], ["id"]).match_samples(2).count() == 6 and Reconciliation(*pair, ["id"]).match_samples(2).count() == 0


@pytest.mark.parametrize(("sizes", "limit", "want"), [((5, 0, 100), 10, (5, 0, 5)), ((1, 1, 1), 10, (1, 1, 1)), ((9, 9, 9), 2, (1, 1, 0)), ((0, 9, 9), 1, (0, 1, 0)), ((3, 50, 50), 30, (3, 14, 13)), ((0, 0, 0), 5, (0, 0, 0)), ((4, 4, 4), 0, (0, 0, 0))])
def test_category_budget(sizes, limit, want):
    assert report.category_budget(*sizes, limit) == want


def test_summaries_and_markdown():
    assert report.merge_summaries({"missing": 3, "changed": 2}, {"missing_in_target": 1, "value_mismatch_cells": 7}) == {"missing_in_target": 3, "extra_in_target": 0, "value_mismatch": 7, "value_mismatch_rows": 2}
    assert "| a\\|b |" in report.markdown({"missing": 1}, samples=[{"uid": "a|b", "v": None}])
    assert (report.snippet_limit(None), report.snippet_limit(99), report.snippet_limit(0), report.snippet_budget(10, 3)) == (10, 50, 1, 50)


def test_files_of_mismatches(pair, spark, tmp_path):
    m = Reconciliation(*pair, ["id"]).mismatches()
    report.write_ndjson(m, f"{tmp_path}/out")
    back = report.read_ndjson(spark, f"{tmp_path}/out")
    assert sorted(map(str, back.collect())) == sorted(map(str, m.collect()))
    bare = m.withColumn("row_detail", F.lit(None).cast("string"))
    filled = report.enrich(bare, *pair, ["id"])
    assert filled.where("row_detail IS NULL").count() == 0 and filled.count() == 65


def test_multisets_and_positions(spark):
    s, t = frame(spark, "a,b", ("1", "x"), ("1", "x"), ("2", None)), frame(spark, "a,b", ("1", "x"), ("2", None), ("3", "z"))
    got = {(r["a"], r["source_count"], r["target_count"], r["mismatch_type"]) for r in multiset_difference(s, t, ["a", "b"]).collect()}
    assert got == {("1", 2, 1, "missing_in_target"), ("3", 0, 1, "extra_in_target")}
    rows = positional(s, t, [Field("b", ("b",), ("b",))], ["a", "b"]).collect()
    assert sorted((r["uid"], r["mismatch_type"]) for r in rows) == [("1", "value_mismatch"), ("2", "value_mismatch")]
    many = spark.range(0, 1000).repartition(13)
    assert sorted((r["id"], r["_row"]) for r in numbered(many, ["id"]).collect()) == [(i, i) for i in range(1000)]


def test_digests(pair):
    s, t = pair
    cols = ["sku", "amount", "region"]
    assert compare.identical(s, s.repartition(5), ["id"], cols) and not compare.identical(s, t, ["id"], cols)
    a, b = (compare.digest(x, ["id"], cols, 8) for x in (s, t))
    assert compare.unlike_partitions(a, a).count() == 0 and 0 < compare.unlike_partitions(a, b).count() <= 8
    # pairs of equal rows cancel in the xor alone
    aab, ccb = s.limit(1).unionByName(s.limit(1)).unionByName(s.where("id = 9")), s.where("id = 5").unionByName(s.where("id = 5")).unionByName(s.where("id = 9"))
    x, y = compare.digest(aab, ["id"], cols).first(), compare.digest(ccb, ["id"], cols).first()
    assert x["xor_digest"] == y["xor_digest"] and x != y


def test_schema_and_litmus(spark, pair):
    s = spark.createDataFrame([(1, 2.0)], "id long, v double")
    t = spark.createDataFrame([(1, "2")], "id int, w string")
    got = {(r["column_name"], r["issue"]) for r in compare.schema_diff(compare.schema_frame(s), compare.schema_frame(t)).collect()}
    assert got == {("id", "type_mismatch"), ("v", "missing_in_target"), ("w", "extra_in_target")}
    assert {r["issue"] for r in compare.schema_diff(compare.schema_frame(s), compare.schema_frame(t), True, {"v": "w"}).collect()} == {"type_mismatch"}
    assert tuple(compare.litmus(*pair).first()) == (400, 390, False, True)
    with pytest.raises(ValueError):
        compare.parsed_enough(0, 1 << 20)


def test_plan_has_one_exchange_a_side(pair):
    """The fused join shuffles each side once and runs no Python."""
    plan = Reconciliation(*pair, ["id"]).mismatches()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") <= 2


def test_repeated_keys_in_pairs_do_not_multiply(spark):
    """Hot and null keys: the first meets the first; what is left over is missing or extra."""
    rows = lambda n, v: spark.createDataFrame([(None, f"{v}{i % 3}") for i in range(n)] + [("k", "x")], "id string, v string")
    r = Reconciliation(rows(300, "a"), rows(310, "a"), ["id"], on_duplicate="pair", order=["v"])
    c = r.status_counts().first()
    assert c["missing"] == 0 and c["extra"] == 10 and c["matching"] + c["changed"] == 301


def test_last_rows_share_the_joins_exchange(spark):
    """Rows are dealt by key once a side, for the last row and for the join."""
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "id string, v string").repartition(3)
    r = Reconciliation(df, df.withColumn("v", F.lit("2")), ["id"], on_duplicate="last")
    assert tuple(r.status_counts().first()) == (1, 1, 0, 0)
    plan = r.joined()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_files_by_content(spark, tmp_path):
    for side, data in (("s", b"one"), ("t", b"one"), ("u", b"two"), ("v", b"three")):
        (tmp_path / side).mkdir()
        (tmp_path / side / f"{side}.txt").write_bytes(data)
    same = [compare.identical_files(spark, f"{tmp_path}/s", f"{tmp_path}/{x}") for x in "tuv"]
    assert same == [True, False, False]


def test_tables_of_a_phase_are_deleted(spark):
    from pathlib import Path

    with Phase(spark) as outer:
        with Phase(spark) as phase:
            kept, gone = phase.keep(save(spark.range(3), "kept")), save(spark.range(4), "gone")
            assert gone.count() == 4
        path = lambda df: Path(df._scratch_path.removeprefix("file://").removeprefix("file:"))
        assert path(kept).exists() and not path(gone).exists() and kept.count() == 3
        with pytest.raises(ZeroDivisionError), Phase(spark):
            broken = save(spark.range(1), "broken")
            1 / 0  # noqa: B018
        assert not path(broken).exists()
    assert not path(kept).exists() and outer.kept == set() and not Phase.stack()
