import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.functions.mapping import ColumnMapping
from tallymark.operators import history, report
from tallymark.plans.request import LITMUS, Request, preview, profile, run_batch, validate
from tallymark.sources.scratch import save
from tallymark.streaming.incremental import watch

from .test_sources import FIXED, workbook, write


@pytest.mark.parametrize("delimiter", [",", "||", "\t"])
def test_delimited_pair(spark, tmp_path, delimiter):
    line = lambda *c: delimiter.join(c)
    s = write(tmp_path / "s.csv", "\n".join([line("id", "name", "d"), *[line(str(i), f"n{i}", "2026-01-02") for i in range(1, 30)]]))
    t = write(tmp_path / "t.csv", "\n".join([line("id", "name", "d"), *[line(str(i), "other" if i % 10 == 0 else f"n{i}", "02-Jan-2026") for i in range(3, 32)]]))
    r = validate(spark, Request(s, t, uid="id"))
    assert r.summary == {"missing_in_target": 2, "extra_in_target": 2, "value_mismatch": 2, "value_mismatch_rows": 2} and not r.is_match
    assert (r.source_rows, r.target_rows, r.file_format) == (29, 29, "csv")
    assert r.samples().count() == 6 and "missing_in_target | 2" in r.markdown()
    assert validate(spark, Request(s, s, uid="id")).is_match
    assert validate(spark, Request([s, t], [s, t], uid="id", on_duplicate="last", file_format="csv", delimiter=delimiter)).source_rows == 58
    assert validate(spark, Request(s, t, uid="id", uid_gte="20")).summary["missing_in_target"] == 0


def test_headerless_structured_pair(spark, tmp_path):
    s = write(tmp_path / "s.csv", 'R01|Ann|"[1, 2]"\nR02|Bob|"{1: 2}"\nR03|Cy|x\n')
    t = write(tmp_path / "t.csv", 'R01|Ann|"[2, 1]"\nR02|Bob|"{1: 3}"\nR04|Cy|x\n')
    r = validate(spark, Request(s, t, uid="column_1"))
    assert r.summary == {"missing_in_target": 1, "extra_in_target": 1, "value_mismatch": 1, "value_mismatch_rows": 1}


def test_empty_sides(spark, tmp_path):
    full, none, head, blank = write(tmp_path / "f.csv", "id,v\n1,a\n2,b\n"), write(tmp_path / "e.csv", ""), write(tmp_path / "h.csv", "id,v\n"), write(tmp_path / "b.csv", " \n\n")
    for empty in (none, head, blank):
        assert validate(spark, Request(full, empty, uid="id", file_format="csv")).summary["missing_in_target"] == 2
        assert validate(spark, Request(empty, full, uid="id", file_format="csv")).summary["extra_in_target"] == 2
    assert validate(spark, Request(none, none, uid="id", file_format="csv")).is_match


def test_mapped_litmus_and_keyless(spark, tmp_path):
    s, t = write(tmp_path / "s.csv", "id,first,last\n1,Ann,Lee\n2,Bo,Ray\n"), write(tmp_path / "t.csv", "id,full\n1,Ann Lee\n2,Bo  Ray\n")
    r = validate(spark, Request(s, t, uid="id", column_mappings=(ColumnMapping("name", "full", source_columns=("first", "last")),)))
    assert r.summary["value_mismatch"] == 1
    assert not validate(spark, Request(s, t, uid="id", test_mode=LITMUS)).is_match
    assert validate(spark, Request(s, s)).is_match
    u = write(tmp_path / "u.csv", "id,first,last\n1,Ann,Lee\n1,Ann,Lee\n")
    assert validate(spark, Request(s, u)).summary == {"missing_in_target": 1, "extra_in_target": 1, "value_mismatch": 0, "value_mismatch_rows": 0}


def test_columnar_fixed_json_archive_pairs(spark, tmp_path):
    a = spark.sql("SELECT id, CAST(id AS STRING) AS v FROM range(10)")
    a.write.parquet(f"{tmp_path}/a.parquet")
    a.where("id <> 3").withColumn("v", F.expr("IF(id = 5, 'x', v)")).write.parquet(f"{tmp_path}/b.parquet")
    r = validate(spark, Request(f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet", uid="id"))
    assert (r.summary["missing_in_target"], r.summary["value_mismatch"]) == (1, 1)
    (tmp_path / "w.xlsx").write_bytes(workbook([["id", "v"], [1, "a"]]))
    assert validate(spark, Request(f"{tmp_path}/w.xlsx", f"{tmp_path}/w.xlsx", uid="id", file_format="excel")).is_match
    f, g = write(tmp_path / "f.dat", FIXED), write(tmp_path / "g.dat", FIXED.replace("Name7", "Nome7"))
    r = validate(spark, Request(f, g))
    assert r.file_format == "fixed-width" and r.summary["value_mismatch"] == 1
    j, k = write(tmp_path / "j.json", json.dumps({"a": [1, 2]})), write(tmp_path / "k.json", json.dumps({"a": [2, 1]}))
    assert validate(spark, Request(j, k)).is_match and not validate(spark, Request(j, k, order_sensitive=True)).is_match
    for n in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("a.txt", n)
    assert validate(spark, Request(f"{tmp_path}/x.zip", f"{tmp_path}/y.zip")).summary["value_mismatch"] == 1


def test_batches_previews_profiles(spark, tmp_path):
    s, t = write(tmp_path / "s.csv", "User_ID,Full_Name,Status\n1,a,x\n2,b,y\n"), write(tmp_path / "t.csv", "user id,full name,Account\n1,a,x\n2,b,y\n")
    p = preview(spark, Request(s, t, file_format="csv"))
    assert p["mappings"] == [("User_ID", "user id"), ("Full_Name", "full name")] and p["unmatched_source"] == ["Status"]
    assert profile(spark, s)["rows"] == 2 and profile(spark, s)["label"] == "csv"
    bad = Request(s, t, uid="nope", file_format="csv")
    out = run_batch(spark, [Request(s, s, uid="User_ID"), bad, Request(s, s, uid="User_ID")], stop_on_failure=True)
    assert [o["status"] for o in out] == ["completed", "failed", "skipped"]
    assert [o["status"] for o in run_batch(spark, [bad, Request(s, s, uid="User_ID")])] == ["failed", "completed"]


def test_history(spark, tmp_path):
    runs = spark.createDataFrame([(1, "completed", True, datetime(2026, 1, 1, 5), "a"), (2, "completed", False, datetime(2026, 1, 1, 6), "a"), (3, "failed", False, datetime(2026, 1, 3), "b")], "run_id int, status string, is_match boolean, created_at timestamp_ntz, entity string")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    days = [tuple(r)[1:] for r in history.run_stats(runs, "day", stamp("2026-01-01"), stamp("2026-01-03")).orderBy("bucket").collect()]
    assert days == [(2, 1, 1), (0, 0, 0), (1, 0, 1)]
    assert history.run_stats(runs, "hour", stamp("2026-01-01"), stamp("2026-01-01 23:00:00")).count() == 24
    assert history.stats_unit(datetime(2026, 1, 1), datetime(2026, 1, 2)) == "hour"
    assert [r["run_id"] for r in history.recent(runs, 1, 1).collect()] == [2]
    first = history.entity_insights(runs).where("entity = 'a'").first()
    assert (first["success"], first["failed"], first["total"]) == (1, 1, 2) and [r["run_id"] for r in first["runs"]] == [2, 1]
    assert tuple(history.batch_summary(runs).first()) == (2, 1, 0, 1)
    files = spark.createDataFrame([("ledger_20251231.csv", "tgt_ledger_eur.csv"), ("x/sales_data.csv", None), (None, None)], "source_name string, target_name string")
    known = spark.createDataFrame([("ledger", "General ledger", ["books", "gl"])], "name string, display_name string, aliases array<string>")
    got = {r["source_name"]: (r["entity"], r["confidence"]) for r in history.infer_entities(files, known).collect()}
    assert got == {"ledger_20251231.csv": ("ledger", "medium"), "x/sales_data.csv": ("sales", "low"), None: ("unknown_entity", "low")}
    new = spark.createDataFrame([("Ledger", None, ["accounts"]), ("New Thing", "New", None)], "name string, display_name string, aliases array<string>")
    assert {tuple(map(str, r)) for r in history.upsert_entities(known, new).collect()} == {("ledger", "General ledger", "['accounts', 'books', 'gl']"), ("new_thing", "New", "[]")}
    kept, m = history.delete_runs(runs, runs.select("run_id"), spark.createDataFrame([(1,)], "run_id int"))
    assert (kept.count(), m.count()) == (2, 2)
    # all of a run's mismatches or none
    assert not history.persist_run(runs, runs, f"{tmp_path}/h", cap=2) and history.persist_run(runs, runs, f"{tmp_path}/h", cap=3)
    assert spark.read.parquet(f"{tmp_path}/h/mismatches").count() == 3


def test_history_upkeep(spark, tmp_path):
    runs = spark.createDataFrame([(1, "completed", "p"), (2, "pending", "p"), (3, "failed", "q")], "run_id int, status string, pair_key string")
    found = spark.createDataFrame([(1, "a"), (3, "b")], "run_id int, uid string")
    ids = lambda pair: [sorted(r["run_id"] for r in x.collect()) for x in pair]
    assert ids(history.delete_runs(runs, found, pair="p")) == [[3], [3]] and ids(history.delete_runs(runs, found)) == [[], []]
    drafts = spark.createDataFrame([(1, "z"), (2, "new"), (4, "new")], "run_id int, pair_key string")
    assert {tuple(r) for r in history.save_draft(runs, drafts).collect()} == {(1, "completed", "p"), (3, "failed", "q"), (2, "pending", "new"), (4, "pending", "new")}
    artifact = spark.createDataFrame([("x",), ("y",)], "uid string")
    assert [r["uid"] for r in history.backfill(1, found, artifact).collect()] == ["a"]
    assert {tuple(r) for r in history.backfill(9, found, artifact).collect()} == {(9, "x"), (9, "y")}
    report.write_job(spark, f"{tmp_path}/job", {"state": "done"}, {"is_match": True}, [{"n": 1}, {"n": 2}], {"compare": 0.5})
    assert json.loads((tmp_path / "job/status.json").read_text()) == {"state": "done"} and (tmp_path / "job/batch_results.jsonl").read_text() == '{"n": 1}\n{"n": 2}\n'
    assert (tmp_path / "job/stage_metrics.json").exists() and (tmp_path / "job/result.json").exists()


def test_structured_cells_anywhere(spark, tmp_path):
    """A container literal far down, on the target's side only or on both, makes its column structured."""
    row = lambda i, v: f'{i}|"{v}"'
    s = write(tmp_path / "s.csv", "\n".join(["id|v", *[row(i, "x") for i in range(300)], row(900, "[1, 2]"), row(901, "{1: 2, 3: 4}")]))
    t = write(tmp_path / "t.csv", "\n".join(["id|v", *[row(i, "x") for i in range(300)], row(900, "[2, 1]"), row(901, "{3: 4, 1: 2}")]))
    assert validate(spark, Request(s, t, uid="id")).is_match
    u = write(tmp_path / "u.csv", "\n".join(["id|v", *[row(i, "x") for i in range(300)], row(900, "(a) or (b)"), row(901, "[x")]))
    assert validate(spark, Request(s, u, uid="id")).summary["value_mismatch"] == 2


def test_leading_and_trailing_lines(spark, tmp_path):
    """Lines before the header and after the data are left out, with any column names and quoted delimiters."""
    s = write(tmp_path / "s.csv", 'report,x\n\nid,full name,a-b\n1,"Lee, Ann",x\n2,"say ""hi""",y\nTOTAL,2,\n')
    t = write(tmp_path / "t.csv", 'report,y\n\nid,full name,a-b\n1,"Lee, Ann",x\n2,"say ""hi""",z\nTOTAL,3,\n')
    r = validate(spark, Request(s, t, uid="id", file_format="csv", delimiter=",", header_leading_rows=2, footer_trailing_rows=1))
    assert r.summary == {"missing_in_target": 0, "extra_in_target": 0, "value_mismatch": 1, "value_mismatch_rows": 1} and (r.source_rows, r.target_rows) == (2, 2)
    first = json.loads(r.mismatches.first()["row_detail"])
    assert first["source_record"]["full name"] == 'say "hi"'


def test_sample_limits(spark, tmp_path):
    s = write(tmp_path / "s.csv", "id,v\n" + "".join(f"{i},a\n" for i in range(40)))
    t = write(tmp_path / "t.csv", "id,v\n" + "".join(f"{i},b\n" for i in range(40)))
    r = validate(spark, Request(s, t, uid="id", per_column_limit=3, sample_limit=7))
    assert r.samples().count() == 3 and r.markdown().count("value_mismatch | v") == 7 and set(r.stages) == {"resolve", "compare"}


def test_single_quoted_dialect(spark, tmp_path):
    s = write(tmp_path / "s.csv", "id,v\n1,'a, b'\n2,'c, d'\n3,e\n")
    t = write(tmp_path / "t.csv", "id,v\n1,'a, b'\n2,'c, x'\n3,e\n")
    r = validate(spark, Request(s, t, uid="id", file_format="csv", delimiter=","))
    assert [(x["source_value"], x["target_value"]) for x in r.mismatches.collect()] == [("c, d", "c, x")]


def test_archive_leaves_and_compressed_inputs(spark, tmp_path):
    """The file inside an archive, nested ones too, and inputs of every compression, under auto and a named format."""
    import bz2
    import gzip
    import io
    import lzma
    import tarfile

    import zstandard

    pair = [b"id,v\n1,a\n2,b\n", b"id,v\n1,a\n2,c\n"]
    paths = {}
    for side, data in zip("st", pair, strict=True):
        inner = io.BytesIO()
        with tarfile.open(fileobj=inner, mode="w:gz") as t:
            info = tarfile.TarInfo("deep/data.csv")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        with zipfile.ZipFile(tmp_path / f"{side}.zip", "w") as z:
            z.writestr("readme.md", "no data")
            z.writestr("data.csv", data)
        with zipfile.ZipFile(tmp_path / f"{side}n.zip", "w") as z:
            z.writestr("a.csv", "id,v\n9,9\n")
            z.writestr("inner.tgz", inner.getvalue())
        for end, pack in ((".gz", gzip.compress), (".bz2", bz2.compress), (".zst", zstandard.compress), (".xz", lzma.compress)):
            (tmp_path / f"{side}.csv{end}").write_bytes(pack(data))
    one = {"missing_in_target": 0, "extra_in_target": 0, "value_mismatch": 1, "value_mismatch_rows": 1}
    for name in (".zip", "n.zip"):
        assert validate(spark, Request(f"{tmp_path}/s{name}", f"{tmp_path}/t{name}", uid="id", file_format="csv")).summary == one
    assert validate(spark, Request(f"{tmp_path}/s.zip", f"{tmp_path}/t.zip", uid="id", leaf="d*.csv", file_format="csv")).summary == one
    for end in (".gz", ".bz2", ".zst", ".xz"):
        assert validate(spark, Request(f"{tmp_path}/s.csv{end}", f"{tmp_path}/t.csv{end}", uid="id")).summary == one, end
    assert validate(spark, Request(f"{tmp_path}/s.zip", f"{tmp_path}/t.zip")).file_format == "zip"
    with pytest.raises(ValueError):
        validate(spark, Request(f"{tmp_path}/s.zip", f"{tmp_path}/t.zip", file_format="csv", leaf="*.nope"))


def test_json_lines_that_are_broken_are_named(spark, tmp_path):
    good = write(tmp_path / "g.ndjson", '{"id": 1}\n{"id": 2}\n')
    for line in ('{"v": 1}', '{"id": 3', "[1]", '{"id": null}'):
        bad = write(tmp_path / "b.ndjson", '{"id": 1}\n{"id": 2}\n' + line + "\n")
        with pytest.raises(ValueError, match="target record 3"):
            validate(spark, Request(good, bad, uid="id", file_format="json"))
        assert run_batch(spark, [Request(good, bad, uid="id", file_format="json")])[0]["status"] == "failed"


def test_streaming_target(spark, tmp_path):
    source = save(spark.sql("SELECT CAST(id AS STRING) AS id, 'v' AS v FROM range(10)"), "stream_source")
    spark.sql("SELECT CAST(id AS STRING) AS id, IF(id = 4, 'w', 'v') AS v FROM range(3, 12)").write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("id string, v string").parquet(f"{tmp_path}/in")
    watch(source, arriving, ["id"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["uid"], r["mismatch_type"]) for r in got.collect()} == {("4", "value_mismatch"), ("10", "extra_in_target"), ("11", "extra_in_target")}
