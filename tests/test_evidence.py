"""Evidence, contract, texts, readers and sinks against small tables made by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from gaugelaw.functions import text
from gaugelaw.operators import contract, evidence, gates
from gaugelaw.plans import split
from gaugelaw.sources import readers, sinks


def test_allocate_skips_numbers_in_use(spark):
    new = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "prefix string, at int")
    used = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 4), ("a", 9), ("c", 1)], "prefix string, number long")
    got = sorted((r["prefix"], r["at"], r["number"]) for r in evidence.allocate(new, used, "prefix", ["at"]).collect())
    assert got == [("a", 0, 2), ("a", 1, 5), ("a", 2, 6), ("a", 3, 7), ("a", 4, 8), ("b", 1, 1)]
    assert evidence.allocate(new, used.limit(0), "prefix", ["at"]).filter("prefix = 'a'").agg(F.max("number")).first()[0] == 5


def test_manifest_and_orphans(spark):
    was = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", None)], "run_id int, rel_path string, sha256 string")
    now = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (3, "a", "q")], "run_id int, rel_path string, sha256 string")
    got = {(r["run_id"], r["rel_path"]): r["status"] for r in evidence.manifest_status(was, now, ["run_id", "rel_path"]).collect()}
    assert got == {(1, "a"): "equal", (1, "b"): "mismatched", (2, "a"): "missing", (3, "a"): "untracked"}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = {(r["id"], r["kind"]) for r in evidence.orphans(ids(1, 2), ids(2, 3), ids(1, 2, 4), "id").collect()}
    assert got == {(1, "run_not_indexed"), (1, "evidence_not_indexed"), (3, "indexed_without_run"), (3, "indexed_without_evidence"), (4, "evidence_not_indexed")}
    paths = spark.createDataFrame([(1, "root/a"), (2, "root/../b"), (3, "rooted/c"), (4, "root"), (5, None)], "id int, path string")
    got = {r["id"]: r["removable"] for r in evidence.prunable(paths, ids(9), "id", "path", "root").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_classes_and_sessions(spark):
    names = ["agent-x", "cli-y", "refcheck-1", "variant-z", "reference-q", "foo-cand12", "other", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(r["kind"], r["owned"]) for r in rows.select(evidence.classify(F.col("name")).alias("kind"), evidence.owned(F.col("name")).alias("owned")).collect()]
    assert got == [("agent", False), ("cli", False), ("fixture", True), ("fixture", True), ("reference", False), ("candidate", True), ("unclassified", False), ("unclassified", False)]
    ledger = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 2), ("s2", 3), ("s3", 9)], "session string, seq int")
    best = evidence.best_session(spark.createDataFrame([(2,), (1,), (3,)], "seq int"), ledger, ["seq"], "session").collect()
    assert [tuple(r) for r in best] == [("s1", 2, 2)]  # of equals the first by name


def test_texts(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert row(text.pairs(F.lit(" a = 1,b=x=y, ,=3,a=2"))) == {"a": "2", "b": "x=y"} and row(text.pairs(F.lit(""))) == {}
    for x, want in ((123456789.0, 123457000.0), (-0.000123456789, -0.000123457), (0.0, 0.0), (math.inf, math.inf), (1.0, 1.0)):
        assert row(text.significant(F.lit(x))) == pytest.approx(want, rel=1e-12)
    assert row(text.cell(F.lit(None).cast("string"))) == "" and row(text.cell(F.lit(True), "boolean")) == "1"
    assert row(text.powers_in(F.lit("a ** 2 + b^3 + a**2 + c**x"))) == ["a**2", "b**3"]
    paths = {"src/a.py": True, "a.md": True, "https://x.io/a.md": False, "docs/x": True, "word": False, "two words.md": False, "": False}
    assert {p: row(text.is_repo_path(F.lit(p))) for p in paths} == paths
    assert row(text.steps_of(F.array(*map(F.lit, (1.0, 4.0, 2.0))))) == [3.0, -2.0] and row(text.steps_of(F.array(F.lit(1.0)))) == []


def test_contract_of_cells(spark):
    tasks = spark.createDataFrame([("t", ["x"], ["y", "x"], 3, {"x": [0.0, 5.0]}), ("none", ["x"], ["y"], 0, {}), ("two", ["x"], ["x", "x"], 2, {})], "task_id string, var_names array<string>, header array<string>, sample_count int, sampling map<string,array<double>>")
    lines = spark.createDataFrame([("t", 1, ["1", " 2 "]), ("t", 2, [" ", ""]), ("t", 3, ["NaN", "9"]), ("t", 4, ["x", "2", "3"]), ("t", 5, ["q", "2"]), ("two", 1, ["1", "1"]), ("two", 2, ["2", "1"])], "task_id string, line_no int, cells array<string>")
    got = {(r["task_id"], r["code"]) for r in contract.cell_findings(tasks, lines, least=3, enough=10).collect()}
    assert {c for t, c in got if t == "t"} == {"CSV_NONFINITE", "CSV_RAGGED", "CSV_NON_NUMERIC", "CSV_BELOW_MIN", "SAMPLE_COUNT_MISMATCH", "SAMPLING_MISMATCH"}
    assert {c for t, c in got if t == "none"} == {"EMPTY_CSV", "CSV_MISSING_COL"}
    assert {c for t, c in got if t == "two"} == {"CSV_DUP_COL", "CSV_MISSING_Y", "CSV_TOO_FEW", "CONSTANT_COL"}
    bad = [tuple(r) for r in contract.first_bad_cells(tasks, lines, most=2).orderBy("task_id", "line_no").collect()]
    assert bad == [("t", 2, "y", ""), ("t", 2, "x", "")]
    assert [r["code"] for r in contract.set_findings(None, tasks, tasks, tasks, tasks).collect()] == ["MISSING_TASKS_ROOT"]


def test_gates_take_errors_as_rows(spark):
    seg = spark.range(300).select((F.col("id") + 1.0).alias("x"), ((F.col("id") + 1.0) * 2).alias("y"), F.when(F.col("id") % 3 == 0, "holdout").when(F.col("id") > 280, "extrapolation").otherwise("train").alias("segment"))
    box = seg.agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
    candidates = {"k": gates.Candidate("k*x", "k"), "bad": gates.Candidate("x.y"), "long": gates.Candidate("x" + "+x" * 1500), "off": gates.Candidate("3*x")}
    got = {r["candidate"]: (r["verdict"], r["failed"], r["hint"]) for r in gates.report(gates.verify(seg, candidates, {"x": F.col("x")}, {"x": "m", "y": "m"}, box, {})).collect()}
    assert got == {"k": ("accepted", "", "passed"), "bad": ("rejected", "dimension,expression", "syntax"), "long": ("rejected", "dimension,expression", "syntax"), "off": ("rejected", "holdout,extrapolation", "revise")}
    free = gates.verify(seg, candidates, {"x": F.col("x")}, {"x": "m", "y": "m"}, box, {}, dimension=False)
    assert {r["mode"] for r in free.filter("name = 'dimension'").collect()} == {"disabled"}


def test_readers(spark, tmp_path):
    (tmp_path / "z.csv").write_text("year,a,b\n1880,1,2\n1881, 3 ,4\n1882,5\n1883,x,1\n")
    assert sorted((r["year"], r["bands"]) for r in readers.read_zonal(spark, str(tmp_path / "z.csv"), 2).collect()) == [(1880, [1.0, 2.0]), (1881, [3.0, 4.0])]
    content = b"1 2\t3\n  4 5 6 \n7 8\n\n9 a 1\n"
    (tmp_path / "f.dat").write_bytes(content)
    rows = readers.read_fixed(spark, str(tmp_path / "f.dat"), ["a", "b", "c"], hashlib.sha256(content).hexdigest())
    assert sorted(map(tuple, rows.collect())) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    with pytest.raises(readers.WrongDigest):
        readers.read_fixed(spark, str(tmp_path / "f.dat"), ["a"], "0" * 64)
    wide = spark.createDataFrame([("1880", "1", "2"), ("note", "1", "2"), ("1881", "***", "2")], "Year string, `24S-24N` string, b string")
    assert [tuple(r) for r in readers.wide_years(wide, "Year", {"24S-24N": "tropics", "b": "north"}).orderBy("band").collect()] == [(1880, "north", 2.0), (1880, "tropics", 1.0)]
    with pytest.raises(readers.TooFewRows):
        readers.wide_years(wide, "Year", ["b"], least=3)
    (tmp_path / "task").mkdir()
    (tmp_path / "task/data.csv").write_text("y,x\n1,2\n")
    with pytest.raises(FileNotFoundError):
        readers.read_task(spark, str(tmp_path / "task"))
    (tmp_path / "task/meta.json").write_text('{"task_id": "t",\n "var_names": ["x"]}')
    data, meta = readers.read_task(spark, str(tmp_path / "task"))
    assert data.columns == ["y", "x"] and meta.first()["var_names"] == ["x"]
    (tmp_path / "s.jsonl").write_text('{"schema": "other@1", "task_id": "t", "checks": [{"kind": "sign"}]}\n')
    with pytest.raises(Exception, match="another schema"):
        readers.read_specs(spark, str(tmp_path / "s.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"task_id": "t", "candidates": ["x*2", {"formula": "k*x", "parameters": {"k": 3}}]}\n')
    got = [(r["formula"], r["parameters"]) for r in readers.read_candidates(spark, str(tmp_path / "c.jsonl")).orderBy("place").collect()]
    assert got == [("x*2", None), ("k*x", {"k": 3.0})]


def test_sinks(spark, tmp_path):
    seg = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.md5(F.col("id").cast("string")).alias("tie"))
    seg = split.three_way(seg, "x", F.col("tie"), 3)
    sinks.write_split(seg, "x", str(tmp_path / "m"))
    held = spark.read.json(str(tmp_path / "m"))
    assert {r["status"] for r in sinks.split_drift(seg, held).collect()} == {"equal"}
    assert {r["segment"]: r["status"] for r in sinks.split_drift(seg.filter("x <> 50 and segment <> 'extrapolation'"), held).collect()}["extrapolation"] == "missing"
    with pytest.raises(ValueError, match="may not list rows"):
        sinks.write_manifest(spark.range(1).select(F.create_map(F.lit("a"), F.array("id")).alias("indices")), str(tmp_path / "bad"))
    for n, value in ((1, 1), (2, 2), (2, 3), (1, 4)):
        sinks.append_round(spark.createDataFrame([(value,)], "v int"), n, str(tmp_path / "rounds"))
    assert [(r["round"], r["v"]) for r in spark.read.json(str(tmp_path / "rounds")).collect()] == [(1, 4)]
