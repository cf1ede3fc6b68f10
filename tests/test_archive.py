import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelaw import registry
from gaugelaw.operators.nonlinear import fit_nonlinear
from gaugelaw.sources import readers, sinks


@pytest.mark.parametrize("sep, name", [(",", "a.csv"), (";", "a.txt"), ("\t", "a.tsv"), ("|", "a.csv")])
def test_delimited(spark, tmp_path, sep, name):
    (tmp_path / name).write_text("\ufeffy" + sep + "x\n1.5" + sep + "2\nbad" + sep + "3\n", "utf-8")
    df = readers.numeric(readers.read_table(spark, str(tmp_path / name)), ["y", "x"])
    assert df.columns == ["y", "x"] and [tuple(r) for r in df.collect()] == [(1.5, 2.0), (None, 3.0)]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1}, {"a": 2, "b": 3}]))
    (tmp_path / "c.json").write_text(json.dumps({"a": [1, 2], "b": [3]}))
    for name, want in (("r.json", [(1, None), (2, 3)]), ("c.json", [(1, 3), (2, None)])):
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / name)).select("a", "b").collect()] == want
    with pytest.raises(readers.UnknownFormat):
        readers.read_table(spark, "a.xlsx")


def test_wide_years_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("1880", "1", "2"), ("1881", "***", "2"), ("Year", "a", "b")], "y string, n string, s string")
    assert sorted(tuple(r) for r in readers.wide_years(df, "y", ["n", "s"]).collect()) == [(1880, "n", 1.0), (1880, "s", 2.0)]
    for name in ("one", "two", "none"):
        (tmp_path / name).mkdir()
        if name != "none":
            (tmp_path / name / "run.json").write_text(json.dumps({"task_id": "t", "status": name}))
    assert sorted(r["run_id"] for r in readers.read_runs(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_manifest_lists_no_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="split.indices"):
        sinks.write_manifest(spark.range(1).select(F.struct(F.array("id").alias("indices")).alias("split")), str(tmp_path / "m"))
    sinks.write_manifest(spark.range(1).select(F.lit(3).alias("rows")), str(tmp_path / "n"))


def test_archive_stores_changes_and_repeats_once(spark, tmp_path):
    path = str(tmp_path / "a")
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, v string")
    assert sinks.archive(spark, first, "id", path).count() == 2
    assert sinks.archive(spark, first, "id", path).count() == 2
    assert sinks.archive(spark, spark.createDataFrame([(2, "b")], "id int, v string"), "id", path).filter("id = 2").count() == 2


def test_nonlinear_fit(spark):
    x = np.linspace(0.5, 5, 300)
    rows = spark.createDataFrame([(float(v), float(3 * np.exp(-0.7 * v) + 0.2)) for v in x] + [(None, 1.0)], "x double, y double")
    found, cost = fit_nonlinear(rows, "a*exp(b*x)+c", {"x": F.col("x")}, F.col("y"), {"a": (1.0, 10.0), "b": (-2.0, -0.1), "c": (0.0,)})
    assert cost < 1e-10 and [found[k] for k in "abc"] == pytest.approx([3, -0.7, 0.2], rel=1e-4)
    assert fit_nonlinear(rows.limit(0), "a*x", {"x": F.col("x")}, F.col("y"), {"a": (1.0,)})[1] == np.inf


def test_power_fit(spark):
    got = {r["parameter"]: r["value"] for r in registry.QUERIES["power_fit"](spark, "/root/testdata/sf0.001").collect()}
    assert got["b"] == pytest.approx(1, abs=0.01) and got["c"] == pytest.approx(1, abs=0.1)
