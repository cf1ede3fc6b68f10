"""Generated rows made alone and together, laws that verify, blinded tables, formulas on probe points."""

import pytest
from pyspark.sql import functions as F

from gaugelaw.operators import batch, equality
from gaugelaw.sources import generate


def test_any_row_can_be_made_alone(spark):
    whole = {(r["task_id"], r["row"]): (r["x"], r["y"], r["tie"]) for r in generate.law_rows(spark.range(50).repartition(4), "id", noise=0.01).collect()}
    assert len(whole) == 50 * len(generate.LAWS) == 1100
    for r in generate.law_rows(spark.range(17, 18), "id", noise=0.01).collect():
        assert whole[r["task_id"], 17] == (r["x"], r["y"], r["tie"])
    ranges = {w.name: list(w.variables.values()) for w in generate.LAWS}
    assert all(lo < v < hi for (t, _), (x, *_) in whole.items() for v, (_, lo, hi) in zip(x, ranges[t], strict=True))
    assert generate.law_rows(spark.range(0), "id").collect() == []
    with pytest.raises(generate.UnknownConstant):
        generate.law_rows(spark.range(1), "id", [generate.Law("x", "q*a", "m", {"a": ("m", 0.0, 1.0)})])


def test_laws_pass_their_own_gates(spark):
    """Laws of a constant to be fitted, with units, against wrong ones, all in one batch."""
    laws = [w for w in generate.LAWS if w.name in ("gravitation", "hydrogen-level", "energy-shift", "radioactive-decay")]
    rows = generate.law_rows(spark.range(120), "id", laws)
    tasks = generate.law_tasks(spark, laws)
    right = tasks.select("task_id", F.lit("law").alias("candidate"), "formula", F.map_keys("constants").alias("free"))
    wrong = tasks.select("task_id", F.lit("wrong").alias("candidate"), F.concat(F.lit("("), "formula", F.lit(")*"), F.get("var_names", F.lit(0))).alias("formula"), F.map_keys("constants").alias("free"))
    got = {(r["task_id"], r["candidate"]): r["verdict"] for r in batch.report(batch.verify(rows, tasks, right.unionByName(wrong), dimension=False)).collect()}
    assert {k: v for k, v in got.items() if k[1] == "law"} == {(w.name, "law"): "accepted" for w in laws}
    assert got["gravitation", "wrong"] == got["radioactive-decay", "wrong"] == "rejected"


def test_noise_is_even_and_normal(spark, tmp_path):
    rows = generate.noise_rows(spark.range(4000), "id")
    m = {r["scenario"]: r for r in rows.groupBy("scenario").agg(F.avg("y").alias("m"), F.stddev("y").alias("s"), F.avg("x1").alias("x"), F.corr("x1", "y").alias("c"), F.count_distinct("task_id").alias("sets")).collect()}
    assert {s: r["sets"] for s, r in m.items()} == {"A": 10, "B": 50}
    assert all(abs(r["m"]) < 0.06 and abs(r["s"] - 1) < 0.05 and abs(r["x"] - 5.5) < 0.15 and abs(r["c"]) < 0.06 for r in m.values())
    generate.write_noise(rows, str(tmp_path))
    meta = {r["task_id"]: r["sample_count"] for r in spark.read.json(f"{tmp_path}/meta").collect()}
    assert meta == {r["task_id"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/data").groupBy("task_id").count().collect()}


def test_blinding(spark):
    tasks = spark.createDataFrame([("phys-a", "falls", {"m": "kg"}, 3), ("phys-b", "turns", {}, 4)], "task_id string, phenomenon string, units map<string,string>, n int")
    specs = spark.createDataFrame([("phys-a", "note on phys-a", {"phys-a": 1.0}, 7)], "task_id string, physics_note string, by_task map<string,double>, k int")
    blinded, others = generate.blind(tasks, {"specs": specs})
    assert blinded.columns == ["task_id", "units", "n"] and all(r["task_id"].startswith("t-") for r in blinded.collect())
    row = others["specs"].first()
    assert row["physics_note"] == "blinded" and list(row["by_task"]) == [row["task_id"]] and row["k"] == 7
    assert generate.blind(tasks, {}, strict=True)[0].columns == ["task_id", "n"]
    with pytest.raises(Exception, match="no such task"):
        generate.blind(tasks, {"specs": specs.withColumn("task_id", F.lit("phys-z"))})[1]["specs"].collect()


def test_alias_collision(spark, monkeypatch):
    monkeypatch.setattr(generate, "alias", lambda c: F.lit("t-1"))
    with pytest.raises(generate.Collision):
        generate.blind(spark.createDataFrame([("a",), ("b",)], "task_id string"), {})


def test_equality(spark):
    box = {"x": [1.0, 100.0], "y": [-1.0, 1.0]}
    pairs = [("same", "x*y+x", "x*(y+1)"), ("near", "x+1e-8*x", "x"), ("off", "x+1e-4", "x"), ("undefined", "sqrt(y)", "sqrt(y)"), ("name", "x*z", "x"), ("zero", "y-y", "0*x"), ("constant", "k*x", "x*k"), ("null", None, "x")]
    df = spark.createDataFrame([(n, a, b, box, {"k": 2.0}) for n, a, b in pairs], "id string, formula string, reference string, sampling map<string,array<double>>, parameters map<string,double>")
    got = {r["id"]: (r["equal"], r["undefined"]) for r in equality.compare(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"same": True, "near": True, "off": False, "undefined": False, "name": False, "zero": True, "constant": True, "null": False}
    assert got["name"][1] == got["null"][1] == 259 and 0 < got["undefined"][1] < 259
    assert equality.compare(df.limit(0)).collect() == []


def test_points_are_compared_where_the_pair_lies(spark):
    """A pair stays one row, and its difference is that of a plain loop's points."""
    from gaugelaw.operators import equality

    pairs = spark.createDataFrame([("same", "a*b", "b*a"), ("off", "a*b*1.5", "a*b"), ("root", "sqrt(a-2)", "a"), ("none", "a*(", "a")], "id string, formula string, reference string")
    pairs = pairs.selectExpr("*", "map('a', array(1D, 3D), 'b', array(0D, 4D)) as sampling", "cast(map() as map<string,double>) as parameters")
    found = equality.compare(pairs)
    assert not {"Generate", "HashAggregate"} & set(found._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    got = {r["id"]: (r["deviation"], r["undefined"], r["equal"]) for r in found.collect()}
    at = [3**0.5, 1.0, 3.0] + [3 ** ((i * 2**0.5) % 1) for i in range(1, 257)]
    assert got["same"] == (0, 0, True) and got["off"] == (0.5, 0, False) and got["none"] == (None, 259, False)
    assert got["root"][1] == sum(a < 2 for a in at)
