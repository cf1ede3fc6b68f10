"""Rechecks, nested differences, running sums, covers and late rows: what the queries' tables do not have."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugelaw.operators import evidence, nested_diff, recheck
from gaugelaw.plans import running, split
from gaugelaw.sources import readers
from gaugelaw.streaming import archive


def test_flatten(spark):
    docs = [
        (1, '{"a": 1.00000049, "b": [1, 2.5, {"c": "x"}], "e": {}, "n": null, "d/e[0]": true, "big": 123456789012, "tiny": 1.23456789e-20}'), (2, "[[1, [2]], []]"), (3, "{"), (4, None), (5, '"text"'), (None, "7"),
    ]
    got = {(r["id"], r["path"], r["kind"], r["value"]) for r in nested_diff.flatten(spark.createDataFrame(docs, "id int, j string"), ["id"], "j").collect()}
    assert got == {
        (1, "/a", "number", "1"), (1, "/b", "length", "3"), (1, "/b[0]", "number", "1"), (1, "/b[1]", "number", "2.50000e+00"), (1, "/b[2]/c", "text", "x"), (1, "/e", "object", None), (1, "", "object", None), (1, "/b[2]", "object", None), (1, "/n", "null", None), (1, r"/d\/e\[0\]", "boolean", "true"),
        (1, "/big", "number", "123456789012"), (1, "/tiny", "number", "1.23457e-20"), (2, "", "length", "2"), (2, "[0]", "length", "2"), (2, "[0][0]", "number", "1"), (2, "[0][1]", "length", "1"), (2, "[0][1][0]", "number", "2"), (2, "[1]", "length", "0"),
        (3, "", "broken", None), (4, "", "broken", None), (5, "", "text", "text"), (None, "", "number", "7"),
    }


def plain_diff(a, b, path=""):
    """The same by recursion over Python values: (path, finding)."""
    if isinstance(a, dict) and isinstance(b, dict):
        for k in a.keys() | b.keys():
            if k not in a or k not in b:
                yield f"{path}/{k}", "missing" if k in a else "added"
            else:
                yield from plain_diff(a[k], b[k], f"{path}/{k}")
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            yield path, "length"
        else:
            for i, (x, y) in enumerate(zip(a, b)):
                yield from plain_diff(x, y, f"{path}[{i}]")
    elif type(a) is not type(b):
        yield path, "retyped"
    elif a != b:
        yield path, "changed"


def test_diff_against_recursion(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randint(0, 5 if depth else 2)
        return {0: rng.randint(0, 2), 1: rng.choice("xy"), 2: True}.get(kind) if kind < 3 else [value(depth - 1) for _ in range(rng.randint(1, 3))] if kind == 3 else {k: value(depth - 1) for k in rng.sample("abcd", rng.randint(1, 3))}

    def changed(v):
        if rng.random() < 0.15:
            return rng.choice([5, "z", False, [], {}, [1], {"a": 1}])
        if isinstance(v, dict):
            return {k: changed(x) for k, x in v.items() if rng.random() > 0.1} | ({"new": 1} if rng.random() < 0.2 else {})
        if isinstance(v, list):
            return [changed(x) for x in v] + ([1] if rng.random() < 0.15 else [])
        return v

    pairs = []
    for i in range(80):
        a = {"environment": value(2), "r": value(4), "s": value(3)}
        pairs.append((i, a, changed(a)))
    a, b = (spark.createDataFrame([(p[0], json.dumps(p[side])) for p in pairs], "id int, j string") for side in (1, 2))
    got = {(r["id"], r["path"], r["finding"]) for r in nested_diff.diff(a, b, ["id"], "j").collect()}
    assert got == {(i, *x) for i, p, q in pairs for x in plain_diff(p, q)}
    parts = nested_diff.diff(a, b, ["id"], "j").groupBy("part").agg(F.bool_and(F.col("path").startswith("/environment")).alias("e"), F.bool_or(F.col("path").startswith("/environment")).alias("o")).collect()
    assert {r["part"]: (r["e"], r["o"]) for r in parts} == {"environment": (True, True), "conclusion": (False, False)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums(spark, partitions):
    """A group with nearly all rows, null groups, ties and one row."""
    rng = random.Random(5)
    rows = [("hot", i % 400, rng.randint(-3, 9)) for i in range(1000)] + [(None, i, 1) for i in range(30)] + [("one", 1, 5)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = defaultdict(list)
    for r in running.running_sum(df, ["g"], ["o", "v"], F.col("v"), "s", partitions).collect():
        got[r["g"]].append((r["o"], r["v"], r["s"]))
    for g in ("hot", None, "one"):
        total, want = 0, []
        for o, v in sorted((o, v) for k, o, v in rows if k == g):
            total += v
            want.append((o, v, total))
        assert sorted(got[g]) == sorted(want)
    ranks = running.rank_within(df.filter("g = 'hot'"), ["g"], ["o"], "k", partitions).select("k").collect()
    assert sorted(r["k"] for r in ranks) == list(range(1, 1001))


def test_allocation_against_a_loop(spark):
    rng = random.Random(2)
    used = [(p, n) for p in "abc" for n in rng.sample(range(1, 60), 25)] + [("a", 200)]
    new = [(rng.choice("abd"), f"{i:03d}") for i in range(120)]
    got = evidence.allocate(spark.createDataFrame(new, "p string, id string"), spark.createDataFrame(used, "p string, number long"), "p", ["id"])
    want, taken = {}, {(p, n) for p, n in used}
    for p, i in sorted(new, key=lambda x: x[1]):
        n = next(n for n in range(1, 400) if (p, n) not in taken)
        taken.add((p, n))
        want[p, i] = n
    assert {(r["p"], r["id"]): r["number"] for r in got.collect()} == want


def test_lookup_with_a_key_twice(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    table = spark.createDataFrame([(1, "y"), (1, "x")], "id int, found string")
    assert {(r["k"], r["r"]) for r in evidence.resolve(rows, [(table, "k", "found")], "r", F.lit("none")).collect()} == {(1, "x"), (2, "none")}


def test_cover(spark):
    data = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "id int")
    parts = {"train": spark.createDataFrame([(1,), (2,), (5,), (5,)], "id int"), "holdout": spark.createDataFrame([(2,), (9,), (4,)], "id int")}
    assert {(r["id"], r["finding"], r["segments"]) for r in split.cover(data, parts, "id").collect()} == {(2, "overlap", "holdout,train"), (3, "gap", ""), (9, "stranger", "holdout")}


def test_late_rows_over_several_calls(spark, tmp_path):
    """A stream that goes on with its own state: nothing twice, numbers go on, changed rows are new, rows without a time are late."""
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(rows, "id long, t string, v string").select("id", F.to_timestamp("t").alias("t"), "v").coalesce(1).write.mode("append").parquet(inbox)
        held = archive.archive_all(archive.read_stream(spark, inbox, files=1), "id", "t", path, f"{path}/state", 60)
        return {(r["id"], r["v"]): (r["bucket"], r["run_name"], r["batch"]) for r in held.collect()}

    first = put((1, at(10), "a"), (2, at(20), "b"), (2, at(20), "b"))
    assert {k: v[::2] for k, v in first.items()} == {(1, "a"): ("on_time", 0), (2, "b"): ("on_time", 0)}
    second = put((1, at(10), "a"), (1, at(10), "changed"), (3, at(19), "edge"), (4, None, "no time"), (5, at(30), "new"))
    assert {k: second[k] for k in first} == first and len(second) == 6
    assert {k[1]: v[0] for k, v in second.items() if v[2] == 1} == {"changed": "late", "edge": "on_time", "no time": "late", "new": "on_time"}
    assert sorted(v[1] for v in second.values()) == ["20240101_0001", "20240101_0002", "20240101_0003", "20240101_0004", "20240101_0005", "undated_0001"]


def test_names_of_a_day_with_over_9999_rows(spark, tmp_path):
    """A name keeps all digits of its number."""
    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10_050).select("id", F.to_timestamp(F.lit("2024-01-01 00:10:00")).alias("t")).coalesce(1).write.parquet(inbox)
    held = archive.archive_all(archive.read_stream(spark, inbox, files=1), "id", "t", path, f"{path}/state", 60)
    assert {r["run_name"] for r in held.collect()} == {f"20240101_{n:04d}" for n in range(1, 10_051)}


def test_recheck_is_written(spark, tmp_path):
    runs = spark.createDataFrame([("a", "agree", True), ("b", "disagree", False), ("c", "out-of-scope", False)], "run_id string, status string, deterministic boolean")
    checks = spark.createDataFrame([("a", "holdout", True, True, 0.0)], "run_id string, name string, was boolean, now boolean, difference double")
    recheck.write(runs, checks, str(tmp_path))
    assert {(r["run_id"], len(r["checks"] or [])) for r in spark.read.json(f"{tmp_path}/runs").collect()} == {("a", 1), ("b", 0), ("c", 0)}
    assert {(r["status"], r["n"], r["in_scope"], r["recompute_rate"]) for r in spark.read.json(f"{tmp_path}/summary").collect()} == {("agree", 1, 2, 0.5), ("disagree", 1, 2, 0.5), ("out-of-scope", 1, 2, 0.5)}
    assert recheck.summary(runs.filter("status = 'out-of-scope'")).first()["recompute_rate"] == 0


def test_run_folders(spark, tmp_path):
    """Runs with and without checks, a folder without run.json, a check file that is none, an unknown task."""
    for run, meta, checks in (("r1", {"task_id": "t", "verdict": "accepted"}, [{"name": "fit", "passed": True, "metrics": {"a": 1}}, {"name": "holdout", "passed": False}, [1]]), ("r2", {"verdict": "rejected"}, []), ("r3", None, [{"name": "fit", "passed": True}])):
        folder = tmp_path / "runs" / run
        (folder / "checks").mkdir(parents=True)
        if meta:
            (folder / "run.json").write_text(json.dumps(meta))
        for i, c in enumerate(checks):
            (folder / "checks" / f"{i}.json").write_text(json.dumps(c))
    root = str(tmp_path / "runs")
    checks = readers.read_checks(spark, root)
    assert {(r["run_id"], r["file"], r["name"], r["passed"]) for r in checks.collect()} == {("r1", "0.json", "fit", True), ("r1", "1.json", "holdout", False), ("r3", "0.json", "fit", True)}
    got = {tuple(r) for r in readers.runs_by_task(readers.read_runs(spark, root), checks).collect()}
    assert got == {("t", "r1", "accepted", 2, "holdout"), (None, "r2", "rejected", 0, "")}


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"session_id": "a", "ts": 1700000000.5, "type": "x"}\n\n{"type": "y"}\n{"session\n{"session_id": 7, "ts": "2024-01-01 00:00:00"}\n')
    got = [(r["session"], r["kind"], r["sound"], r["at"] is not None) for r in readers.read_ledger(spark, str(tmp_path / "l.jsonl")).collect()]
    assert sorted(got, key=str) == sorted([("a", "x", True, True), (None, "y", False, False), (None, None, False, False), ("7", None, True, True)], key=str)
