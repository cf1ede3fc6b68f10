"""Registered queries of rechecked runs, differences of nested snapshots, drifted splits, and a stream whose rows come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch, nested_diff, recheck
from .plans import split
from .plans.stored import stored
from .queries_batch import kind, task_rows, task_tables
from .queries_law import BASE_SQL, laws, split_sql
from .sources.sinks import shared_folder
from .streaming import archive

#: What was done to a run's record, by its task: nothing, a check flipped, a number off by 1 %, its verdict flipped, checks of another suite added, no checks kept, a number off in the last places, a parameter off by 1 %, no such task, no formula.
SPOILT = 10


def rechecked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of the first kind of task, whose records are then spoilt in ten ways, and what a recheck finds."""
    data = task_rows(spark, sf_dir).filter(kind() == 0)
    tasks, candidates = (t.filter(kind() == 0) for t in task_tables(spark, sf_dir))
    candidates = candidates.filter("candidate in ('law', 'scaled', 'no_discount')")
    found, fits = batch.verify_with_fits(data, tasks, candidates)
    found = stored(found, "first")
    way = F.pmod(F.col("task_id").cast("long") / 4, F.lit(SPOILT)).cast("int")
    run_id = F.concat_ws("-", "task_id", "candidate")
    verdicts = batch.report(found).select("task_id", "candidate", "verdict")
    params = fits.select("task_id", "candidate", F.map_from_arrays("free", F.transform("theta", lambda v: F.when(way == 7, v * 1.01).otherwise(v))).alias("parameters"))
    told = candidates.withColumn("task_id", F.col("task_id").cast("string")).join(verdicts, ["task_id", "candidate"]).join(params, ["task_id", "candidate"], "left")
    runs = told.select(
        run_id.alias("run_id"), F.when(way == 8, F.concat(F.lit("gone-"), "task_id")).otherwise(F.col("task_id")).alias("task_id"), F.when(way != 9, F.col("formula")).alias("formula"), "free", "parameters",
        F.when(way == 3, F.when(F.col("verdict") == "accepted", "rejected").otherwise("accepted")).otherwise(F.col("verdict")).alias("verdict"),
    )
    value = F.when(way == 2, F.col("value") * 1.01).when(way == 6, F.col("value") * (1 + 1e-6)).otherwise(F.col("value"))
    passed = F.when((way == 1) & (F.col("name") == "holdout"), ~F.col("passed")).otherwise(F.col("passed"))
    checks = found.filter(way != 5).select(run_id.alias("run_id"), "name", passed.alias("passed"), value.alias("value"))
    foreign = found.filter((way == 4) & (F.col("name") == "holdout")).select(run_id.alias("run_id"), F.lit("essay").alias("name"), F.lit(True).alias("passed"), F.lit(None).cast("double").alias("value"))
    return recheck.recheck(runs, checks.unionByName(foreign), data, tasks)


def recheck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each rechecked run, and the checks that flipped."""
    runs, _ = rechecked(spark, sf_dir)
    return runs.select("run_id", "status", "deterministic", F.array_join(F.coalesce("stale", F.array().cast("array<string>")), ",").alias("stale"))


def recheck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tally and rates of a recheck."""
    runs, _ = rechecked(spark, sf_dir)
    return recheck.summary(runs).select("status", "n", "in_scope", F.round("recompute_rate", 6).alias("recompute_rate"), F.round("verdict_rate", 6).alias("verdict_rate"))


def snapshot(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Nested documents (k, doc) over the orders of a status: one for each fifty-first customer group."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.col("o_orderstatus") == status).withColumn("k", F.col("o_custkey") % 50)
    per = o.groupBy("k", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.sum("o_totalprice").alias("total"))
    ranked = F.array_sort(F.collect_list(F.struct("o_orderpriority", "n", "last")))  # five priorities
    a = per.groupBy("k").agg(ranked.alias("p"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    by = F.map_from_entries(F.transform("p", lambda x: F.struct(x["o_orderpriority"], x["n"])))
    last = F.transform("p", lambda x: F.struct(x["last"].alias("key")))
    doc = F.struct(
        F.struct(F.lit(status).alias("made_of"), F.lit("1").alias("version")).alias("environment"), F.struct("n", (F.col("total") / F.col("n")).alias("mean"), F.struct(F.lit(True).alias("deep")).alias("more")).alias("orders"), by.alias("by_priority"), last.alias("last"),
    )
    return a.select("k", F.to_json(doc).alias("doc"))


def nested_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots of nested documents: environment and conclusions apart."""
    return nested_diff.diff(snapshot(spark, sf_dir, "F"), snapshot(spark, sf_dir, "O"), ["k"], "doc").select("k", "part", "path", "finding")


def split_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which the split of the lines without those of flag R is not what the manifest of all lines says."""
    def fields(rows: DataFrame, seed: int) -> DataFrame:
        seg = stored(split.three_way(rows, "p", F.col("tie"), seed).select(*"pdty", "tie", "segment"), "segments")
        return split.manifest_fields(seg, list("pdt"), F.col("tie"), seed=seed, axis="p")

    rows = laws(spark, sf_dir)
    found = split.drift(fields(rows, 7), fields(rows.filter("flag <> 'R'"), 11))
    return found.select("field", "finding", F.when(F.col("field").rlike("/n$|digest$|^rule"), F.col("now")).alias("now"))


def split_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are in no segment or in two, after some were lost, doubled and made up."""
    seg = stored(split.three_way(laws(spark, sf_dir), "p", F.col("tie"), 7).select("tie", "segment"), "segments")
    digit = F.substring("tie", 5, 2)
    parts = {s: seg.filter(F.col("segment") == s) for s in ("train", "holdout", "extrapolation")}
    parts["train"] = parts["train"].filter(digit != "aa").unionByName(parts["holdout"].filter(digit == "bb")).unionByName(parts["holdout"].filter(digit == "cc").withColumn("tie", F.concat("tie", F.lit("x"))))
    found = split.cover(seg, parts, "tie")
    return found.groupBy("finding", "segments").agg(F.count("*").alias("n"), F.min("tie").alias("first_row"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come in four files out of order, the first of them twice: none is lost or stored twice, late ones lie in their own bucket."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    inbox, path = shared_folder(spark, "inbox"), shared_folder(spark, "late")
    for part in (0, 1, 2, 3, 0):
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(inbox)
    held = archive.archive_all(archive.read_stream(spark, inbox, files=1), "event_id", "ts", path, f"{path}/state")
    day = F.substring_index("run_name", "_", 1)
    return held.groupBy(day.alias("day"), "bucket").agg(F.count("*").alias("n"), F.count_distinct("run_name").alias("names"), F.sum(F.substring_index("run_name", "_", -1).cast("long")).alias("numbers"), F.max("event_id").alias("last_id"))


def _nested_sql() -> str:
    return """with o as (select o_orderstatus as s, o_custkey % 50 as k, o_orderpriority as pr, o_orderkey as id, o_totalprice as v from orders where o_orderstatus in ('F', 'O')),
      per as (select s, k, pr, count(*) as n, max(id) as last, sum(v) as total from o group by all), a as (select s, k, sum(n) as n, sum(total) / sum(n) as mean, count(*) as size from per group by all),
      ranked as (select s, k, last, row_number() over (partition by s, k order by pr) - 1 as i from per),
      flat as (select s, k, '/environment/made_of' as path, s as v, false as counted from a union all select s, k, '/environment/version', '1', false from a union all select s, k, '/orders/n', cast(cast(n as bigint) as varchar), false from a union all select s, k, '/orders/mean', printf('%.5e', mean), false from a
        union all select s, k, '/orders/more/deep', 'true', false from a union all select s, k, '/by_priority/' || pr, cast(n as varchar), false from per union all select s, k, '/last', cast(size as varchar), true from a
        union all select s, k, '/last[' || i || ']/key', cast(last as varchar), false from ranked),
      j as (select k, path, counted, f.v as was, o.v as now, f.s as fs, o.s as os from (select * from flat where s = 'F') f full join (select * from flat where s = 'O') o using (k, path, counted)),
      d as (select *, case when fs is null then 'added' when os is null then 'missing' when was <> now then case when counted then 'length' else 'changed' end end as finding from j),
      shared as (select k from a where s = 'F' intersect select k from a where s = 'O')
      select k, case when path like '/environment/%' then 'environment' else 'conclusion' end as part, path, finding from d where finding is not null and k in (select k from shared) and not (path like '/last[%' and k in (select k from d where finding = 'length'))
      union all select k, 'conclusion', '', case when s = 'F' then 'missing' else 'added' end from a where k not in (select k from shared)"""


def _drift_sql() -> str:
    def fields(name: str, condition: str, seed: int) -> str:
        seg = split_sql(seed, f"_{name}").replace("from law)", f"from law where {condition})")
        n = f"seg_{name}"
        return f"""{seg}, fields_{name} as (select segment || '/n' as field, cast(count(*) as varchar) as v from {n} group by segment union all select segment || '/digest', cast(sum(cast('0x' || substr(md5(tie), 1, 12) as bigint)) as varchar) from {n} group by segment
          union all select segment || '/target_low', printf('%.12e', min(y)) from {n} group by segment union all select segment || '/target_high', printf('%.12e', max(y)) from {n} group by segment
          union all select 'support/' || v || '/low', printf('%.12e', min(x)) from (select unnest(['p', 'd', 't']) as v, unnest([p, d, t]) as x from {n} where segment = 'train') group by v
          union all select 'support/' || v || '/high', printf('%.12e', max(x)) from (select unnest(['p', 'd', 't']) as v, unnest([p, d, t]) as x from {n} where segment = 'train') group by v union all select 'rule/seed', '{seed}' union all select 'rule/axis', 'p')"""

    return f"""with {BASE_SQL}, {fields("was", "true", 7)}, {fields("now", "flag <> 'R'", 11)}
      select field, 'changed' as finding, case when regexp_matches(field, '/n$|digest$|^rule') then n.v end as now from fields_was w join fields_now n using (field) where w.v <> n.v"""


ORACLE_SQL = {
    "recheck_runs": f"""with r as (select s_suppkey as t, c, s_suppkey // 4 % {SPOILT} as way from supplier, (values ('law'), ('scaled'), ('no_discount')) v(c) where s_suppkey % 4 = 0 and s_suppkey in (select l_suppkey from lineitem))
      select t || '-' || c as run_id, case way when 1 then 'stale-checks' when 2 then 'stale-metrics' when 3 then 'disagree' when 4 then 'out-of-scope' when 5 then 'out-of-scope' when 7 then case c when 'scaled' then 'stale-metrics' else 'agree' end when 8 then 'unresolvable' when 9 then 'missing-formula' else 'agree' end as status,
        way = 0 or (way = 7 and c <> 'scaled') as deterministic, case when way = 1 then 'holdout' else '' end as stale from r""",
    "nested_baseline": _nested_sql(),
    "split_drift": _drift_sql(),
    "split_cover": f"""with {BASE_SQL}, {split_sql()}, s as (select tie, segment, substr(tie, 5, 2) as digit from seg),
      f as (select 'gap' as finding, '' as segments, tie from s where segment = 'train' and digit = 'aa' union all select 'overlap', 'holdout,train', tie from s where segment = 'holdout' and digit = 'bb' union all select 'stranger', 'train', tie || 'x' from s where segment = 'holdout' and digit = 'cc')
      select finding, segments, cast(count(*) as bigint) as n, min(tie) as first_row from f group by all""",
    "stream_late": """with e as (select event_id, ts, event_id % 4 as part, strftime(ts, '%Y%m%d') as day from events), m as (select part, max(ts) as latest from e group by part),
      l as (select *, coalesce(ts < (select max(latest) from m where m.part < e.part) - interval 600 seconds, false) as late from e),
      w as (select *, row_number() over (partition by day order by part, event_id) as number from l)
      select day, case when late then 'late' else 'on_time' end as bucket, cast(count(*) as bigint) as n, cast(count(*) as bigint) as names, cast(sum(number) as bigint) as numbers, max(event_id) as last_id from w group by all""",
}
ORACLE_SQL["recheck_summary"] = f"""with s as (select status, count(*) as n from ({ORACLE_SQL["recheck_runs"]}) group by status), t as (select sum(n) as total, coalesce(sum(n) filter (status = 'agree'), 0) as agree, coalesce(sum(n) filter (status in ('agree', 'stale-checks')), 0) as again from s where status in ('agree', 'disagree', 'stale-checks', 'stale-metrics'))
  select status, cast(n as bigint) as n, cast(total as bigint) as in_scope, round(agree / total, 6) as recompute_rate, round(again / total, 6) as verdict_rate from s, t"""
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
