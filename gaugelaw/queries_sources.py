"""Registered queries that write what a source holds and read it back: tasks, series, specs, candidates, splits, evidence, scores and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import evidence
from .queries_law import SEG, segments
from .sources import readers, sinks


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's data and metadata from its folder, with the variables that the metadata name, else all but the target."""
    folder, part = sinks.shared_folder(spark, "task"), _t(spark, sf_dir, "part")
    part.select(F.col("p_retailprice").alias("y"), F.col("p_size").alias("x"), F.col("p_partkey").alias("z"), "p_brand").write.csv(f"{folder}/data.csv", header=True)
    meta = part.agg(F.lit("parts").alias("task_id"), F.array(F.lit("x"), F.lit("z")).alias("var_names"), F.count(F.lit(1)).alias("sample_count"))
    meta.write.json(f"{folder}/meta.json")
    data, meta = readers.read_task(spark, folder)
    names = meta.first()["var_names"] or [c for c in data.columns if c != "y"]  # one row
    rows = readers.numeric(data.select("y", *names), ["y", *names])
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y_sum"), F.max("z").alias("last_z")).join(meta.select("task_id", "sample_count"))  # one row of metadata


def zonal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of bands from lines of text, of which those with too few cells or a word drop out, and its coordinates' sines."""
    path, e = sinks.shared_folder(spark, "zonal"), _t(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2000-01-01")).alias("day")
    counts = e.groupBy(day).agg(*(F.count_if(F.col("user_id") % 3 == i).alias(f"b{i}") for i in range(3)))
    line = F.when(F.col("day") % 5 == 0, F.concat_ws(",", "day", "b0")).when(F.col("day") % 7 == 0, F.concat_ws(",", "day", "b0", F.lit("n/a"), "b2")).otherwise(F.concat_ws(" , ", "day", "b0", "b1", "b2"))
    counts.select(line).write.text(path)
    rows = readers.read_zonal(spark, path, 3).select("year", F.posexplode("bands").alias("band", "v"))
    latitude = F.col("band") * 60.0 - 60.0
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("years"), F.sum("v").alias("total"), F.max("year").alias("last")).withColumn("sine", F.round(F.sin(F.radians(latitude)), 6))


def fixed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns between white space: lines of another arity drop out."""
    path, c = sinks.shared_folder(spark, "fixed"), _t(spark, sf_dir, "customer")
    line = F.concat(F.lit("  "), "c_custkey", F.lit("\t"), F.round("c_acctbal", 2), F.when(F.col("c_nationkey") == 3, "").otherwise(F.concat(F.lit("   "), "c_nationkey")))
    c.select(line).write.text(path)
    rows = readers.read_fixed(spark, path, ["key", "balance", "nation"])
    return rows.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.max("key").alias("last_key"))


def wide_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a column for each zone: columns are mapped to bands, years with a gap drop out, and a series without any is refused."""
    path, o = sinks.shared_folder(spark, "wide") + ".csv", _t(spark, sf_dir, "orders")
    by = o.groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).cast("string").alias("Year")).agg(*(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey"))).alias(f"zone {s}") for s in "FOP"))
    by.write.csv(path, header=True)
    rows = readers.wide_years(readers.read_delimited(spark, path, ","), "Year", {"zone F": "south", "zone O": "middle", "zone P": "north"}, least=1)
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("years"), F.sum("v").alias("total"), F.max("year").alias("last"))


def spec_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs made from a static list and true constants, read back; tasks without a spec are told, and names of equal checks numbered."""
    path, s = sinks.shared_folder(spark, "specs"), _t(spark, sf_dir, "supplier")
    checks = F.when(F.col("s_nationkey") < 8, F.array(F.lit('{"kind":"scaling","scales":{"p":2.0}}'), F.lit('{"kind":"sign","expect":"positive"}'), F.lit('{"kind":"scaling","scales":{"q":3.0}}'))).otherwise(F.array(F.lit('{"kind":"limit","var":"d"}')))
    made = s.filter("s_nationkey < 16").select(F.lit(readers.SPEC_SCHEMA).alias("schema"), "s_name", F.create_map(F.lit("k"), F.round("s_acctbal", 2)).alias("nominal_parameters"), checks.alias("checks"))
    made.withColumnRenamed("s_name", "task_id").write.json(path)
    specs = readers.read_specs(spark, path)
    scales = F.from_json(F.get_json_object("spec", "$.scales"), "map<string,double>")
    specs = specs.withColumn("label", F.when(scales.isNotNull(), F.concat_ws(" ", "kind", text.describe_scales(scales))).otherwise(F.col("kind")))
    j = s.select(F.col("s_name").alias("task_id"), "s_nationkey").join(specs, "task_id", "left")
    return j.groupBy(F.coalesce("label", F.lit("scale-checks-missing")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("nominal")["k"]), 2).alias("k"), F.max("s_nationkey").alias("last_nation"))


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a ledger, some of them cut off and some without a session, read back: entries, spans and broken lines by kind."""
    path, e = sinks.shared_folder(spark, "ledger"), _t(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 11 != 0, F.col("user_id").cast("string")).alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("type"), "value"))
    e.select(F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    rows = readers.read_ledger(spark, path)
    return rows.groupBy(F.coalesce("kind", F.lit("broken")).alias("kind"), "sound").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of tasks, as texts or with parameters, from lines of JSON."""
    path, p = sinks.shared_folder(spark, "candidates"), _t(spark, sf_dir, "part")
    whole = F.to_json(F.struct(F.concat(F.lit("k*"), "p_brand").alias("formula"), F.create_map(F.lit("k"), F.col("p_size").cast("double")).alias("parameters")))
    line = F.concat(F.lit('{"task_id":"'), "p_partkey", F.lit('","candidates":["x/'), "p_size", F.lit('",'), whole, F.lit("]}"))
    p.select(line).write.text(path)
    rows = readers.read_candidates(spark, path)
    return rows.groupBy("formula").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("parameters")["k"]).alias("k"), F.max("place").alias("place"))


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split against the manifest of another seed's: what stayed, and what drifted."""
    path = sinks.shared_folder(spark, "split")
    seg = segments(spark, sf_dir).select("p", "d", "t", "y", "tie", "segment")
    sinks.write_split(seg, "p", path)
    again = segments(spark, sf_dir, 11).select("p", "d", "t", "y", "tie", "segment")
    held = spark.read.json(path)
    return sinks.split_drift(again, held).join(held.select("segment", "n", F.round("y_min", 4).alias("y_min"), "axis"), "segment")


def evidence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle that is written twice: what each of its tables holds, doubled check names and overwritten runs among them."""
    path, o, li = sinks.shared_folder(spark, "evidence"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    checks = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"), (F.col("l_discount") < 0.05).alias("passed"))
    cents = F.round(F.col("l_quantity") * 100).cast("long")
    for changed in (cents, F.when(F.col("l_linestatus") == "F", cents + 1).otherwise(cents)):
        sinks.write_evidence(runs, checks, li.select(F.col("l_orderkey").alias("run_id"), F.concat_ws("/", F.lit("checks"), "l_linenumber").alias("rel_path"), F.sha2(changed.cast("string"), 256).alias("sha256")), path)
    parts = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run")) for name in ("runs", "checks", "duplicate_checks", "manifest", "overwritten")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def score_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of runs by layer, agents' and all, from both of the files they are written to."""
    path, e = sinks.shared_folder(spark, "scores"), _t(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("user_id") % 4 == 0, "agent-").otherwise("cli-"), "user_id")
    rows = e.withColumn("source", evidence.classify(name))
    layers = evidence.rates(rows, ["event_type", "source"], {"match": F.col("value") > 20})
    sinks.write_scores(layers, path)
    a = spark.read.json(f"{path}/json").filter("source = 'agent'")
    b = readers.numeric(spark.read.csv(f"{path}/csv", header=True), ["n", "match"]).groupBy("event_type").agg(F.sum("n").cast("long").alias("all_n"), F.sum("match").cast("long").alias("all_match"))
    return a.join(b, "event_type").select("event_type", "n", "match", F.round("match_rate", 6).alias("match_rate"), "all_n", "all_match")


def trajectory_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a trajectory: the third is written twice, and a second run begins again with round 1."""
    path, e = sinks.shared_folder(spark, "rounds"), _t(spark, sf_dir, "events")
    for run in (1, 2):
        for number in (1, 2, 3, 3)[: 4 if run == 1 else 2]:
            sinks.append_round(e.filter(F.col("user_id") % 5 == number).select("event_id", F.lit(run).alias("run"), "value"), number, path)
    return spark.read.json(path).groupBy("round", "run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


ORACLE_SQL = {
    "task_scan": "select cast(p_size as double) as x, cast(count(*) as bigint) as n, round(sum(p_retailprice), 2) as y_sum, cast(max(p_partkey) as double) as last_z, 'parts' as task_id, (select count(*) from part) as sample_count from part group by p_size",
    "zonal_scan": """with c as (select date_diff('day', date '2000-01-01', cast(ts as date)) as day, count(*) filter (user_id % 3 = 0) as b0, count(*) filter (user_id % 3 = 1) as b1, count(*) filter (user_id % 3 = 2) as b2 from events group by 1),
      r as (select day, unnest([0, 1, 2]) as band, unnest([b0, b1, b2]) as v from c where day % 5 <> 0 and day % 7 <> 0) select cast(band as int) as band, cast(count(*) as bigint) as years, cast(sum(v) as double) as total, cast(max(day) as int) as last, round(sin(radians(band * 60.0 - 60.0)), 6) as sine from r group by band""",
    "fixed_scan": "select cast(c_nationkey as double) as nation, cast(count(*) as bigint) as n, round(sum(round(c_acctbal, 2)), 2) as balance, cast(max(c_custkey) as double) as last_key from customer where c_nationkey <> 3 group by c_nationkey",
    "wide_scan": """with w as (select date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as y, sum(o_orderkey) filter (o_orderstatus = 'F') as f, sum(o_orderkey) filter (o_orderstatus = 'O') as o, sum(o_orderkey) filter (o_orderstatus = 'P') as p from orders group by 1),
      r as (select y, unnest(['south', 'middle', 'north']) as band, unnest([f, o, p]) as v from w where f is not null and o is not null and p is not null) select band, cast(count(*) as bigint) as years, cast(sum(v) as double) as total, cast(max(y) as int) as last from r group by band""",
    "spec_scan": """with l as (select s_nationkey as nation, s_acctbal, case when s_nationkey < 8 then ['scaling p x2.0', 'sign', 'scaling q x3.0'] when s_nationkey < 16 then ['limit'] else ['scale-checks-missing'] end as labels from supplier),
      u as (select nation, s_acctbal, unnest(labels) as label from l) select label, cast(count(*) as bigint) as n, round(sum(case when label <> 'scale-checks-missing' then round(s_acctbal, 2) end), 2) as k, max(nation) as last_nation from u group by label""",
    "ledger_scan": """with l as (select case when event_id % 97 = 0 then null when event_id % 11 = 0 then null else user_id end as s, case when event_id % 97 <> 0 then event_type end as kind, case when event_id % 97 <> 0 then date_trunc('second', ts) end as moment from events)
      select coalesce(kind, 'broken') as kind, s is not null as sound, cast(count(*) as bigint) as n, cast(count(distinct s) as bigint) as sessions, strftime(max(moment), '%Y-%m-%d %H:%M:%S') as last from l group by all""",
    "candidate_scan": "with u as (select unnest([concat('x/', p_size), concat('k*', p_brand)]) as formula, unnest([null, cast(p_size as double)]) as k, unnest([0, 1]) as place from part) select formula, cast(count(*) as bigint) as n, sum(k) as k, cast(max(place) as int) as place from u group by formula",
    "split_manifest": f"{SEG} select segment, case when segment = 'extrapolation' then 'equal' else 'changed' end as status, cast(count(*) as bigint) as n, round(min(y), 4) as y_min, 'p' as axis from seg group by segment",
    "evidence_store": """with r as (select o_orderkey as run_id from orders), c as (select l_orderkey as run_id, l_returnflag as name, l_linestatus from lineitem), d as (select run_id, name from c group by all having count(*) > 1), w as (select distinct run_id from c where l_linestatus = 'F')
      select 'runs' as part, count(*) as n, min(run_id) as first_run from r union all select 'checks', count(*), min(run_id) from c union all select 'duplicate_checks', count(*), min(run_id) from d union all select 'manifest', count(*), min(run_id) from c union all select 'overwritten', count(*), min(run_id) from w""",
    "score_outputs": "select event_type, cast(count(*) filter (user_id % 4 = 0) as bigint) as n, cast(count(*) filter (user_id % 4 = 0 and value > 20) as bigint) as match, round(count(*) filter (user_id % 4 = 0 and value > 20) / count(*) filter (user_id % 4 = 0), 6) as match_rate, cast(count(*) as bigint) as all_n, cast(count(*) filter (value > 20) as bigint) as all_match from events group by event_type",
    "trajectory_rounds": "select user_id % 5 as round, cast(2 as bigint) as run, cast(count(*) as bigint) as n, round(sum(value), 2) as total from events where user_id % 5 in (1, 2) group by user_id % 5",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
