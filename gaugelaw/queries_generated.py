"""Registered queries of generated laws and noise, of blinded sets, and of formulas compared on probe points."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import equality
from .sources import generate, sinks

SEED = 20261008


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def law_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All laws, with a row for each order: rows, digests of the draws, and the targets' range."""
    rows = generate.law_rows(_t(spark, sf_dir, "orders"), "o_orderkey")
    told = lambda c: F.format_string("%.8e", c)
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.isnan("y")).alias("undefined"), told(F.min("y")).alias("least"), told(F.max(F.when(~F.isnan("y"), F.col("y")))).alias("most"), told(F.max(F.get("x", F.lit(0)))).alias("first_most"))


def noise_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise of both scenarios with its metadata, written and read back: sets, rows, and moments of the target."""
    path = sinks.shared_folder(spark, "noise")
    generate.write_noise(generate.noise_rows(_t(spark, sf_dir, "orders"), "o_orderkey"), path)
    data, meta = spark.read.parquet(f"{path}/data"), spark.read.json(f"{path}/meta")
    per = data.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_pop("y"), 6).alias("spread"), F.round(F.max("x3"), 6).alias("x3_most"))
    sets = meta.groupBy("scenario").agg(F.count("*").alias("sets"), F.sum("sample_count").alias("told"), F.max("sample_count").alias("largest"))
    return per.join(sets, "scenario")


def blind_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tasks, their lines as specs and customers' accounts as references, under aliases: what each blinded table holds, and that no name is left."""
    s = _t(spark, sf_dir, "supplier")
    tasks = s.select(F.col("s_name").alias("task_id"), F.concat(F.lit("what "), "s_name", F.lit(" does")).alias("phenomenon"), F.lit("physics").alias("domain"), F.round("s_acctbal", 2).alias("balance"))
    lines = _t(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    specs = lines.groupBy(F.col("s_name").alias("task_id")).agg(F.count("*").alias("checks"), F.concat(F.lit("about "), F.min("s_name")).alias("physics_note"))
    answers = lines.groupBy(F.col("s_name").alias("task_id")).agg(F.map_from_entries(F.array(F.struct(F.min("s_name"), F.round(F.max("l_extendedprice"), 2)))).alias("by_task"))
    blinded, others = generate.blind(tasks, {"specs": specs, "answers": answers})
    text = lambda df: F.to_json(F.struct(*df.columns))
    parts = {"tasks": blinded, **others}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("part"), "task_id", text(df).alias("t"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"), F.min("task_id").alias("first_task"), F.count_if(F.col("t").contains("Supplier") | F.col("t").contains("what ")).alias("leaks"))


#: Formulas beside the law, and whether they are equal to it.
RIVALS = {"same": "p*(1-d)*(1+t)", "rewritten": "p*(1+t-d-d*t)", "nearly": "p*(1-d)*(1+t)*(1+5e-7)", "not quite": "p*(1-d)*(1+t)*(1+5e-6)", "other": "p*(1-d)", "partly undefined": "p*(1-d)*(1+t)+0*sqrt(d-0.02)", "scaled": "k*p*(1-d)*(1+t)", "no formula": "p*(1-"}


def formula_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas against the law on 259 points of each supplier's ranges."""
    li = _t(spark, sf_dir, "lineitem")
    ends = {"p": "l_extendedprice", "d": "l_discount", "t": "l_tax"}
    boxes = li.groupBy("l_suppkey").agg(F.create_map(*(c for v, n in ends.items() for c in (F.lit(v), F.array(F.min(n), F.max(n))))).alias("sampling"))
    rivals = F.array(*(F.struct(F.lit(n).alias("rival"), F.lit(f).alias("formula")) for n, f in RIVALS.items()))
    pairs = boxes.select("l_suppkey", "sampling", F.inline(rivals)).withColumn("parameters", F.create_map(F.lit("k"), F.lit(1.0)))
    found = equality.compare(pairs.select(F.struct("l_suppkey", "rival").alias("id"), "formula", F.lit(RIVALS["same"]).alias("reference"), "sampling", "parameters"))
    return found.groupBy(F.col("id.rival").alias("rival")).agg(F.count("*").alias("tasks"), F.count_if("equal").alias("equal"), F.sum("undefined").alias("undefined"), F.round(F.max("deviation"), 9).alias("worst"))


def _u(*parts: str) -> str:
    return f"((cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) as bigint) + 0.5) / 281474976710656.0)"


def _laws_sql() -> str:
    parts = []
    for law in generate.LAWS:
        f = re.sub(r"\bpi\b", "pi()", law.formula)
        for k, v in law.constants.items():
            f = re.sub(rf"\b{k}\b", f"({v!r}::double)", f)
        draws = ", ".join(f"({lo!r}::double) + ({hi!r}::double - {lo!r}::double) * {_u(repr(str(SEED)), repr(law.name), 'o_orderkey', repr(v))} as v_{v}" for v, (_, lo, hi) in law.variables.items())
        for v in law.variables:
            f = re.sub(rf"(?<![\w.]){v}(?!\w|\()", f"v_{v}", f)
        first = next(iter(law.variables))
        parts.append(f"select '{law.name}' as task_id, v_{first} as x, {f} as y from (select {draws} from orders)")
    return f"select task_id, cast(count(*) as bigint) as n, cast(count(*) filter (isnan(y)) as bigint) as undefined, printf('%.8e', min(y)) as least, printf('%.8e', max(y) filter (not isnan(y))) as most, printf('%.8e', max(x)) as first_most from ({' union all '.join(parts)}) group by task_id"


def _noise_sql() -> str:
    parts = []
    for s, size in generate.SCENARIOS.items():
        of = lambda *what, s=s: _u(repr(str(SEED)), repr(s), "o_orderkey", *map(repr, what))
        parts.append(f"select '{s}' as scenario, o_orderkey // {size} as k, 1 + 9 * {of('x3')} as x3, sqrt(-2 * ln({of('y', 'r')})) * cos({of('y', 'a')} * 6.283185307179586) as y from orders")
    return f"""with n as ({" union all ".join(parts)}), m as (select scenario, k, count(*) as c from n group by all), t as (select scenario, count(*) as sets, sum(c) as told, max(c) as largest from m group by scenario),
      a as (select scenario, count(*) as n, round(avg(y), 6) as mean, round(stddev_pop(y), 6) as spread, round(max(x3), 6) as x3_most from n group by scenario)
      select scenario, cast(n as bigint) as n, mean, spread, x3_most, cast(sets as bigint) as sets, cast(told as bigint) as told, cast(largest as bigint) as largest from a join t using (scenario)"""


def _equality_sql() -> str:
    at = lambda v, place: f"case when {v}0 > 0 then {v}0 * pow({v}1 / {v}0, {place}) else {v}0 + ({v}1 - {v}0) * {place} end"
    share = lambda n: f"(case i when 0 then 0.5 when 1 then 0.0 when 2 then 1.0 else sqrt({n}.0) * (i - 2) - floor(sqrt({n}.0) * (i - 2)) end)"
    cases = " ".join(f"when '{n}' then " + re.sub(r"sqrt\(d-0.02\)", "case when d < 0.02 then 'nan'::double else sqrt(greatest(d-0.02, 0)) end", f).replace("k*", "1.0*") for n, f in RIVALS.items() if n != "no formula")
    names = ", ".join(f"('{n}')" for n in RIVALS)
    return f"""with b as (select l_suppkey as s, min(l_extendedprice) as p0, max(l_extendedprice) as p1, min(l_discount) as d0, max(l_discount) as d1, min(l_tax) as t0, max(l_tax) as t1 from lineitem group by l_suppkey),
      q as (select s, i, {at("d", share(2))} as d, {at("p", share(3))} as p, {at("t", share(5))} as t from b, range(0, {equality.POINTS + 3}) r(i)),
      y as (select s, rival, p*(1-d)*(1+t) as b, case rival {cases} else 'nan'::double end as a from q, (values {names}) v(rival)),
      g as (select s, rival, count(*) filter (isnan(a)) as undefined, max(abs(a - b)) filter (not isnan(a)) as off, max(abs(b)) filter (not isnan(a)) as size from y group by all)
      select rival, cast(count(*) as bigint) as tasks, cast(count(*) filter (undefined = 0 and off / size <= 1e-6) as bigint) as equal, cast(sum(undefined) as bigint) as undefined, round(max(off / size), 9) as worst from g group by rival"""


ORACLE_SQL = {
    "law_tables": _laws_sql(),
    "noise_sets": _noise_sql(),
    "blind_set": """with t as (select 't-' || substr(sha1(s_name), 1, 8) as a, s_suppkey from supplier), l as (select distinct l_suppkey from lineitem), u as (select 'tasks' as part, a from t union all select 'specs', a from t where s_suppkey in (select l_suppkey from l) union all select 'answers', a from t where s_suppkey in (select l_suppkey from l))
      select part, cast(count(*) as bigint) as n, cast(count(distinct a) as bigint) as tasks, min(a) as first_task, cast(0 as bigint) as leaks from u group by part""",
    "formula_equality": _equality_sql(),
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
