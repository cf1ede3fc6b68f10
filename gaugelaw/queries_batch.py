"""Registered queries of batch verification: every supplier's lines are a task with its own law, variables and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch, batch_fit
from .plans import grouped_split
from .plans.stored import stored

#: By kind of law: variables, units, and candidates (name, formula, parameters to be fitted).
KINDS = (
    ("pdt", {"p": "N", "d": "1", "t": "1", "y": "N"}, (("law", "p*(1-d)*(1+t)", ""), ("scaled", "k*p*(1-d)*(1+t)", "k"), ("no_discount", "p*(1+t)", ""), ("cut_off", "p*(1-d", ""), ("wrong_unit", "p*(1-d)*(1+t)*sqrt(p/p) + 0*p*p", ""))),
    ("qp", {"q": "m", "p": "N", "y": "J"}, (("ratio", "k*p/q", "k"), ("product", "k*p*q", "k"), ("unscaled", "p/q", ""), ("unknown_name", "k*p/w", "k"))),
    ("dq", {}, (("power", "a*q**b*exp(-c*d)", "a,b,c"), ("no_discount", "a*q**b", "a,b"), ("denominator", "a*q**b/(1+c*d)", "a,b,c"))),
    ("tq", {"q": "m"}, (("line", "a+b*q", "a,b"), ("root", "k*sqrt(q)", "k"))),
)


def kind() -> Column:
    """The kind of a task's law."""
    return F.pmod(F.col("task_id"), F.lit(4))


def _by_kind(values: list[Column]) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(kind() == i, v).otherwise(out)
    return out


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (task_id, x, y, tie): the law by the task's kind, its constants by the task, and a noise of at most 0.4 % from a hash; the last kind has no law."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("task_id"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"), _tie().alias("tie"))
    noise = 1 + (F.instr(F.lit("0123456789abcdef"), F.substring("tie", 1, 1)) - 8.5) / 7.5 * 0.004
    noise_only = F.conv(F.substring("tie", 3, 6), 16, 10).cast("double") / 2**24 * 10 - 5
    y = _by_kind([
        F.expr("p*(1-d)*(1+t)") * noise, (2 + F.col("task_id") % 5) * F.col("p") / F.col("q") * noise,
        (1 + F.col("task_id") % 3) * F.pow(F.col("q"), 1 + F.col("task_id") % 7 / 8) * F.exp(-(2 + F.col("task_id") % 2) * F.col("d")) * noise, noise_only,
    ])
    return li.select("task_id", _by_kind([F.array(*names) for names, *_ in KINDS]).alias("x"), y.alias("y"), "tie")


def _tie() -> Column:
    cents = [F.floor(F.col(c) * 100 + 0.5) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cents))


def task_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, candidates) of all suppliers."""
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("task_id"))
    units = lambda u: F.create_map(*(F.lit(x) for kv in u.items() for x in kv)) if u else F.create_map().cast("map<string,string>")
    tasks = ids.select("task_id", _by_kind([F.array(*map(F.lit, names)) for names, *_ in KINDS]).alias("var_names"), _by_kind([units(u) for _, u, _ in KINDS]).alias("units"))
    made = _by_kind([F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(f).alias("formula"), F.lit(k).alias("k")) for n, f, k in c)) for *_, c in KINDS])
    candidates = ids.select("task_id", F.inline(made)).withColumn("free", F.filter(F.split("k", ","), lambda p: p != "")).drop("k")
    return tasks, candidates


def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way splits of all tasks, by rank on each one's widest variable: rows, an order-free checksum and the range of the target."""
    rows, shape = grouped_split.three_way(task_rows(spark, sf_dir), 7)
    check = F.conv(F.substring("tie", 1, 12), 16, 10).cast("decimal(38,0)")
    a = rows.groupBy("task_id", "segment").agg(F.count("*").alias("n"), F.sum(check).cast("string").alias("digest"))
    return a.join(shape.select("task_id", "axis"), "task_id")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(batch.verify(task_rows(spark, sf_dir), *task_tables(spark, sf_dir)), "checks")


def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each candidate of each task, from one verification of all of them."""
    return batch.report(_verdicts(spark, sf_dir))


def batch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each gate of a batch passes and fails, by what the dimension gate could judge."""
    return _verdicts(spark, sf_dir).groupBy("name", F.coalesce("mode", F.lit("")).alias("mode"), "passed").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("tasks"))


def batch_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of one to three unknowns, fitted for all tasks together to targets without noise: an optimum is where they were taken from."""
    rows = task_rows(spark, sf_dir).filter(kind().isin(1, 2)).drop("y", "tie")
    d, q, p = F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.get("x", F.lit(1))
    y = F.when(kind() == 1, (2 + F.col("task_id") % 5) * p / d).otherwise((1 + F.col("task_id") % 3) * F.pow(q, 1 + F.col("task_id") % 7 / 8) / (1 + (2 + F.col("task_id") % 2) * d))
    tasks, candidates = task_tables(spark, sf_dir)
    held = batch.blocks(rows.select("task_id", "x", y.alias("y"), F.lit("train").alias("segment")))
    asked = candidates.filter("candidate in ('ratio', 'denominator')").join(tasks, "task_id").select(F.col("task_id").cast("string").alias("task_id"), "candidate", "formula", "var_names", "free")
    fits = batch_fit.fit(held, asked)
    named = fits.select(F.col("task_id").cast("long").alias("task_id"), "candidate", (F.col("fit_error") < 1e-7).alias("exact"), F.inline(F.arrays_zip(F.col("free").alias("parameter"), F.col("theta").alias("value"))))
    return named.select("task_id", "candidate", "parameter", F.round("value", 5).alias("value"), "exact")


_ROWS = """with li as (select l_suppkey as task_id, p, d, t, q, tie, l_suppkey % 4 as kind, 1 + (strpos('0123456789abcdef', substr(tie, 1, 1)) - 8.5) / 7.5 * 0.004 as noise from
  (select l_suppkey, l_extendedprice as p, l_discount as d, l_tax as t, l_quantity as q, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(floor(l_quantity * 100 + 0.5) as bigint), cast(floor(l_extendedprice * 100 + 0.5) as bigint),
    cast(floor(l_discount * 100 + 0.5) as bigint), cast(floor(l_tax * 100 + 0.5) as bigint))) as tie from lineitem)),
rows as (select *, case kind when 0 then p*(1-d)*(1+t) * noise when 1 then (2 + task_id % 5) * p / q * noise when 2 then (1 + task_id % 3) * pow(q, 1 + task_id % 7 / 8.0) * exp(-(2 + task_id % 2) * d) * noise
  else cast('0x' || substr(tie, 3, 6) as bigint) / 16777216.0 * 10 - 5 end as y, case when kind < 2 then p else q end as v from li),
ranked as (select *, count(*) over w as n, row_number() over (partition by task_id order by v, substr(tie, 1, 12)) as rk from rows window w as (partition by task_id)),
sized as (select *, cast(greatest(6, round_even(0.15 * n, 0)) as bigint) // 2 as tail from ranked),
out as (select *, rk <= tail or rk > n - tail as outside from sized),
drawn as (select *, row_number() over (partition by task_id, outside order by substr(md5(tie || '#7'), 1, 12)) as draw from out),
seg as (select *, case when outside then 'extrapolation' when draw <= greatest(0, least(round_even(0.2 * n, 0), n - 2 * tail - 10)) then 'holdout' else 'train' end as segment from drawn)"""

# Each candidate's prediction with its fitted scale; those of several parameters with the constants that made the rows, or, without one of these, with a line through logarithms.
_CHECKS = f"""{_ROWS},
c(kind, candidate, mode, known, free) as (values (0, 'law', 'strict', true, 0), (0, 'scaled', 'structural', true, 1), (0, 'no_discount', 'strict', true, 0), (0, 'cut_off', 'strict', false, 0), (0, 'wrong_unit', 'strict', true, 0),
  (1, 'ratio', 'structural', true, 1), (1, 'product', 'structural', true, 1), (1, 'unscaled', 'strict', true, 0), (1, 'unknown_name', 'strict', false, 1),
  (2, 'power', 'skipped', true, 3), (2, 'no_discount', 'skipped', true, 2), (2, 'denominator', 'skipped', true, 3), (3, 'line', 'strict', true, 2), (3, 'root', 'skipped', true, 1)),
tc as (select s_suppkey as task_id, c.* from supplier join c on s_suppkey % 4 = c.kind where s_suppkey in (select task_id from rows)),
dimension as (select task_id, candidate, 1 as ord, 'dimension' as name, known and candidate not in ('wrong_unit', 'line') and not (kind = 1 and candidate = 'unscaled') as passed, mode from tc),
expression as (select task_id, candidate, 2 as ord, 'expression' as name, false as passed, null as mode from tc where not known),
shape as (select tc.task_id, candidate, free, segment, y, case candidate when 'law' then p*(1-d)*(1+t) when 'scaled' then p*(1-d)*(1+t) when 'wrong_unit' then p*(1-d)*(1+t) when 'ratio' then p/q when 'product' then p*q when 'unscaled' then p/q when 'root' then sqrt(q)
   when 'power' then (1 + tc.task_id % 3) * pow(q, 1 + tc.task_id % 7 / 8.0) * exp(-(2 + tc.task_id % 2) * d) when 'denominator' then (1 + tc.task_id % 3) * pow(q, 1 + tc.task_id % 7 / 8.0) * exp(-(2 + tc.task_id % 2) * d)
   when 'no_discount' then case when tc.kind = 0 then p*(1+t) else pow(q, 1 + tc.task_id % 7 / 8.0) end when 'line' then 1 end as f from tc join seg using (task_id) where known),
k as (select task_id, candidate, free, sum(f*y)/sum(f*f) as k, count(*) as n, stddev_pop(y) as sd, sqrt(greatest(sum(y*y) - sum(f*y)/sum(f*f)*sum(f*y), 0) / count(*)) as e from shape where segment = 'train' group by all),
fits as (select task_id, candidate, 3 as ord, 'fit' as name, e / sd <= 0.5 as passed, null as mode from k where free > 0),
err as (select s.task_id, s.candidate, segment, abs(f * case when s.free in (1, 2) then k else 1 end - y) / abs(y) as r from shape s join k using (task_id, candidate) where segment <> 'train' and y <> 0 and (s.free = 0 or e / sd <= 0.5)),
errors as (select task_id, candidate, case segment when 'holdout' then 4 else 5 end as ord, segment as name, quantile_cont(r, 0.5) <= case segment when 'holdout' then 0.02 else 0.03 end as passed, null as mode from err group by task_id, candidate, segment),
chk as (select * from dimension union all select * from expression union all select * from fits union all select * from errors)"""

ORACLE_SQL = {
    "batch_split": f"{_ROWS} select task_id, segment, cast(count(*) as bigint) as n, cast(sum(cast('0x' || substr(tie, 1, 12) as bigint)) as varchar) as digest, cast(any_value(case kind when 0 then 0 when 1 then 1 when 2 then 1 else 1 end) as integer) as axis from seg group by task_id, segment",
    "batch_verdicts": f"{_CHECKS} select cast(task_id as varchar) as task_id, candidate, case when bool_and(passed) then 'accepted' else 'rejected' end as verdict, min_by(name, ord) filter (not passed) as first_failed, coalesce(string_agg(name, ',' order by ord) filter (not passed), '') as failed, cast(count(*) as bigint) as n_checks from chk group by task_id, candidate",
    "batch_modes": f"{_CHECKS} select name, coalesce(mode, '') as mode, passed, cast(count(*) as bigint) as n, cast(count(distinct task_id) as bigint) as tasks from chk group by all",
    "batch_fits": """with t as (select s_suppkey as task_id from supplier where s_suppkey % 4 in (1, 2) and s_suppkey in (select l_suppkey from lineitem)) select task_id, case task_id % 4 when 1 then 'ratio' else 'denominator' end as candidate, parameter,
      round(case parameter when 'k' then 2 + task_id % 5 when 'a' then 1 + task_id % 3 when 'b' then 1 + task_id % 7 / 8.0 else 2 + task_id % 2 end, 5) as value, true as exact from t, (values ('k', 1), ('a', 2), ('b', 2), ('c', 2)) v(parameter, kind) where task_id % 4 = kind""",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
