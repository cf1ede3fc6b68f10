"""Registered queries of the six gates: every check of every candidate, the verdicts, and what the gates let through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates, scale
from .operators.gates import Candidate
from .plans.stored import stored
from .queries_law import LAW, SEG, _box, columns, segments

UNITS = {"p": "N", "d": "1", "t": "-", "q": "m", "y": "kg*m/s^2"}
CANDIDATES = {
    "law": Candidate(LAW),
    "scaled": Candidate(f"k*{LAW}", "k"),
    "scaled_with_unit": Candidate(f"k*{LAW}", "k", {"k": "1"}),
    "scale_of_wrong_unit": Candidate(f"k*{LAW}", "k", {"k": "m^(1/2)"}),
    "adds_a_length": Candidate(f"{LAW} + 0*q"),
    "no_discount": Candidate("p*(1+t)"),
    "unrelated": Candidate("k*t", "k"),
    "cut_off": Candidate("p*(1-d"),
    "unknown_name": Candidate("p*(1-z)"),
    "undefined_root": Candidate("sqrt(0-p)"),
}


def _specs() -> dict[str, list]:
    v = list("pdt")
    pass_of = lambda c: c["passed"]
    return {
        "law": [("scaling", pass_of(scale.scaling(LAW, v, ["p"], 2.0, 1.0))), ("monotonic", pass_of(scale.monotonic(LAW, v, "p"))), ("monotonic", pass_of(scale.monotonic(LAW, v, "d", increasing=False))), ("sign", pass_of(scale.sign(LAW, v)))],
        "adds_a_length": [("invariance", pass_of(scale.scaling(f"{LAW} + 0*q", [*v, "q"], ["q"], 3.0, 0.0)))],
        "no_discount": [("monotonic", pass_of(scale.monotonic("p*(1+t)", v, "d", increasing=False)))],
    }


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = stored(segments(spark, sf_dir).select(*"pdtqy", "segment"), "segments")
    return gates.verify(seg, CANDIDATES, columns("pdtq"), UNITS, _box(spark, sf_dir), _specs())


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate that each candidate came to, in order, with what it measured."""
    return _checks(spark, sf_dir).select("candidate", "ord", "name", "passed", F.round("value", 6).alias("value"), "mode")


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each candidate, its failed gates in order, and what they say about it."""
    return gates.report(_checks(spark, sf_dir))


def gate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates came to each gate, failed it, and failed it first; the mean of what it measured."""
    rows = _checks(spark, sf_dir)
    first = rows.filter(~F.col("passed")).groupBy("candidate").agg(F.min("ord").alias("first"))
    return (
        rows.join(F.broadcast(first), "candidate", "left").groupBy(F.when(F.col("name").startswith("scale-"), "scale").otherwise(F.col("name")).alias("gate"))  # one row for each candidate
        .agg(F.count_distinct("candidate").alias("n_candidates"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_distinct(F.when(F.col("ord") == F.col("first"), F.col("candidate"))).alias("n_first"))
    )


# Exponents of m, kg, s are enough for these units; each term of a formula is a product of powers of its variables.
_GATES = f"""{SEG},
unit(v, m, kg, s) as (values ('p', 1.0, 1.0, -2.0), ('d', 0.0, 0.0, 0.0), ('t', 0.0, 0.0, 0.0), ('q', 1.0, 0.0, 0.0), ('one', 0.0, 0.0, 0.0), ('root', 0.5, 0.0, 0.0)),
term(candidate, term, v, n) as (values ('law', 1, 'p', 1.0), ('scaled', 1, 'p', 1.0), ('scaled_with_unit', 1, 'p', 1.0), ('scaled_with_unit', 1, 'one', 1.0), ('scale_of_wrong_unit', 1, 'p', 1.0), ('scale_of_wrong_unit', 1, 'root', 1.0),
  ('adds_a_length', 1, 'p', 1.0), ('adds_a_length', 2, 'q', 1.0), ('no_discount', 1, 'p', 1.0), ('unrelated', 1, 't', 1.0), ('undefined_root', 1, 'p', 0.5)),
dims as (select candidate, term, sum(n * m) as m, sum(n * kg) as kg, sum(n * s) as s from term join unit using (v) group by candidate, term),
named as (select c as candidate, free from (values ('law', false), ('scaled', true), ('scaled_with_unit', false), ('scale_of_wrong_unit', false), ('adds_a_length', false), ('no_discount', false), ('unrelated', true), ('undefined_root', false)) x(c, free)),
dimension as (select n.candidate, 1 as ord, 'dimension' as name, case when free then count(distinct (d.m, d.kg, d.s)) = 1 else bool_and(d.m = u.m and d.kg = u.kg and d.s = u.s) end as passed, cast(null as double) as value, case when free then 'structural' else 'strict' end as mode
  from named n join dims d using (candidate), (select * from unit where v = 'p') u group by n.candidate, free
  union all select c, 1, 'dimension', false, null, 'strict' from (values ('cut_off', 'p*(1-d'), ('unknown_name', 'p*(1-z)')) x(c, f) where len(replace(f, '(', '')) <> len(replace(f, ')', '')) or regexp_matches(f, '[^pdtqk*()+0-9-]')),
expression as (select candidate, 2 as ord, 'expression' as name, false as passed, cast(null as double) as value, cast(null as varchar) as mode from dimension where candidate not in (select candidate from named)),
shape as (select candidate, segment, y, case candidate when 'law' then p*(1-d)*(1+t) when 'scaled' then p*(1-d)*(1+t) when 'scaled_with_unit' then p*(1-d)*(1+t) when 'scale_of_wrong_unit' then p*(1-d)*(1+t)
  when 'adds_a_length' then p*(1-d)*(1+t) + 0*q when 'no_discount' then p*(1+t) when 'unrelated' then t end as x from seg, named),
s as (select candidate, sum(x*x) as ff, sum(x*y) as fy, sum(y*y) as yy, count(*) as n, stddev_pop(y) as sd from shape where segment = 'train' and candidate in ('scaled', 'scaled_with_unit', 'scale_of_wrong_unit', 'unrelated') group by candidate),
k as (select candidate, fy/ff as k, sqrt(greatest(yy - fy/ff*fy, 0) / n) / sd as e from s),
fits as (select candidate, 3 as ord, 'fit' as name, e <= 0.5 as passed, e as value, cast(null as varchar) as mode from k),
err as (select candidate, segment, x * coalesce(k, 1) as x, y, case when y <> 0 then abs(x * coalesce(k, 1) - y) / abs(y) end as r from shape left join k using (candidate) where segment <> 'train' and coalesce(e <= 0.5, true)),
gate as (select candidate, segment, case when count(r) >= greatest(3, floor(count(*) / 2)) then quantile_cont(r, 0.5) else 'inf'::double end as v, 1 - count(x) / count(*) as nonfinite from err group by all),
errors as (select candidate, case segment when 'holdout' then 4 else 5 end as ord, segment as name, v <= case segment when 'holdout' then 0.02 else 0.03 end and (segment = 'holdout' or nonfinite < 0.1) as passed, v as value, cast(null as varchar) as mode from gate),
box as (select min(p) as p0, max(p) as p1, min(d) as d0, max(d) as d1, min(t) as t0, max(t) as t1 from law),
probe as (select i, p0 * pow(p1 / p0, 0.5) as pm, d0 + (d1 - d0) * 0.5 as dm, t0 + (t1 - t0) * 0.5 as tm, case when p1 / p0 >= 10 then p0 * pow(p1 / p0, i / 8.0) else p0 + (p1 - p0) * (i / 8.0) end as pi, d0 + (d1 - d0) * (i / 8.0) as di from box, range(0, 9) r(i)),
steps as (select pi * (1-dm) * (1+tm) - lag(pi * (1-dm) * (1+tm)) over (order by i) as by_p, pm * (1-di) * (1+tm) - lag(pm * (1-di) * (1+tm)) over (order by i) as by_d, pm * (1+tm) - lag(pm * (1+tm)) over (order by i) as flat from probe),
scales as (select 'law' as candidate, 6 as ord, 'scale-scaling' as name, (select bool_and(abs((2*pm*(1-dm)*(1+tm)) / (pm*(1-dm)*(1+tm)) - 2) / 2 <= 1e-4) from probe) as passed
  union all select 'law', 7, 'scale-monotonic-1', (select bool_and(by_p > 0) from steps) union all select 'law', 8, 'scale-monotonic-2', (select bool_and(by_d < 0) from steps)
  union all select 'law', 9, 'scale-sign', (select least(p0 * (1-d1) * (1+t0), p0 * (1-d1) * (1+t1)) > 0 from box)
  union all select 'adds_a_length', 7, 'scale-invariance', (select bool_and(abs((pm*(1-dm)*(1+tm)) / (pm*(1-dm)*(1+tm)) - 1) <= 1e-4) from probe)
  union all select 'no_discount', 8, 'scale-monotonic', (select bool_and(flat < 0) from steps)),
listed as (select candidate, row_number() over (order by place, ord) + 5 as ord, name, passed, cast(null as double) as value, mode from (
  select candidate, ord, name, passed, cast(null as varchar) as mode, place from scales join (values ('law', 1), ('scaled', 2), ('scaled_with_unit', 3), ('scale_of_wrong_unit', 4), ('adds_a_length', 5), ('no_discount', 6), ('unrelated', 7), ('undefined_root', 8)) o(candidate, place) using (candidate)
  union all select candidate, 0, 'scale-checks-missing', true, 'skipped', place from (values ('scaled', 2), ('scaled_with_unit', 3), ('scale_of_wrong_unit', 4), ('unrelated', 7), ('undefined_root', 8)) o(candidate, place))),
chk as (select * from dimension union all select * from expression union all select * from fits union all select * from errors union all select candidate, cast(ord as integer), name, passed, value, mode from listed where candidate not in (select candidate from fits where not passed))"""

ORACLE_SQL = {
    "gate_checks": f"{_GATES} select candidate, ord, name, passed, round(value, 6) as value, mode from chk",
    "gate_verdicts": f"""{_GATES}, v as (select candidate, bool_and(passed) as ok, min_by(name, ord) filter (not passed) as first_failed, coalesce(string_agg(name, ',' order by ord) filter (not passed), '') as failed, count(*) as n_checks from chk group by candidate)
      select candidate, case when ok then 'accepted' else 'rejected' end as verdict, first_failed, failed, cast(n_checks as bigint) as n_checks, case when ok then 'passed' when ',' || failed || ',' like '%,expression,%' then 'syntax' when ',' || failed || ',' like '%,fit,%' then 'other family'
        when failed = 'dimension' then 'units' when failed = 'extrapolation' then 'overfitted' else 'revise' end || case when failed like '%scale-%' then ' (shape)' else '' end as hint from v""",
    "gate_tally": f"""{_GATES}, f as (select candidate, min(ord) as first from chk where not passed group by candidate)
      select case when name like 'scale-%' then 'scale' else name end as gate, cast(count(distinct candidate) as bigint) as n_candidates, cast(count(*) filter (not passed) as bigint) as n_failed, cast(count(distinct candidate) filter (ord = first) as bigint) as n_first from chk left join f using (candidate) group by 1""",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
