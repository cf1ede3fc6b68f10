"""Registered query of attacks on the gates: right and wrong formulas of several laws, noise in a law's place, wrong units and malicious texts, all in one batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch
from .queries_generated import SEED, _u
from .sources import generate

BY_NAME = {w.name: w for w in generate.LAWS}
NOISE = 0.005
#: (task, law, whether its target is noise, other units, candidates (name, formula, parameters)).
ATTACKS = (
    ("ideal-gas", "ideal-gas", False, {}, (("right", "n*R*T/V", "R"), ("lost a variable", "R*n*T", "R"))),
    ("kinetic-energy", "kinetic-energy", False, {}, (("right", "m*v**2/2", ""), ("lost a square", "m*v/2", ""), ("twice", "m*v**2", ""), ("free factor", "k*m*v**2", "k"))),
    ("kinetic-energy-wrong-unit", "kinetic-energy", False, {"v": "m/s^2"}, (("right", "m*v**2/2", ""),)),
    ("pendulum-exact", "pendulum-exact", False, {}, (("right", "2*pi*sqrt(L/g)*(1+theta0**2/16)", ""), ("small angles", "2*pi*sqrt(L/g)", ""))),
    ("radioactive-decay", "radioactive-decay", False, {}, (("right", "N0*exp(-t/tau)", ""), ("series", "N0*(1-t/tau+(t/tau)**2/2-(t/tau)**3/6)", ""))),
    ("noise-for-ohm", "ohm", True, {}, (("law", "I*R", ""),)),
    ("noise-for-gravitation", "gravitation", True, {}, (("law", "G*m1*m2/r**2", "G"),)),
    ("ohm", "ohm", False, {}, (("right", "I*R", ""), ("injected", "__import__('os').system('x')", ""), ("cut off", "I*R*", ""), ("condition", "I*R if I > 0 else 0", ""), ("negated", "-I*R", ""), ("sum of units", "I*R+I", ""))),
    ("grav-potential-energy", "grav-potential-energy", False, {}, (("right", "-G*m1*m2/r", "G"), ("sign absorbed", "G*m1*m2/r", "G"), ("wrong power", "G*m1*m2/r**2", "G"))),
)


def law_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops each attack first, over a row for every order; right formulas pass, and so does one whose fitted constant takes over a sign."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = generate.law_rows(orders, "o_orderkey", [BY_NAME[n] for n in dict.fromkeys(law for _, law, *_ in ATTACKS)], SEED, NOISE)
    named = F.array(*(F.struct(F.lit(law).alias("law"), F.lit(task).alias("task"), F.lit(noise).alias("noise")) for task, law, noise, *_ in ATTACKS))
    each = rows.withColumn("a", F.explode(F.filter(named, lambda a: a["law"] == F.col("task_id"))))
    y = F.when(F.col("a.noise"), generate.normal(SEED, F.col("a.task"), F.col("row").cast("string"), "y")).otherwise(F.col("y"))
    data = each.select(F.col("a.task").alias("task_id"), "x", y.alias("y"), "tie")
    tasks = spark.createDataFrame([(t, list(BY_NAME[law].variables), {v: u for v, (u, _, _) in BY_NAME[law].variables.items()} | {"y": BY_NAME[law].unit} | units) for t, law, _, units, _ in ATTACKS], "task_id string, var_names array<string>, units map<string,string>")
    candidates = spark.createDataFrame([(t, n, f, [p] if p else []) for t, *_, c in ATTACKS for n, f, p in c], "task_id string, candidate string, formula string, free array<string>")
    return batch.report(batch.verify(data, tasks, candidates)).select("task_id", "candidate", "verdict", "first_failed", "failed")


def _sql() -> str:
    parts, facts = [], []
    bad = {"injected", "cut off", "condition"}
    for task, name, noise, units, candidates in ATTACKS:
        law = BY_NAME[name]
        widest = max(law.variables, key=lambda v: law.variables[v][2] - law.variables[v][1])
        draws = ", ".join(f"({lo!r}::double) + ({hi!r}::double - {lo!r}::double) * {_u(repr(str(SEED)), repr(name), 'o_orderkey', repr(v))} as v_{v}" for v, (_, lo, hi) in law.variables.items())
        def sql(formula: str, constants: dict, law=law) -> str:
            f = re.sub(r"\bpi\b", "pi()", formula)
            for k, v in constants.items():
                f = re.sub(rf"\b{k}\b", f"({v!r}::double)", f)
            for v in law.variables:
                f = re.sub(rf"(?<![\w.]){v}(?!\w|\()", f"v_{v}", f)
            return f

        def normal(what: str, last: str) -> str:
            r, a = (_u(repr(str(SEED)), repr(what), "o_orderkey", repr(last), repr(x)) for x in "ra")
            return f"sqrt(-2 * ln({r})) * cos({a} * 6.283185307179586)"

        y = normal(task, "y") if noise else f"({sql(law.formula, law.constants)}) * (1 + {NOISE} * {normal(name, 'noise')})"
        for n, f, p in candidates:
            strict = n not in ("lost a square", "twice", "sum of units") and not units or n == "twice"
            facts.append(f"('{task}', '{n}', {str(bool(p)).lower()}, {str(n not in bad).lower()}, {str(strict and n not in bad).lower()})")
            if n not in bad:
                parts.append(f"select '{task}' as task_id, '{n}' as candidate, {str(bool(p)).lower()} as free, tie, v_{widest} as v, {y} as y, {sql(f, {p: 1.0} if p else {})} as f from (select *, md5(concat_ws('|', '{SEED}', '{name}', o_orderkey)) as tie, {draws} from orders)")
    return f"""with rows as ({" union all ".join(parts)}), fact(task_id, candidate, free, known, fits_units) as (values {", ".join(facts)}),
      ranked as (select *, count(*) over w as n, row_number() over (partition by task_id, candidate order by v, substr(tie, 1, 12)) as rk from rows window w as (partition by task_id, candidate)),
      sized as (select *, cast(greatest(6, round_even(0.15 * n, 0)) as bigint) // 2 as tail from ranked), cut as (select *, rk <= tail or rk > n - tail as outside from sized),
      drawn as (select *, row_number() over (partition by task_id, candidate, outside order by substr(md5(tie || '#7'), 1, 12)) as draw from cut),
      seg as (select *, case when outside then 'extrapolation' when draw <= greatest(0, least(round_even(0.2 * n, 0), n - 2 * tail - 10)) then 'holdout' else 'train' end as segment from drawn),
      k as (select task_id, candidate, sum(f*y)/sum(f*f) as k, sqrt(greatest(sum(y*y) - sum(f*y)/sum(f*f)*sum(f*y), 0) / count(*)) / stddev_pop(y) as e from seg where segment = 'train' group by all),
      err as (select task_id, candidate, segment, quantile_cont(abs(f * case when free then k else 1 end - y) / abs(y), 0.5) as r from seg join k using (task_id, candidate) where segment <> 'train' and (not free or e <= 0.5) group by all),
      chk as (select task_id, candidate, 1 as ord, 'dimension' as name, fits_units as passed from fact union all select task_id, candidate, 2, 'expression', false from fact where not known
        union all select task_id, candidate, 3, 'fit', e <= 0.5 from k join fact using (task_id, candidate) where free union all select task_id, candidate, case segment when 'holdout' then 4 else 5 end, segment, r <= case segment when 'holdout' then 0.02 else 0.03 end from err)
      select task_id, candidate, case when bool_and(passed) then 'accepted' else 'rejected' end as verdict, min_by(name, ord) filter (not passed) as first_failed, coalesce(string_agg(name, ',' order by ord) filter (not passed), '') as failed from chk group by task_id, candidate"""


ORACLE_SQL = {"law_attacks": _sql()}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
