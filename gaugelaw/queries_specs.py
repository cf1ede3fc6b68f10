"""Registered query of structural checks from spec rows: all suppliers' candidates against specs of every kind, with some that cannot be probed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import spec_checks

CANDIDATES = {"law": "k*p*(1-d)*(1+t)", "turns": "k*p*(0.06-d)"}
#: (kind, spec); the last ones cannot be probed.
SPECS = (
    ("scaling", '{"var": "p", "expect_power": 1}'), ("scaling", '{"var": "k", "lambda": 3, "expect_power": 1}'), ("invariance", '{"scale": {"p": 1, "k": -1}}'), ("scaling", '{"var": "t", "expect_power": 0}'),
    ("limit", '{"var": "d", "to": 0, "target": "k*p*(1+t)"}'), ("limit", '{"var": "d", "to": 0, "target": "k*p"}'), ("monotonic", '{"var": "p", "samples": 5}'), ("monotonic", '{"var": "d", "direction": "decreasing"}'), ("monotonic", '{"var": "d", "direction": "decreasing", "min_variation": 0.5}'),
    ("sign", '{"expect": "positive"}'), ("sign", '{"expect": "positive", "levels": 2}'), ("sign", '{"expect": "nonzero", "rel_tol": 0.5}'), ("symmetry", '{"swap": ["d", "t"]}'), ("symmetry", '{"swap": ["q", "w"]}'),
    ("twist", '{"var": "p"}'), ("monotonic", '{"var": "z"}'), ("sign", '{"expect": "odd"}'), ("scaling", "{"), ("limit", '{"var": "d", "to": 0, "target": "k*(p"}'), ("symmetry", '{"swap": ["d"]}'), ("limit", '{"var": "d"}'),
)


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of all candidates, as operators.spec_checks makes them."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ends = {"p": "l_extendedprice", "d": "l_discount", "t": "l_tax", "q": "l_quantity", "w": "l_quantity"}
    bounds = [x for v, c in ends.items() for x in (F.lit(v), F.array(F.min(c), F.max(c)))]
    metas = li.groupBy(F.col("l_suppkey").alias("task_id")).agg(F.create_map(*bounds).alias("sampling"))
    ids = metas.select("task_id")
    made = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("spec")) for k, s in SPECS))
    k = (2 + F.col("task_id") % 5).cast("double")
    specs = ids.select("task_id", F.create_map(F.lit("k"), k).alias("nominal"), F.posexplode(made).alias("place", "s")).select("task_id", "nominal", "place", "s.*")
    named = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(f).alias("formula")) for n, f in CANDIDATES.items()))
    fitted = F.when(F.col("candidate") == "turns", F.create_map(F.lit("k"), -k))  # in place of the nominal value
    candidates = ids.select("task_id", F.inline(named)).withColumn("parameters", fitted)
    return spec_checks.run(specs, candidates, metas)


def spec_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks pass each check of each candidate, what the checks measure, and why some could not be made."""
    rows = spec_rows(spark, sf_dir)
    reason = F.coalesce(F.split("reason", ":")[0], F.lit(""))
    return rows.groupBy("candidate", "ord", "name", reason.alias("reason")).agg(F.count_if("passed").alias("passed"), F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


def _sql() -> str:
    mid = lambda v: f"case when {v}0 > 0 then {v}0 * pow({v}1 / {v}0, 0.5) else {v}0 + ({v}1 - {v}0) * 0.5 end"
    level = lambda v, i, n: f"case when {v}0 > 0 then {v}0 * pow({v}1 / {v}0, ({i}) / {n}.0) else {v}0 + ({v}1 - {v}0) * (({i}) / {n}.0) end"
    point = lambda place, i, p="p", d="d", t="t", k="k", role="f", more="": f"select task_id, candidate, {place} as place, {i} as i, '{role}' as role, {p} as p, {d} as d, {t} as t, {k} as k from m{more}"
    probes = [point(0, 0), point(0, 1, p="p * 2"), point(1, 0), point(1, 1, k="k * 3"), point(2, 0), point(2, 1, p="p * 3", k="k / 3"), point(3, 0), point(3, 1, t="t * 2")]
    for place, target in ((4, "g"), (5, "h")):
        for i, part in enumerate((1, 4, 16)):
            probes += [point(place, 2 * i, d=f"0.1 * (d1 - d0) / {part}"), point(place, 2 * i + 1, d=f"0.1 * (d1 - d0) / {part}", role=target)]
    probes.append(point(6, "i", p="case when p1 / p0 >= 10 then p0 * pow(p1 / p0, i / 4.0) else p0 + (p1 - p0) * (i / 4.0) end", more=", range(0, 5) r(i)"))
    probes += [point(place, "i", d="d0 + (d1 - d0) * (i / 8.0)", more=", range(0, 9) r(i)") for place in (7, 8)]
    for place, n in ((9, 4), (10, 2), (11, 4)):
        digit = [f"(i // {n ** (4 - j)}) % {n}" for j in range(5)]  # d, p, q, t, w
        probes += [point(place, -1), point(place, "i", p=level("p", digit[1], n - 1), d=level("d", digit[0], n - 1), t=level("t", digit[3], n - 1), more=f", range(0, {min(511, n ** 5)}) r(i)")]
    a, b = "greatest(d0, t0)", "least(d1, t1)"
    x, y = (f"case when {a} > 0 then {a} * pow({b} / {a}, {s}) else {a} + ({b} - {a}) * {s} end" for s in (0.25, 0.75))
    probes += [point(12, 0, d=x, t=y), point(12, 1, d=y, t=x), point(13, 0), point(13, 1)]
    names = ("scaling-p", "scaling-k", "invariance-k-p", "scaling-t", "limit-d", "limit-d-2", "monotonic-p", "monotonic-d", "monotonic-d-2", "sign-positive", "sign-positive-2", "sign-nonzero", "symmetry-d-t", "symmetry-q-w")
    bad = ((14, "twist-p", "unknown kind"), (15, "monotonic-z", "unknown variable"), (16, "sign-odd", "unknown sign"), (17, "scaling-positive", "no JSON"), (18, "limit-d-3", "no formula"), (19, "symmetry-d", "no two variables"), (20, "limit-d-4", "no limit"))
    return f"""with e as (select l_suppkey as task_id, min(l_extendedprice) as p0, max(l_extendedprice) as p1, min(l_discount) as d0, max(l_discount) as d1, min(l_tax) as t0, max(l_tax) as t1 from lineitem group by l_suppkey),
      m as (select *, {mid("p")} as p, {mid("d")} as d, {mid("t")} as t, case candidate when 'law' then 1 else -1 end * (2.0 + task_id % 5) as k from e, (values ('law'), ('turns')) c(candidate)),
      probe as ({" union all ".join(probes)}),
      y as (select task_id, candidate, place, i, case when role = 'g' then k*p*(1+t) when role = 'h' then k*p when candidate = 'law' then k*p*(1-d)*(1+t) else k*p*(0.06-d) end as y from probe),
      s as (select *, y - lag(y) over (partition by task_id, candidate, place order by i) as step from y),
      a as (select task_id, candidate, place, list(y order by i) as l, max(abs(y)) as big, count(*) as n, count(*) filter (y > 0) as up, count(*) filter (y <> 0) as nz, bool_and(step > 1e-12 * abs(step) and step > 0) as rises, bool_and(step < 0) as falls from s group by all),
      lim as (select *, [abs(l[2*i+1] - l[2*i+2]) / abs(l[2*i+2]) for i in range(0, 3)] as e from a where place in (4, 5)),
      r as (select task_id, candidate, place, l[2] / l[1] as value, l[1] * l[2] > 0 and abs(l[2] / l[1] - case place when 0 then 2 when 1 then 3 else 1 end) / case place when 0 then 2 when 1 then 3 else 1 end <= 1e-4 as ok from a where place < 4
        union all select task_id, candidate, place, e[3], e[2] <= e[1] + 1e-12 and e[3] <= e[2] + 1e-12 and (least(e[1], e[2], e[3]) <= 1e-3 or ((e[1] <= 0 or e[2] / e[1] <= 0.5) and (e[2] <= 0 or e[3] / e[2] <= 0.5))) from lim
        union all select task_id, candidate, place, abs(l[-1] - l[1]) / big, case place when 6 then rises else falls end and abs(l[-1] - l[1]) / big >= case place when 8 then 0.5 else 1e-3 end from a where place in (6, 7, 8)
        union all select task_id, candidate, place, case place when 11 then nz else up end / n, case place when 11 then nz / n >= 0.5 else up = n end from a where place in (9, 10, 11)
        union all select task_id, candidate, place, abs(l[1] - l[2]) / greatest(abs(l[1]), abs(l[2])), abs(l[1] - l[2]) / greatest(abs(l[1]), abs(l[2])) <= 1e-4 from a where place > 11),
      named(place, name) as (values {", ".join(f"({i}, '{n}')" for i, n in enumerate(names))}),
      bad(place, name, reason) as (values {", ".join(map(str, bad))})
      select candidate, cast(place as integer) as ord, 'scale-' || name as name, '' as reason, cast(count(*) filter (ok) as bigint) as passed, cast(count(*) as bigint) as n, round(min(value), 6) as least, round(max(value), 6) as most from r join named using (place) group by all
      union all select candidate, place, 'scale-' || name, reason, 0, count(*), null, null from m, bad group by all"""


ORACLE_SQL = {"spec_verdicts": _sql()}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
