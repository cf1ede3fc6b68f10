"""Registered queries of the time-series line: daily bands, anomalies, forecasts by lead and parameter inversion.

Event types stand for bands and days for years. A band's neighbours are those before and behind it in
alphabetical order; at the ends the difference to the missing neighbour is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.fit import fit_two, two_sums


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (day long, band, i int, v): the mean value of each band on each day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = e.groupBy(F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.col("event_type").alias("band")).agg(F.avg("value").alias("v"))
    # one row for each band: as many as there are event types
    number = daily.select("band").distinct().agg(F.array_sort(F.collect_set("band")).alias("b")).select(F.posexplode("b").alias("i", "band"))
    return daily.join(F.broadcast(number), "band").select("day", "band", "i", "v")


BANDS_SQL = """daily as (select cast(date_diff('day', date '1970-01-01', cast(ts as date)) as bigint) as day, event_type as band, avg(value) as v from events group by all),
b as (select day, band, dense_rank() over (order by band) - 1 as i, v from daily)"""

STEPS_SQL = """m as (select i, avg(v) as m from b group by i), x as (select day, b.i, v - m as x from b join m on b.i = m.i),
      s as (select a.day, a.i, a.x, coalesce(l.x - a.x, 0) + coalesce(r.x - a.x, 0) as f, n.x - a.x as d from x a left join x l on l.day = a.day and l.i = a.i - 1 left join x r on r.day = a.day and r.i = a.i + 1 join x n on n.day = a.day + 1 and n.i = a.i),
      q as (select sum(f*f) as s11, sum(-f*x) as s12, sum(x*x) as s22, sum(f*d) as s1b, sum(-x*d) as s2b, sum(d*d) as sbb, count(*) as n from s)"""


def daily_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band's distance from the day's weighted mean over the bands (weights 1, 2, ...)."""
    b = bands(spark, sf_dir).withColumn("w", F.col("i") + 1)
    over = Window.partitionBy("day")
    return b.select("day", "band", F.round(F.col("v") - F.sum(F.col("w") * F.col("v")).over(over) / F.sum("w").over(over), 6).alias("anomaly"))


def lead_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square errors of persistence and climatology forecasts by lead of 1 to 10 days."""
    b = bands(spark, sf_dir)
    mean = b.groupBy("band").agg(F.avg("v").alias("m"))
    ahead = b.select("band", "v", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.struct(k.alias("lead"), (F.col("day") + k).alias("day")))).alias("a")).select("band", F.col("a.lead").alias("lead"), F.col("a.day").alias("day"), F.col("v").alias("was"))
    j = ahead.join(b.select("band", "day", "v"), ["band", "day"]).join(F.broadcast(mean), "band")
    rmse = lambda x: F.round(F.sqrt(F.avg((F.col("v") - F.col(x)) * (F.col("v") - F.col(x)))), 6)
    return j.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), rmse("was").alias("persistence"), rmse("m").alias("climatology"))


def steps(b: DataFrame) -> DataFrame:
    """Rows (day, i, x, flow, then): each band's anomaly, its neighbours' differences and the next day's anomaly."""
    mean = b.groupBy("i").agg(F.avg("v").alias("m"))
    x = b.join(F.broadcast(mean), "i").select("day", "i", (F.col("v") - F.col("m")).alias("x"))
    day = Window.partitionBy("day").orderBy("i")
    near = lambda c, k: F.when(c.isNotNull() & (F.abs(k - F.col("i")) == 1), c - F.col("x")).otherwise(0.0)
    flow = near(F.lag("x").over(day), F.lag("i").over(day)) + near(F.lead("x").over(day), F.lead("i").over(day))
    state = x.withColumn("flow", flow)
    nxt = x.select((F.col("day") - 1).alias("day"), "i", F.col("x").alias("then"))
    return state.join(nxt, ["day", "i"])


def step_sums(b: DataFrame) -> DataFrame:
    """One row of the sums that fit each day's step to the flow and the anomaly."""
    return two_sums(steps(b), F.col("flow"), -F.col("x"), F.col("then") - F.col("x"))


def lsq_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange and loss rates of the bands: least squares of each day's step on the neighbours' differences and the anomaly."""
    f = fit_two(steps(bands(spark, sf_dir)), F.col("flow"), -F.col("x"), F.col("then") - F.col("x"))
    return f.select(F.round("k1", 6).alias("kd"), F.round("k2", 6).alias("kl"), F.round("rmse", 6).alias("rmse"), ((F.col("k1") >= 0) & (F.col("k2") >= 0)).alias("admissible"))


def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which each band rose, fell or stayed, and where its largest step was."""
    b = bands(spark, sf_dir).withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("band").orderBy("day")))
    return b.groupBy("band").agg(F.count_if(F.col("d") > 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"), F.max_by("day", F.struct(F.abs("d"), -F.col("day"))).alias("peak_day"))


def lsq_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit with the bands at both ends held fixed: their equations drop out, and only days up to the last tenth train."""
    b = bands(spark, sf_dir)
    ends = b.agg(F.max("i").alias("top"), F.min("day").alias("first"), F.max("day").alias("last"))
    inner = steps(b).join(F.broadcast(ends)).filter("i > 0 and i < top and day between first and last - (last - first) div 10")  # one row
    f = fit_two(inner, F.col("flow"), -F.col("x"), F.col("then") - F.col("x"))
    return f.select(F.round("k1", 6).alias("kd"), F.round("k2", 6).alias("kl"), F.round("rmse", 6).alias("rmse"))


def operator(n: int, kd: float, kl: float) -> np.ndarray:
    """The step of n bands as a matrix: exchange with the neighbours, and loss; nothing flows over the ends."""
    flow = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    return np.eye(n) + kd * (flow - np.diag(flow.sum(1))) - kl * np.eye(n)


def forecast(states: DataFrame, matrices: list[np.ndarray]) -> DataFrame:
    """Rows (day, lead, i, x): the forecast of each lead from each day's state array, by the operator of this lead."""
    rows = F.array(*(F.struct(F.lit(k).alias("lead"), F.array(*(F.array(*map(F.lit, map(float, row))) for row in m)).alias("m")) for k, m in enumerate(matrices, 1)))
    each = states.select("day", "state", F.inline(rows))
    made = F.transform("m", lambda row: F.aggregate(F.zip_with(row, "state", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return each.select("day", "lead", F.posexplode(made).alias("i", "x"))


def forecast_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the fitted model's forecasts by lead of 1 to 10 days, from every day on which all bands have a value; lead 1 is its one-step score."""
    b = bands(spark, sf_dir)
    k = fit_two(steps(b), F.col("flow"), -F.col("x"), F.col("then") - F.col("x")).first()  # two numbers
    mean = b.groupBy("i").agg(F.avg("v").alias("m"))
    x = b.join(F.broadcast(mean), "i").select("day", "i", (F.col("v") - F.col("m")).alias("x"))
    n = mean.count()  # as many as there are bands
    states = x.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("state")).filter(F.size("state") == n)
    step = operator(n, k["k1"], k["k2"])
    made = forecast(states, [np.linalg.matrix_power(step, lead) for lead in range(1, 11)])
    made = made.select((F.col("day") + F.col("lead")).alias("day"), "i", "lead", F.col("x").alias("said"))
    j = made.join(x, ["day", "i"])
    return j.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg((F.col("said") - F.col("x")) * (F.col("said") - F.col("x")))), 6).alias("model"))


ORACLE_SQL = {
    "lsq_interior": f"""with {BANDS_SQL}, {STEPS_SQL}, z as (select max(i) as top from b), dd as (select min(day) as d0, max(day) as d1 from b), r as (select s.* from s, z, dd where i > 0 and i < top and day between d0 and d1 - (d1 - d0) // 10),
      q2 as (select sum(f*f) as s11, sum(-f*x) as s12, sum(x*x) as s22, sum(f*d) as s1b, sum(-x*d) as s2b, sum(d*d) as sbb, count(*) as n from r), k as (select (s1b*s22 - s2b*s12) / (s11*s22 - s12*s12) as k1, (s11*s2b - s12*s1b) / (s11*s22 - s12*s12) as k2, * from q2)
      select round(k1, 6) as kd, round(k2, 6) as kl, round(sqrt(greatest(sbb - k1*s1b - k2*s2b, 0) / n), 6) as rmse from k""",
    "forecast_curve": f"""with recursive {BANDS_SQL}, {STEPS_SQL}, k as (select (s1b*s22 - s2b*s12) / (s11*s22 - s12*s12) as kd, (s11*s2b - s12*s1b) / (s11*s22 - s12*s12) as kl from q),
      state as (select day, list(x order by i) as s from x group by day having count(*) = (select count(*) from m)),
      run(lead, day, s) as (select 0, day, s from state union all select lead + 1, day, list_transform(range(1, len(s) + 1), lambda j: s[j] + kd * (case when j > 1 then s[j - 1] - s[j] else 0 end + case when j < len(s) then s[j + 1] - s[j] else 0 end) - kl * s[j]) from run, k where lead < 10),
      said as (select lead, day + lead as day, unnest(range(len(s))) as i, unnest(s) as said from run where lead > 0)
      select cast(lead as int) as lead, cast(count(*) as bigint) as n, round(sqrt(avg((said - x) * (said - x))), 6) as model from said join x using (day, i) group by lead""",
    "daily_anomaly": f"with {BANDS_SQL} select day, band, round(v - sum((i + 1) * v) over (partition by day) / sum(i + 1) over (partition by day), 6) as anomaly from b",
    "lead_curves": f"with {BANDS_SQL}, m as (select band, avg(v) as m from b group by band), j as (select k as lead, a.v as was, c.v, m from b a, range(1, 11) r(k), b c, m where c.band = a.band and c.day = a.day + k and m.band = a.band) select cast(lead as integer) as lead, cast(count(*) as bigint) as n, round(sqrt(avg((v - was) * (v - was))), 6) as persistence, round(sqrt(avg((v - m) * (v - m))), 6) as climatology from j group by lead",
    "lsq_identify": f"""with {BANDS_SQL}, {STEPS_SQL},
      k as (select (s1b*s22 - s2b*s12) / (s11*s22 - s12*s12) as k1, (s11*s2b - s12*s1b) / (s11*s22 - s12*s12) as k2, * from q)
      select round(k1, 6) as kd, round(k2, 6) as kl, round(sqrt(greatest(sbb - k1*s1b - k2*s2b, 0) / n), 6) as rmse, k1 >= 0 and k2 >= 0 as admissible from k""",
    "ordered_steps": f"with {BANDS_SQL}, s as (select band, day, v - lag(v) over (partition by band order by day) as d from b) select band, cast(count(*) filter (d > 0) as bigint) as rises, cast(count(*) filter (d < 0) as bigint) as falls, arg_min(day, (-abs(d), day)) as peak_day from s where d is not null group by band",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
