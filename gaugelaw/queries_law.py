"""Registered queries of the formula engine: laws over lineitem and part, their splits, metrics, gates and controls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formula import compile_formula, normalise
from .operators import fit, metrics, scale
from .plans import split
from .plans.stored import stored

VARIABLES = {"p": F.col, "d": F.col, "t": F.col}
LAW = "p*(1-d)*(1+t)"
CANDIDATES = {"law": LAW, "no_tax": "p*(1-d)", "no_discount": "p*(1+t)", "wrong_power": "p*(1-d)**2*(1+t)", "inverse_tax": "p*(1-d)/(1+t)", "log_price": "log(p)*(1-d)", "undefined": "sqrt(0-p)"}
NOISE = {"price": "p", "quantity": "q", "product": "p*q", "ratio": "p/q", "root": "sqrt(p*q)", "line": "p+q"}
SEEDS = (7, 11, 13, 17, 19)


def columns(names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (p, d, t, q, flag, tie, y); y is the law with a relative noise taken from a hash of the row."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = [F.floor(F.col(c) * 100 + 0.5) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    tie = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *cents))
    rows = li.select(F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"), tie.alias("tie"), F.col("l_partkey").alias("partkey"))
    noise = (F.instr(F.lit("0123456789abcdef"), F.substring("tie", 1, 1)) - 8.5) / 7.5 * 0.004
    return rows.withColumn("y", compile_formula(LAW, columns("pdt")) * (1 + noise))


BASE_SQL = """base as (select l_extendedprice as p, l_discount as d, l_tax as t, l_quantity as q, l_returnflag as flag, l_partkey as partkey,
  md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(floor(l_quantity * 100 + 0.5) as bigint), cast(floor(l_extendedprice * 100 + 0.5) as bigint),
    cast(floor(l_discount * 100 + 0.5) as bigint), cast(floor(l_tax * 100 + 0.5) as bigint))) as tie from lineitem),
law as (select *, p * (1 - d) * (1 + t) * (1 + (strpos('0123456789abcdef', substr(tie, 1, 1)) - 8.5) / 7.5 * 0.004) as y from base)"""


def split_sql(seed: int = 7, suffix: str = "") -> str:
    return f"""ranked{suffix} as (select *, row_number() over (order by p, tie) as rk, count(*) over () as n from law),
cut{suffix} as (select *, cast(greatest(6, round_even(0.15 * n, 0)) as bigint) // 2 as tail from ranked{suffix}),
out{suffix} as (select *, rk <= tail or rk > n - tail as outside from cut{suffix}),
drawn{suffix} as (select *, row_number() over (partition by outside order by md5(tie || '#{seed}'), tie) as draw from out{suffix}),
seg{suffix} as (select *, case when outside then 'extrapolation' when draw <= greatest(0, least(round_even(0.2 * n, 0), n - 2 * tail - 10)) then 'holdout' else 'train' end as segment from drawn{suffix})"""


SEG = f"with {BASE_SQL}, {split_sql()}"


def segments(spark: SparkSession, sf_dir: str, seed: int = 7) -> DataFrame:
    return split.three_way(laws(spark, sf_dir), "p", F.col("tie"), seed)


METRIC_SQL = """select {by}, cast(count(*) as bigint) as n, cast(case when count(df) >= greatest(3, floor(count(*) / 2)) then count(r) else 0 end as bigint) as n_relative, 1 - count(df) / count(*) as nonfinite_ratio, """ + ", ".join(
    f"round(case when count({c}) >= greatest(3, floor(count(*) / 2)) then {e} else 'inf'::double end, {d}) as {n}" for n, c, d, e in (
        ("rmse", "df", 4, "sqrt(avg(df * df))"), ("relative_error_median", "r", 8, "quantile_cont(r, 0.5)"), ("relative_error_p75", "r", 8, "quantile_cont(r, 0.75)"), ("relative_error_p90", "r", 8, "quantile_cont(r, 0.9)"), ("rmsre", "r", 8, "sqrt(avg(r * r))"),
        ("max_relative_error", "r", 8, "max(r)"), ("relative_rmse", "df", 8, "sqrt(avg(df * df)) / case when quantile_cont(abs(tt), 0.5) > 0 then quantile_cont(abs(tt), 0.5) when sqrt(avg(tt * tt)) > 0 then sqrt(avg(tt * tt)) else 1 end"),
        ("normalized_rmse", "df", 8, "sqrt(avg(df * df)) / case when stddev_pop(tt) > 0 then stddev_pop(tt) else 1 end")))
PRED_SQL = """pred as (select flag, segment, candidate, y, case candidate when 'law' then p*(1-d)*(1+t) when 'no_tax' then p*(1-d) when 'no_discount' then p*(1+t) when 'wrong_power' then p*pow(1-d,2)*(1+t)
  when 'inverse_tax' then p*(1-d)/(1+t) when 'log_price' then ln(p)*(1-d) end as x from seg, (values ('law'),('no_tax'),('no_discount'),('wrong_power'),('inverse_tax'),('log_price'),('undefined')) c(candidate)),
err as (select *, x - y as df, case when x is not null then y end as tt, case when x is not null and y <> 0 then abs(x - y) / abs(y) end as r from pred)"""
GATE_SQL = """gate as (select candidate, segment, case when count(r) >= greatest(3, floor(count(*) / 2)) then quantile_cont(r, 0.5) else 'inf'::double end as v, 1 - count(df) / count(*) as nonfinite from err where segment <> 'train' group by all),
chk as (select *, v <= case segment when 'holdout' then 0.02 else 0.03 end and (segment = 'holdout' or nonfinite < 0.1) as ok, case segment when 'holdout' then 1 else 2 end as ord from gate)"""


def _measured(spark: SparkSession, sf_dir: str, by: list[str], formulas: dict[str, str] = CANDIDATES) -> DataFrame:
    keep = [c for c in by if c != "candidate"]
    seg = stored(segments(spark, sf_dir).select("p", "d", "t", "q", "y", *keep), "segments")
    return metrics.error_metrics(metrics.predictions(seg, formulas, columns("pdtq"), keep), by)


def law_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All error metrics by candidate and segment: one split, one scan, one grouped aggregate."""
    m = _measured(spark, sf_dir, ["candidate", "segment"], {k: v for k, v in CANDIDATES.items() if k != "undefined"})
    return m.select("candidate", "segment", "n", "n_relative", F.round("rmse", 4).alias("rmse"), "nonfinite_ratio", *(F.round(c, 8).alias(c) for c in ("relative_error_median", "relative_error_p75", "relative_error_p90", "max_relative_error", "rmsre", "relative_rmse", "normalized_rmse")))


def sparse_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are mostly zero: few relative errors, all right, must not let a formula through whose other errors are large."""
    rows = laws(spark, sf_dir).select("flag", "p", F.when(F.col("q") == 7, F.col("p")).otherwise(0.0).alias("y"))
    made = {"price": "p", "fifty": "p*0 + 50", "none": "log(0-p)"}
    m = metrics.error_metrics(metrics.predictions(rows, made, columns("p"), ["flag"]), ["candidate", "flag"])
    return m.select("candidate", "flag", "n", "n_finite", "n_relative", "nonfinite_ratio", *(F.round(c, 8).alias(c) for c in ("relative_error_median", "max_relative_error", "rmse")), (F.col("relative_error_median") <= 0.02).alias("passed"))


def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout and extrapolation gates over all candidates, and the verdict on each."""
    return metrics.verdicts(metrics.checks(_measured(spark, sf_dir, ["candidate", "segment"]), ["candidate"]), ["candidate"])


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each pair of thresholds lets through."""
    m = _measured(spark, sf_dir, ["candidate", "segment"]).filter("segment = 'holdout'").select("candidate", "relative_error_median")
    grid = spark.range(1, 11).select((F.col("id") * 0.01).alias("threshold"))
    return m.join(F.broadcast(grid), F.col("relative_error_median") > F.col("threshold"), "right").groupBy(F.round("threshold", 2).alias("threshold")).agg(F.count("candidate").alias("rejected"))


def seed_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the law and a mutant under several draws of the held-out rows."""
    base = stored(split.seeded(laws(spark, sf_dir), "p", F.col("tie"), list(SEEDS)).select("p", "d", "t", "y", *(f"segment_{s}" for s in SEEDS)), "segments")
    each = F.array(*(F.struct(F.lit(s).alias("seed"), F.col(f"segment_{s}").alias("segment")) for s in SEEDS))
    parts = base.select("p", "d", "t", "y", F.inline(each))
    rows = metrics.predictions(parts, {k: CANDIDATES[k] for k in ("law", "no_tax")}, columns("pdt"), ["seed", "segment"])
    v = metrics.verdicts(metrics.checks(metrics.error_metrics(rows, ["seed", "candidate", "segment"]), ["seed", "candidate"]), ["seed", "candidate"])
    return v.groupBy("candidate").agg(F.count_distinct("verdict").alias("n_verdicts"), F.min("verdict").alias("verdict"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, target range and an order-free fingerprint of each segment."""
    return split.fingerprint(segments(spark, sf_dir), F.col("tie"), y_min=F.round(F.min("y"), 4), y_max=F.round(F.max("y"), 4))


def split_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.support(segments(spark, sf_dir), ["p", "d", "t"])


def split_axis_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_axis(laws(spark, sf_dir), ["p", "d", "t", "q"])


def extrapolation_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.outside_support(segments(spark, sf_dir), "p")


def layer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rates by layer and overall, in one rollup."""
    rows = metrics.predictions(laws(spark, sf_dir), {k: CANDIDATES[k] for k in ("law", "no_tax")}, columns("pdt"), ["flag"])
    good = F.abs(F.col("pred") - F.col("truth")) <= 0.02 * F.abs("truth")
    return rows.rollup("candidate", "flag").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("matches")).select(F.coalesce("candidate", F.lit("all")).alias("candidate"), F.coalesce("flag", F.lit("all")).alias("layer"), "n", "matches")


def error_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout against extrapolation error of each candidate, as a pivot."""
    m = _measured(spark, sf_dir, ["candidate", "segment"], {k: v for k, v in CANDIDATES.items() if k != "undefined"})
    return m.groupBy("candidate").pivot("segment", ["holdout", "extrapolation"]).agg(F.round(F.first("relative_error_median"), 8))


def fit_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale k of y = k f fitted on the training segment for each candidate, with the fit gate."""
    seg = segments(spark, sf_dir).filter("segment = 'train'")
    rows = metrics.predictions(seg, {k: v for k, v in CANDIDATES.items() if k not in ("undefined",)}, columns("pdt"), [])
    f = fit.fit_scale(rows, F.col("pred"), F.col("truth"), ["candidate"])
    return f.select("candidate", F.round("k", 8).alias("k"), F.round("fit_error", 5).alias("fit_error"), (F.col("fit_error") <= 0.5).alias("passed"))


def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of unrelated columns, scaled to fit, against a target without a law: none may be accepted."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("y"))
    rows = laws(spark, sf_dir).drop("y").join(part, "partkey")
    made = metrics.predictions(rows, NOISE, columns("pq"), [])
    k = fit.fit_scale(made, F.col("pred"), F.col("truth"), ["candidate"])
    return k.select("candidate", F.round("k", 8).alias("k"), F.when(F.col("fit_error") > 0.5, "fit").otherwise("accepted").alias("first_failed"))


def retail_narrow_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line fitted in a narrow window of part keys holds there and fails outside: errors inside and outside, and where the worst is."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    line = fit.fit_line(part.filter("x < 1000"), F.col("x"), F.col("y"))
    rows = part.join(F.broadcast(line)).select("x", (F.col("x") < 1000).alias("inside"), (F.abs(F.col("a") + F.col("b") * F.col("x") - F.col("y")) / F.col("y")).alias("e"), "a", "b")  # one row of constants
    return rows.groupBy("inside").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("a"), 4).alias("a"), F.round(F.max("b"), 6).alias("b"), F.round(F.percentile("e", 0.5), 6).alias("median_error"), F.round(F.max("e"), 6).alias("max_error"), F.max_by("x", F.struct(F.round("e", 6), -F.col("x"))).alias("worst_at"))


def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laws(spark, sf_dir).agg(*(f(v).alias(f"{v}_{n}") for v in "pdtq" for n, f in (("lo", F.min), ("hi", F.max))))


SCALE_CHECKS = lambda: {
    "scaling_price": scale.scaling(LAW, list("pdt"), ["p"], 2.0, 1.0),
    "scaling_wrong": scale.scaling(LAW, list("pdt"), ["p"], 2.0, 2.0),
    "invariance": scale.scaling("p/q*(1-d)", list("pdq"), ["p", "q"], 3.0, 0.0),
    "limit_no_discount": scale.limit(LAW, "p*(1+t)", list("pdt"), "d"),
    "limit_wrong": scale.limit(LAW, "p", list("pdt"), "d"),
    "limit_rewritten": scale.limit("p*(1+t) - d*p*(1+t)", LAW, list("pdt"), "d"),
    "limit_of_zero": scale.limit("d*p + 1e-12*p", "d*p - d*p", list("pd"), "d"),
    "monotonic_flat": scale.monotonic("1000 + 0.01*d", ["d"], "d"),
    "sign_in_the_middle": scale.sign("(p - 10490)**2 + d - 0.05", list("pd")),
    "monotonic_price": scale.monotonic(LAW, list("pdt"), "p"),
    "monotonic_discount": scale.monotonic(LAW, list("pdt"), "d", increasing=False),
    "monotonic_wrong": scale.monotonic("(d-0.04)**2", ["d"], "d"),
    "sign_positive": scale.sign(LAW, list("pdt")),
    "sign_negative": scale.sign(LAW, list("pdt"), "negative"),
    "symmetry": scale.symmetry("d*t", list("dt"), "d", "t"),
    "symmetry_wrong": scale.symmetry("d/(1+t)", list("dt"), "d", "t"),
}


def scale_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All structural checks in one projection of the ranges of one scan."""
    made = F.array(*(F.struct(F.lit(n).alias("name"), c["passed"].alias("passed"), F.round(c["value"], 6).alias("value")) for n, c in SCALE_CHECKS().items()))
    return _box(spark, sf_dir).select(F.inline(made))


def _sql(formula: str, **places: str) -> str:
    """A formula as SQL, with a place for each variable."""
    return re.sub(r"\b([pdtqy])\b", lambda m: f"({places[m[1]]})", formula)


def _sql_at(v: str, t: float) -> str:
    return f"case when {v}_lo > 0 then {v}_lo * pow({v}_hi / {v}_lo, {t}) else {v}_lo + ({v}_hi - {v}_lo) * {t} end"


def _scale_sql() -> str:
    """The probes and their judgement as SQL over the same ranges."""
    mid = {v: _sql_at(v, 0.5) for v in "pdtq"}
    rows = []

    def scaling(name: str, f: str, scaled: str, factor: float, exponent: float) -> None:
        y0, y1 = _sql(f, **mid), _sql(f, **mid | {v: f"{factor} * ({mid[v]})" for v in scaled})
        rows.append(f"select '{name}' as name, abs(({y1}) / ({y0}) - pow({factor}, {exponent})) / pow({factor}, {exponent}) <= 1e-4 and sign({y0}) = sign({y1}) as passed, ({y1}) / ({y0}) as value from box")

    def limit(name: str, f: str, target: str) -> None:
        at = [mid | {"d": f"0.1 * (d_hi - d_lo) / {part}"} for part in (1.0, 4.0, 16.0)]
        pairs = ", ".join(f"{_sql(f, **p)} as g{i}, {_sql(target, **p)} as w{i}" for i, p in enumerate(at))
        size = "case when greatest(abs(w0), abs(w1), abs(w2)) > 0 then greatest(abs(w0), abs(w1), abs(w2)) else 1 end"
        errors = ", ".join(f"abs(g{i} - w{i}) / case when abs(w{i}) > 1e-9 * size then abs(w{i}) else size end as e{i}" for i in range(3))
        rows.append(f"select '{name}', e1 <= e0 + 1e-12 and e2 <= e1 + 1e-12 and (least(e0, e1, e2) <= 1e-3 or ((e0 <= 0 or e1 / e0 <= 0.5) and (e1 <= 0 or e2 / e1 <= 0.5))), e2 from (select {errors} from (select *, {size} as size from (select {pairs} from box)))")

    def monotonic(name: str, f: str, v: str, up: int) -> None:
        x = f"case when {v}_lo > 0 and {v}_hi / {v}_lo >= 10 then {v}_lo * pow({v}_hi / {v}_lo, i / 8.0) else {v}_lo + ({v}_hi - {v}_lo) * (i / 8.0) end"
        probes = f"select i, {_sql(f, **mid | {v: x})} as y from box, range(0, 9) r(i)"
        steps = f"select i, y, {up} * (y - lag(y) over (order by i)) / max(abs(y)) over () > 1e-12 as good from ({probes})"
        rows.append(f"select '{name}', bool_and(good) and abs(max_by(y, i) - min_by(y, i)) / max(abs(y)) >= 1e-3, abs(max_by(y, i) - min_by(y, i)) / max(abs(y)) from ({steps})")

    def sign(name: str, f: str, condition: str) -> None:
        grid = {v: f"case when {v}_lo > 0 then {v}_lo * pow({v}_hi / {v}_lo, {v}i / 3.0) else {v}_lo + ({v}_hi - {v}_lo) * ({v}i / 3.0) end" for v in "pdt"}
        every = f"select {_sql(f, **grid)} as y from box, range(0, 4) a(pi), range(0, 4) b(di), range(0, 4) c(ti) union all select {_sql(f, **mid)} from box"
        rows.append(f"select '{name}', avg(case when y {condition} then 1.0 else 0.0 end) >= 1, avg(case when y {condition} then 1.0 else 0.0 end) from ({every})")

    def symmetry(name: str, f: str) -> None:
        a, b = "least(d_hi, t_hi)", "greatest(d_lo, t_lo)"
        p, q = (f"case when {b} > 0 then {b} * pow({a} / {b}, {t}) else {b} + ({a} - {b}) * {t} end" for t in (0.25, 0.75))
        y0, y1 = _sql(f, **mid | {"d": p, "t": q}), _sql(f, **mid | {"d": q, "t": p})
        rows.append(f"select '{name}', {b} < {a} and abs(({y0}) - ({y1})) / greatest(abs({y0}), abs({y1})) <= 1e-4, abs(({y0}) - ({y1})) / greatest(abs({y0}), abs({y1})) from box")

    scaling("scaling_price", LAW, "p", 2.0, 1.0)
    scaling("scaling_wrong", LAW, "p", 2.0, 2.0)
    scaling("invariance", "p/q*(1-d)", "pq", 3.0, 0.0)
    limit("limit_no_discount", LAW, "p*(1+t)")
    limit("limit_wrong", LAW, "p")
    limit("limit_rewritten", "p*(1+t) - d*p*(1+t)", LAW)
    limit("limit_of_zero", "d*p + 1e-12*p", "d*p - d*p")
    monotonic("monotonic_flat", "1000 + 0.01*d", "d", 1)
    sign("sign_in_the_middle", "pow(p - 10490, 2) + d - 0.05", "> 0")
    monotonic("monotonic_price", LAW, "p", 1)
    monotonic("monotonic_discount", LAW, "d", -1)
    monotonic("monotonic_wrong", "(d-0.04)**2", "d", 1)
    sign("sign_positive", LAW, "> 0")
    sign("sign_negative", LAW, "< 0")
    symmetry("symmetry", "d*t")
    symmetry("symmetry_wrong", "d/(1+t)")
    return f"with {BASE_SQL}, box as (select min(p) as p_lo, max(p) as p_hi, min(d) as d_lo, max(d) as d_hi, min(t) as t_lo, max(t) as t_hi, min(q) as q_lo, max(q) as q_hi from law) select name, passed, round(value, 6) as value from (" + " union all ".join(rows) + ")"


def numeric_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest scaled deviation of rewritten formulas from the law over all rows."""
    forms = {"expanded": "p - p*d + p*t - p*d*t", "reordered": "(1+t)*p*(1-d)", "shifted": "p*(1-d)*(1+t) + 0.01", "no_tax": "p*(1-d)"}
    base = laws(spark, sf_dir).withColumn("y", compile_formula(LAW, columns("pdt")))
    rows = metrics.predictions(base, forms, columns("pdt"), [])
    deviation = F.max(F.abs(F.col("pred") - F.col("truth"))) / F.max(F.abs("truth"))
    return rows.groupBy("candidate").agg(F.round(deviation, 9).alias("deviation"), (deviation <= 1e-6).alias("equivalent"))


def profile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law along one variable at 320 points, the others at their medians."""
    m = laws(spark, sf_dir).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.percentile("d", 0.5).alias("d"), F.percentile("t", 0.5).alias("t"))
    at = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(319)))).withColumn("p", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 319.0)
    return at.select("i", F.round("p", 4).alias("p"), F.round(compile_formula(LAW, columns("pdt")), 4).alias("y"))


def seed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of a grid of start values by the cost of y = k p, from sums of one scan: the grid never meets the rows."""
    s = laws(spark, sf_dir).agg(F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("y")).alias("py"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))
    grid = s.withColumn("i", F.explode(F.sequence(F.lit(-45), F.lit(45)))).withColumn("k", F.pow(F.lit(10.0), F.col("i") / 15.0))
    cost = F.sqrt((F.col("yy") - 2 * F.col("k") * F.col("py") + F.col("k") * F.col("k") * F.col("pp")) / F.col("n"))
    return grid.select("i", F.round("k", 8).alias("k"), F.round(cost, 3).alias("cost")).orderBy("cost", "i").limit(10)


def formula_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts of formulas that each brand of part stands for, and how many parts share one."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit(" Size ** 2 * "), F.col("p_brand"), F.lit(" / R "))
    return part.groupBy(normalise(text).alias("formula")).agg(F.count(F.lit(1)).alias("n"))


_m = METRIC_SQL.format(by="candidate, segment")
ORACLE_SQL = {
    "law_metrics": f"{SEG}, {PRED_SQL} {_m} from err where candidate <> 'undefined' group by candidate, segment",
    "sparse_truth": f"""with {BASE_SQL}, e as (select c as candidate, flag, case when q = 7 then p else 0 end as y, case c when 'price' then p when 'fifty' then 50 end as x from base, (values ('price'), ('fifty'), ('none')) v(c)),
      a as (select candidate, flag, count(*) as n, count(x) as n_finite, greatest(3, floor(count(*) / 2)) as need, count(x) filter (y <> 0) as n_r, sqrt(avg((x - y) * (x - y))) as s, quantile_cont(abs(x - y) / abs(y), 0.5) filter (y <> 0) as med, max(abs(x - y) / abs(y)) filter (y <> 0) as worst from e group by candidate, flag)
      select candidate, flag, cast(n as bigint) as n, cast(n_finite as bigint) as n_finite, cast(case when n_finite >= need then n_r else 0 end as bigint) as n_relative, 1 - n_finite / n as nonfinite_ratio, round(case when n_finite >= need and n_r >= need then med else 'inf'::double end, 8) as relative_error_median,
        round(case when n_finite >= need and n_r >= need then worst else 'inf'::double end, 8) as max_relative_error, round(case when n_finite >= need then s else 'inf'::double end, 8) as rmse, coalesce(n_finite >= need and n_r >= need and med <= 0.02, false) as passed from a""",
    "verify_verdicts": f"{SEG}, {PRED_SQL}, {GATE_SQL} select candidate, case when bool_and(ok) then 'accepted' else 'rejected' end as verdict, min_by(segment, ord) filter (not ok) as first_failed, coalesce(string_agg(segment, ',' order by ord) filter (not ok), '') as failed from chk group by candidate",
    "threshold_grid": f"{SEG}, {PRED_SQL}, {GATE_SQL}, grid as (select cast(round(i * 0.01, 2) as double) as threshold from range(1, 11) r(i)) select threshold, cast(count(candidate) as bigint) as rejected from grid left join gate on segment = 'holdout' and v > threshold group by threshold",
    "seed_flips": f"with {BASE_SQL}, " + ", ".join(split_sql(s, f"_{s}") for s in SEEDS) + ", every as (" + " union all ".join(f"select {s} as seed, segment, p, d, t, y from seg_{s}" for s in SEEDS) + """),
      e as (select seed, segment, candidate, abs(case candidate when 'law' then p*(1-d)*(1+t) else p*(1-d) end - y) / abs(y) as r from every, (values ('law'), ('no_tax')) c(candidate)),
      g as (select seed, candidate, segment, quantile_cont(r, 0.5) as v from e where segment <> 'train' group by all),
      w as (select seed, candidate, case when bool_and(v <= case segment when 'holdout' then 0.02 else 0.03 end) then 'accepted' else 'rejected' end as verdict from g group by all)
      select candidate, cast(count(distinct verdict) as bigint) as n_verdicts, min(verdict) as verdict from w group by candidate""",
    "split_counts": f"{SEG} select segment, cast(count(*) as bigint) as n, cast(sum(cast('0x' || substr(md5(tie), 1, 12) as bigint)) as varchar) as digest, round(min(y), 4) as y_min, round(max(y), 4) as y_max from seg group by segment",
    "split_support": f"{SEG} select v as variable, min(x) as lo, max(x) as hi from (select unnest(['p', 'd', 't']) as v, unnest([p, d, t]) as x from seg where segment = 'train') group by v",
    "split_axis_choice": f"with {BASE_SQL} select v as axis, s as span from (select unnest(['p', 'd', 't', 'q']) as v, unnest([max(p) - min(p), max(d) - min(d), max(t) - min(t), max(q) - min(q)]) as s, unnest([0, 1, 2, 3]) as i from law) order by s desc, i limit 1",
    "extrapolation_outside": f"{SEG}, box as (select min(p) as lo, max(p) as hi from seg where segment = 'train') select segment, cast(count(*) as bigint) as n, cast(count(*) filter (p < lo or p > hi) as bigint) as n_outside from seg, box group by segment",
    "layer_rollup": f"with {BASE_SQL}, e as (select candidate, flag, y, case candidate when 'law' then p*(1-d)*(1+t) else p*(1-d) end as x from law, (values ('law'), ('no_tax')) c(candidate)) select coalesce(candidate, 'all') as candidate, coalesce(flag, 'all') as layer, cast(count(*) as bigint) as n, cast(count(*) filter (abs(x - y) <= 0.02 * abs(y)) as bigint) as matches from e group by rollup (candidate, flag)",
    "error_plane": f"{SEG}, {PRED_SQL} select candidate, round(quantile_cont(r, 0.5) filter (segment = 'holdout'), 8) as holdout, round(quantile_cont(r, 0.5) filter (segment = 'extrapolation'), 8) as extrapolation from err where candidate <> 'undefined' group by candidate",
    "fit_constants": f"{SEG}, {PRED_SQL}, s as (select candidate, sum(x*x) as ff, sum(x*y) as fy, sum(y*y) as yy, count(*) as n, stddev_pop(y) as sd from err where segment = 'train' and candidate <> 'undefined' group by candidate) select candidate, round(fy/ff, 8) as k, round(sqrt(greatest(yy - fy/ff*fy, 0) / n) / sd, 5) as fit_error, sqrt(greatest(yy - fy/ff*fy, 0) / n) / sd <= 0.5 as passed from s",
    "negative_control": f"with {BASE_SQL}, j as (select p, q, p_retailprice as y from base join part on partkey = p_partkey), e as (select c as candidate, y, case c when 'price' then p when 'quantity' then q when 'product' then p*q when 'ratio' then p/q when 'root' then sqrt(p*q) else p+q end as x from j, (values ('price'),('quantity'),('product'),('ratio'),('root'),('line')) v(c)), s as (select candidate, sum(x*x) as ff, sum(x*y) as fy, sum(y*y) as yy, count(*) as n, stddev_pop(y) as sd from e group by candidate) select candidate, round(fy/ff, 8) as k, case when sqrt(greatest(yy - fy/ff*fy, 0)/n)/sd > 0.5 then 'fit' else 'accepted' end as first_failed from s",
    "retail_narrow_fit": "with f as (select regr_intercept(p_retailprice, p_partkey) as a, regr_slope(p_retailprice, p_partkey) as b from part where p_partkey < 1000), e as (select p_partkey < 1000 as inside, cast(p_partkey as double) as x, abs(a + b * p_partkey - p_retailprice) / p_retailprice as e, a, b from part, f) select inside, cast(count(*) as bigint) as n, round(max(a), 4) as a, round(max(b), 6) as b, round(quantile_cont(e, 0.5), 6) as median_error, round(max(e), 6) as max_error, arg_max(x, (round(e, 6), -x)) as worst_at from e group by inside",
    "numeric_equivalence": f"with {BASE_SQL}, e as (select c as candidate, p*(1-d)*(1+t) as y, case c when 'expanded' then p - p*d + p*t - p*d*t when 'reordered' then (1+t)*p*(1-d) when 'shifted' then p*(1-d)*(1+t) + 0.01 else p*(1-d) end as x from law, (values ('expanded'),('reordered'),('shifted'),('no_tax')) v(c)) select candidate, round(max(abs(x-y))/max(abs(y)), 9) as deviation, max(abs(x-y))/max(abs(y)) <= 1e-6 as equivalent from e group by candidate",
    "profile_sweep": f"with {BASE_SQL}, m as (select min(p) as lo, max(p) as hi, quantile_cont(d, 0.5) as d, quantile_cont(t, 0.5) as t from law) select cast(i as integer) as i, round(lo + (hi - lo) * i / 319.0, 4) as p, round((lo + (hi - lo) * i / 319.0) * (1 - d) * (1 + t), 4) as y from m, range(0, 320) r(i)",
    "seed_ranking": f"with {BASE_SQL}, s as (select sum(p*p) as pp, sum(p*y) as py, sum(y*y) as yy, count(*) as n from law), g as (select cast(i as integer) as i, pow(10.0, i / 15.0) as k from range(-45, 46) r(i)) select i, round(k, 8) as k, round(sqrt((yy - 2*k*py + k*k*pp) / n), 3) as cost from s, g order by cost, i limit 10",
    "formula_texts": "select regexp_replace(replace(lower(trim(' Size ** 2 * ' || p_brand || ' / R ')), '**', '^'), '\\s+', '', 'g') as formula, cast(count(*) as bigint) as n from part group by 1",
    "scale_checks": _scale_sql(),
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
