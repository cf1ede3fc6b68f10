"""Independent recomputation of stored runs: their formulas are verified anew, and every stored check and parameter is compared by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batch

#: Checks that a verification makes; others, but for scale checks, belong to another suite.
CORE = ("expression", "dimension", "fit", "holdout", "extrapolation")
EXACT, AGREE = 1e-9, 1e-3


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger of both, 0 for equal values."""
    size = F.greatest(F.abs(a), F.abs(b))
    return F.when((a == b) | (size == 0), 0.0).otherwise(F.abs(a - b) / size)


def recheck(runs: DataFrame, stored_checks: DataFrame, data: DataFrame, tasks: DataFrame, **settings: float) -> tuple[DataFrame, DataFrame]:
    """(rows of runs, rows of checks).

    runs: (run_id, task_id, formula, free array, parameters map, verdict); stored_checks: (run_id, name, passed, value); data and tasks
    as batch.verify takes them. Runs: (run_id, status, recomputed, max_metric, max_parameter, deterministic, stale array). status:
    unresolvable (no such task), missing-formula, recompute-error (the task cannot be split), out-of-scope (no checks, none of the core, or one of another suite),
    disagree (the verdict flips), stale-checks (a check flips), stale-metrics (a number is off by over a thousandth), agree.
    Checks: (run_id, name, was, now, difference), of names that both sides have; a name stored twice counts each time.
    """
    runs = runs.withColumn("task_id", F.col("task_id").cast("string"))
    known = tasks.select(F.col("task_id").cast("string").alias("task_id")).distinct().withColumn("known", F.lit(True))
    runs = runs.join(known, "task_id", "left")
    candidates = runs.filter("known and formula <> ''").select("task_id", F.col("run_id").cast("string").alias("candidate"), "formula", "free")
    found, fits = batch.verify_with_fits(data, tasks, candidates, **settings)
    fresh = found.select(F.col("candidate").alias("run_id"), "name", F.col("passed").alias("now"), F.col("value").alias("fresh"))
    verdicts = batch.report(found).select(F.col("candidate").alias("run_id"), F.col("verdict").alias("recomputed"))
    old = stored_checks.select(F.col("run_id").cast("string").alias("run_id"), "name", F.col("passed").alias("was"), F.col("value").alias("kept"))
    checks = old.join(fresh, ["run_id", "name"])
    metric = F.when(F.col("kept").isNotNull() & F.col("fresh").isNotNull(), relative_difference(F.col("kept"), F.col("fresh")))
    checks = checks.select("run_id", "name", "was", "now", metric.alias("difference"))
    core, scale = F.col("name").isin(*CORE), F.col("name").startswith("scale-")
    scope = old.groupBy("run_id").agg(F.bool_or(core).alias("core"), F.bool_or(~core & ~scale).alias("foreign"))
    # a run has a few dozen checks
    flips = checks.groupBy("run_id").agg(F.array_sort(F.collect_set(F.when(~F.col("was").eqNullSafe(F.col("now")), F.col("name")))).alias("stale"), F.max("difference").alias("max_metric"))
    kept = runs.select(F.col("run_id").cast("string").alias("run_id"), F.explode("parameters").alias("parameter", "kept"))
    again = fits.select(F.col("candidate").alias("run_id"), F.inline(F.arrays_zip(F.col("free").alias("parameter"), F.col("theta").alias("fresh"))))
    parameters = kept.join(again, ["run_id", "parameter"]).groupBy("run_id").agg(F.max(relative_difference(F.col("kept"), F.col("fresh"))).alias("max_parameter"))
    j = runs.select(F.col("run_id").cast("string").alias("run_id"), "formula", "verdict", "known")
    for side in (verdicts, scope, flips, parameters):
        j = j.join(side, "run_id", "left")
    off = F.greatest(F.coalesce("max_metric", F.lit(0.0)), F.coalesce("max_parameter", F.lit(0.0)))
    status = (
        F.when(F.col("known").isNull(), "unresolvable").when(F.coalesce("formula", F.lit("")) == "", "missing-formula").when(F.col("recomputed") == "error", "recompute-error")
        .when(F.col("foreign") | ~F.col("core") | F.col("core").isNull(), "out-of-scope").when(~F.col("verdict").eqNullSafe(F.col("recomputed")), "disagree")
        .when(F.size(F.coalesce("stale", F.array().cast("array<string>"))) > 0, "stale-checks").when(off > AGREE, "stale-metrics").otherwise("agree")
    )
    rows = j.withColumn("status", status)
    return rows.select("run_id", "status", "recomputed", "max_metric", "max_parameter", ((F.col("status") == "agree") & (off <= EXACT)).alias("deterministic"), "stale"), checks


def summary(runs: DataFrame) -> DataFrame:
    """One row for each status (status, n, in_scope, recompute_rate, verdict_rate): rates are shares of the runs in scope that agree, and whose verdict came out again."""
    scope = ("agree", "disagree", "stale-checks", "stale-metrics")
    tally = runs.groupBy("status").agg(F.count("*").alias("n"))
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0))
    total = tally.agg(of(*scope).alias("in_scope"), of("agree").alias("agree"), of("agree", "stale-checks").alias("again"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("in_scope")), F.lit(0.0))
    # one row of totals
    return tally.join(F.broadcast(total)).select("status", "n", "in_scope", rate("agree").alias("recompute_rate"), rate("again").alias("verdict_rate"))


def write(runs: DataFrame, checks: DataFrame, path: str) -> None:
    """One JSON line a run with its checks, and the summary, below path."""
    each = checks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("name", "was", "now", "difference"))).alias("checks"))
    runs.join(each, "run_id", "left").write.mode("overwrite").json(f"{path}/runs")
    summary(runs).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
