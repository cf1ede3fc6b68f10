"""Error metrics of predictions in one grouped aggregate, and the gates that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import compile_formula, finite
from ..plans.order_statistics import percentiles

INF = float("inf")


def predictions(df: DataFrame, formulas: dict[str, str], variables: dict[str, Column], keep: list[str], target: str = "y") -> DataFrame:
    """Rows (keep..., candidate, truth, pred): all candidates from one scan of df."""
    made = F.array(*(F.struct(F.lit(name).alias("candidate"), compile_formula(text, variables).alias("pred")) for name, text in formulas.items()))
    return df.select(*keep, F.col(target).cast("double").alias("truth"), F.inline(made))


_ACCURACY = 10_000


def error_metrics(df: DataFrame, by: list[str], exact: bool = True) -> DataFrame:
    """Rows (by..., n, n_finite, nonfinite_ratio, n_relative, rmse, relative_error_median, _p75, _p90, rmsre, max_relative_error, relative_rmse, normalized_rmse).

    df has truth and pred. All errors are infinite if fewer than max(3, n / 2) pairs are finite, the relative
    ones also if fewer than that have a truth other than zero. exact=False takes approximate percentiles.
    """
    ok = finite(F.col("pred")) & finite(F.col("truth"))
    diff = F.when(ok, F.col("pred") - F.col("truth"))
    relative = F.when(ok & (F.abs("truth") > 0), F.abs(F.col("pred") - F.col("truth")) / F.abs("truth"))
    rows = df.select(*by, diff.alias("__d"), relative.alias("__r"), F.when(ok, F.col("truth")).alias("__t"))
    rows = rows.withColumn("__a", F.abs("__t"))
    moments = {
        "n": F.count(F.lit(1)), "n_finite": F.count("__d"), "n_relative": F.count("__r"), "rmse": F.sqrt(F.avg(F.col("__d") * F.col("__d"))), "rmsre": F.sqrt(F.avg(F.col("__r") * F.col("__r"))),
        "worst": F.max("__r"), "spread": F.stddev_pop("__t"), "size": F.sqrt(F.avg(F.col("__t") * F.col("__t"))),
    }
    wanted = {"q": ("__r", (0.5, 0.75, 0.9)), "middle": ("__a", (0.5,))}
    if exact:
        a = percentiles(rows, by, wanted, moments)
    else:
        a = rows.groupBy(*by).agg(*(m.alias(k) for k, m in moments.items()), *(F.percentile_approx(c, list(p), _ACCURACY).alias(k) for k, (c, p) in wanted.items()))
    a = a.withColumn("middle", F.col("middle")[0])
    required = F.greatest(F.lit(3), F.floor(F.col("n") / 2))
    enough, relative = F.col("n_finite") >= required, F.col("n_relative") >= required
    scale = F.when(F.col("middle") > 0, F.col("middle")).when(F.col("size") > 0, F.col("size")).otherwise(1.0)
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    out = {"rmse": F.col("rmse"), "relative_rmse": F.col("rmse") / scale, "normalized_rmse": F.col("rmse") / spread}
    out |= {k: F.when(relative, c).otherwise(F.lit(INF)) for k, c in (("relative_error_median", F.col("q")[0]), ("relative_error_p75", F.col("q")[1]), ("relative_error_p90", F.col("q")[2]), ("rmsre", F.col("rmsre")), ("max_relative_error", F.col("worst")))}
    counted = F.when(enough, F.col("n_relative")).otherwise(0).alias("n_relative")
    return a.select(*by, "n", "n_finite", (1 - F.col("n_finite") / F.col("n")).alias("nonfinite_ratio"), counted, *(F.when(enough, c).otherwise(F.lit(INF)).alias(k) for k, c in out.items()))


def checks(metrics: DataFrame, by: list[str], holdout: float = 0.02, extrapolation: float = 0.03) -> DataFrame:
    """Rows (by..., name, ord, passed, value) of the holdout and extrapolation gates, from metrics by segment."""
    limit = F.when(F.col("segment") == "holdout", F.lit(holdout)).otherwise(F.lit(extrapolation))
    passed = (F.col("relative_error_median") <= limit) & ((F.col("segment") == "holdout") | (F.col("nonfinite_ratio") < 0.1))
    order = F.when(F.col("segment") == "holdout", 1).otherwise(2)
    return metrics.filter("segment <> 'train'").select(*by, F.col("segment").alias("name"), order.alias("ord"), passed.alias("passed"), F.col("relative_error_median").alias("value"))


def verdicts(checks: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., verdict, first_failed, failed): accepted if every check passed; failed checks in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "name"))))
    a = checks.groupBy(*by).agg(F.bool_and("passed").alias("ok"), failed.alias("f"))
    return a.select(*by, F.when(F.col("ok"), "accepted").otherwise("rejected").alias("verdict"), F.get("f", F.lit(0))["name"].alias("first_failed"), F.array_join(F.transform("f", lambda x: x["name"]), ",").alias("failed"))
