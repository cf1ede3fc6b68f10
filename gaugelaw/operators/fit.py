"""Least squares as aggregates: the sums of one scan, then a closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_line(df: DataFrame, x: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., a, b) of y = a + b x."""
    return df.groupBy(*(by or [])).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))


def fit_scale(df: DataFrame, f: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., k, fit_error) of y = k f; fit_error is the residuals' RMSE over the standard deviation of y."""
    a = df.groupBy(*(by or [])).agg(F.sum(f * f).alias("ff"), F.sum(f * y).alias("fy"), F.sum(y * y).alias("yy"), F.count(y).alias("n"), F.stddev_pop(y).alias("sd"))
    k = F.col("fy") / F.col("ff")
    return a.select(*(by or []), k.alias("k"), (F.sqrt(F.greatest(F.col("yy") - k * F.col("fy"), F.lit(0.0)) / F.col("n")) / F.col("sd")).alias("fit_error"))


def two_sums(df: DataFrame, a1: Column, a2: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., s11, s12, s22, s1b, s2b, sbb, n): the sums of products that b = k1 a1 + k2 a2 needs."""
    return df.groupBy(*(by or [])).agg(*(F.sum(x * y).alias(n) for n, x, y in (("s11", a1, a1), ("s12", a1, a2), ("s22", a2, a2), ("s1b", a1, b), ("s2b", a2, b), ("sbb", b, b))), F.count(b).alias("n"))


def fit_two(df: DataFrame, a1: Column, a2: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., k1, k2, rmse) of b = k1 a1 + k2 a2, by Cramer's rule over five sums."""
    s = two_sums(df, a1, a2, b, by)
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    k1, k2 = (F.col("s1b") * F.col("s22") - F.col("s2b") * F.col("s12")) / det, (F.col("s11") * F.col("s2b") - F.col("s12") * F.col("s1b")) / det
    return s.select(*(by or []), k1.alias("k1"), k2.alias("k2"), F.sqrt(F.greatest(F.col("sbb") - k1 * F.col("s1b") - k2 * F.col("s2b"), F.lit(0.0)) / F.col("n")).alias("rmse"))
