"""Exact order statistics of all groups together, with bounded memory.

A target is a pair of neighbouring ranks of one column of one group. Each step is one scan: rows between a
target's bounds are counted in a few thousand bins, with the least and the largest value of each. The bin
that holds the ranks gives the next bounds, or the answer, if a rank is at one of its ends or its values are
all equal. Bins follow the logarithm where the bounds lie far apart, else the value, so that a few steps are
enough for any doubles; no row of any step holds more than a few numbers, whatever a group's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch

BINS = 4096
#: Bounds further apart than this are cut by the logarithm.
FAR = 16.0
INF = float("inf")


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v between lo and hi, lo < hi: never falls as v grows."""
    share = lambda t: F.least(F.floor(t * BINS), F.lit(BINS - 1))
    decades = F.greatest(F.lit(-3100.0), F.least(F.lit(3000.0), F.ln(F.abs(v)) * 4))
    by_size = F.when(v == 0, F.lit(0)).otherwise((F.floor(decades) + 3200) * F.signum(v).cast("long"))
    by_log = share((F.ln(v) - F.ln(lo)) / (F.ln(hi) - F.ln(lo)))
    near = F.when(lo > 0, hi / FAR <= lo).when(hi < 0, lo / FAR >= hi).otherwise(F.lit(False))
    return F.when(near, share((v - lo) / (hi - lo))).when((lo > 0) & (hi < INF), by_log).otherwise(by_size)


def _known(k: Column) -> Column:
    """The value at rank k of a bin that begins after `below` values: null if it lies within."""
    return F.when((k == F.col("below")) | (F.col("lo") == F.col("hi")), F.col("lo")).when(k == F.col("below") + F.col("n") - 1, F.col("hi"))


def same_group(by: list[str], other: dict[str, str]) -> Column:
    """Whether two rows are of one group; nulls are equal. other: the names on the other side."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(other[k])) for k in by)) if by else F.lit(True)


def at_ranks(rows: DataFrame, by: list[str], targets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (by..., place, v0, v1): the values at ranks k0 and k1 of each target, stored.

    targets has (by..., place, c, k0, k1, n, lo, hi): c is the position in columns of the one that is ranked among the group's rows
    without a null in it, n, lo and hi their number, least and largest value; k0 counts from 0, and k1 is k0 or the next one.
    """
    keys = {k: f"__by_{i}" for i, k in enumerate(by)}
    target = [*by, "place", "c", "k0", "k1"]
    scratch = Scratch()
    now = targets.withColumn("below", F.lit(0).cast("long"))
    done = None
    while True:
        judged = scratch.store(now.withColumns({"v0": _known(F.col("k0")), "v1": _known(F.col("k1"))}), "ranks")
        found = judged.filter("v0 is not null and v1 is not null").select(*by, "place", "v0", "v1")
        done = found if done is None else done.unionByName(found)
        open_ = judged.filter("v0 is null or v1 is null").drop("v0", "v1", "n")
        if open_.isEmpty():
            return scratch.done(done, "at_ranks")
        inside = rows.join(open_.withColumnsRenamed(keys), same_group(by, keys)).withColumn("__v", F.element_at(F.array(*columns), F.col("c") + 1)).filter("__v between lo and hi")
        counted = inside.groupBy(*target, "below", _bin(F.col("__v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        # a window has one row for each bin at most
        before = F.sum("n").over(Window.partitionBy(*target).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = counted.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        has = lambda k: (F.col(k) >= F.col("below")) & (F.col(k) < F.col("below") + F.col("n"))
        held = bins.filter(has("k0") | has("k1")).withColumns({"v0": F.when(has("k0"), _known(F.col("k0"))), "v1": F.when(has("k1"), _known(F.col("k1")))})
        # two neighbouring ranks in two bins are the end of one and the start of the other, and so both known
        within = (has("k0") & F.col("v0").isNull()) | (has("k1") & F.col("v1").isNull())
        at = F.max(F.when(within, F.struct("lo", "hi", "below", "n")))
        step = held.groupBy(*target).agg(F.max("v0").alias("v0"), F.max("v1").alias("v1"), at.alias("at"))
        step = scratch.store(step, "ranks")
        known = step.filter("at is null").select(*by, "place", "v0", "v1")
        done = done.unionByName(known)
        now = step.filter("at is not null").select(*target, "at.*")


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, tuple[float, ...]]], moments: dict[str, Column]) -> DataFrame:
    """Rows (by..., moments..., <name> array of percentiles) of wanted: name -> (column, shares); interpolated, nulls left out."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    places = [(i, name, c, p) for i, (name, c, p) in enumerate((name, c, p) for name, (c, shares) in wanted.items() for p in shares)]
    ends = {f"__ends_{i}": F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for i, c in enumerate(columns)}
    scratch = Scratch()
    first = scratch.store(rows.groupBy(*by).agg(*(m.alias(k) for k, m in moments.items()), *(e.alias(k) for k, e in ends.items())), "moments")

    def rank(i: int, c: str, p: float) -> Column:
        end = F.col(f"__ends_{columns.index(c)}")
        at = (end["n"] - 1) * F.lit(p)
        return F.struct(F.lit(i).alias("place"), F.lit(columns.index(c)).alias("c"), F.floor(at).alias("k0"), F.ceil(at).alias("k1"), end["n"].alias("n"), end["lo"].alias("lo"), end["hi"].alias("hi"))

    targets = first.select(*by, F.inline(F.array(*(rank(i, c, p) for i, _, c, p in places)))).filter("n > 0")
    found = at_ranks(rows, by, targets, columns)
    scratch.tables.append(found)
    # two ranks of each place
    each = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("v0", "v1")))).alias("__found"))
    keys = {k: f"__by_{i}" for i, k in enumerate(by)}
    j = first.join(each.withColumnsRenamed(keys), same_group(by, keys), "left")

    def value(i: int, c: str, p: float) -> Column:
        at, v = (F.col(f"__ends_{columns.index(c)}")["n"] - 1) * F.lit(p), F.col("__found")[i]
        return v["v0"] + F.when(v["v1"] > v["v0"], (v["v1"] - v["v0"]) * (at - F.floor(at))).otherwise(0.0)

    # one row for each group
    return scratch.done(j.select(*by, *moments, *(F.array(*(value(i, c, p) for i, m, c, p in places if m == name)).alias(name) for name in wanted)), "percentiles")

