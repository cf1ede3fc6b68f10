"""Three-way split: both tails of one axis for extrapolation, a seeded draw of the rest held out, the others for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import LOOK_INTO, cuts, hash_number, number
from .stored import forget, stored


def ranges(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (variable, lo, hi, span, position) from one scan."""
    aggregates = df.agg(*(f(v).cast("double").alias(f"{v}_{n}") for v in variables for n, f in (("lo", F.min), ("hi", F.max))))
    rows = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_lo").alias("lo"), F.col(f"{v}_hi").alias("hi"), (F.col(f"{v}_hi") - F.col(f"{v}_lo")).alias("span"), F.lit(i).alias("position")) for i, v in enumerate(variables)))
    return aggregates.select(F.inline(rows))


def split_axis(df: DataFrame, variables: list[str]) -> DataFrame:
    """One row (axis, span): the variable of the widest raw range, the first of equal ones."""
    return ranges(df, variables).agg(F.max_by("variable", F.struct("span", -F.col("position"))).alias("axis"), F.max("span").alias("span"))


def sizes(n: int, extrapolation: float = 0.15, holdout: float = 0.2) -> tuple[int, int]:
    """(rows of each tail, held-out rows); halves are rounded to even."""
    tail = max(6, round(extrapolation * n)) // 2
    return tail, max(0, min(round(holdout * n), n - 2 * tail - 10))


def draw_key(tie: Column, seed: int) -> Column:
    """The place of a row in the draw of a seed: an evenly spread hash."""
    return F.md5(F.concat(tie, F.lit(f"#{seed}")))


def held_out(middle: DataFrame, n: int, held: int, tie: Column, seed: int) -> str:
    """The draw key of the last held-out row among n rows; empty if none is.

    The keys are even, so that the rank's place is known nearly: one scan counts what lies below and
    inside a bracket around it, and one gathers the bracket. Where the rank lies beside it, or the
    bracket holds many equal keys, the general search finds it.
    """
    if not n or not held:
        return ""
    keys = middle.select(draw_key(tie, seed).alias("__k"))
    k = F.col("__k")
    at, wide = held / n * 16**12, 8 * 16**12 * (held / n * (1 - held / n) / n) ** 0.5 + 1
    lo, hi = f"{max(0, int(at - wide)):012x}", f"{min(16**12 - 1, int(at + wide)):012x}g"  # g comes behind all digits
    below, inside = keys.agg(F.count_if(k < lo), F.count_if((k >= lo) & (k <= hi))).first()
    if below < held <= below + inside and inside <= LOOK_INTO:
        return sorted(r["__k"] for r in keys.filter((k >= lo) & (k <= hi)).collect())[held - below - 1]
    return cuts(keys, hash_number(k), k, [held])[0].tie


def three_way(df: DataFrame, axis: str, tie: Column, seed: int, extrapolation: float = 0.15, holdout: float = 0.2) -> DataFrame:
    """df with a column segment: train, holdout or extrapolation.

    Ties on the axis, and the draw, are settled by tie, a hexadecimal hash that tells rows apart; rows
    that it doesn't tell apart fall on one side together. Nothing is shuffled: each row is compared
    with three cut-offs. Rows without an axis value come last.
    """
    return seeded(df, axis, tie, [seed], "segment", extrapolation, holdout)


def seeded(df: DataFrame, axis: str, tie: Column, seeds: list[int], name: str = "segment", extrapolation: float = 0.15, holdout: float = 0.2) -> DataFrame:
    """df with a segment column for each seed: name if there is one, else name_<seed>; the tails are found once."""
    x = number(F.col(axis))
    # the search reads the axis and the hash alone, which are computed once
    narrow = stored(df.select(x.alias("__x"), tie.alias("__t")), "split")
    nx, nt = F.col("__x"), F.col("__t")
    # the tails' shares are known before the number of rows: one scan counts and brackets both
    at = [max(0.0, min(1.0, share + d)) for share in (extrapolation / 2, 1 - extrapolation / 2) for d in (-5e-4, 5e-4)]
    first = narrow.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(nx, at, 20_000).alias("q")).first()
    n, q = first["n"], first["q"]
    tail, held = sizes(n, extrapolation, holdout)
    low, high = cuts(narrow, nx, nt, [min(tail, n), max(0, n - tail)], [(q[0], q[1]), (q[2], q[3])] if q else None)
    outside = low.upto(x, tie) | ~high.upto(x, tie)
    middle, between = narrow.filter(~(low.upto(nx, nt) | ~high.upto(nx, nt))), max(0, n - 2 * tail)
    last = {seed: held_out(middle, between, held, nt, seed) for seed in seeds}
    forget(narrow)
    # the hash stands in the expression once: a filter on the segment is computed with it
    made = {s: F.when(outside, "extrapolation").when(draw_key(tie, s) <= last[s], "holdout").otherwise("train") for s in seeds}
    return df.withColumns({name if len(seeds) == 1 else f"{name}_{s}": c for s, c in made.items()})


def support(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (variable, lo, hi) of the training segment."""
    return ranges(df.filter("segment = 'train'"), variables).select("variable", "lo", "hi")


def outside_support(df: DataFrame, axis: str) -> DataFrame:
    """Rows (segment, n, n_outside): how many rows lie strictly outside the training range of the axis."""
    box = df.filter("segment = 'train'").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    return df.join(F.broadcast(box)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col(axis) < F.col("lo")) | (F.col(axis) > F.col("hi"))).alias("n_outside"))  # one row on the other side


def fingerprint(df: DataFrame, row_key: Column, by: str = "segment", **more: Column) -> DataFrame:
    """Rows (by, n, digest, more...): an order-free checksum of the rows in each group, summed before the shuffle, and other aggregates of the same scan."""
    part = F.conv(F.substring(F.md5(row_key), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"), *(c.alias(k) for k, c in more.items()))


def manifest_fields(seg: DataFrame, variables: list[str], row_key: Column, target: str = "y", **rule: object) -> DataFrame:
    """Rows (field, value) that describe a split: rows, checksum and target range of each segment, the training range of each variable, and its rule."""
    told = lambda c: F.format_string("%.12e", c.cast("double"))
    a = fingerprint(seg, row_key, y_lo=F.min(target), y_hi=F.max(target))
    parts = {"n": F.col("n").cast("string"), "digest": F.col("digest"), "target_low": told(F.col("y_lo")), "target_high": told(F.col("y_hi"))}
    counts = a.select(F.inline(F.array(*(F.struct(F.concat("segment", F.lit(f"/{k}")).alias("field"), v.alias("value")) for k, v in parts.items()))))
    box = support(seg, variables)
    ends = box.select(F.inline(F.array(*(F.struct(F.concat(F.lit("support/"), "variable", F.lit(f"/{k}")).alias("field"), told(F.col(c)).alias("value")) for k, c in (("low", "lo"), ("high", "hi"))))))
    rules = seg.sparkSession.createDataFrame([(f"rule/{k}", str(v)) for k, v in sorted(rule.items())], "field string, value string")
    return counts.unionByName(ends).unionByName(rules)


def drift(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Rows (field, finding, was, now) of the fields in which a split is no longer what its manifest says: changed, missing or added."""
    j = manifest.select("field", F.col("value").alias("was"), F.lit(True).alias("__m")).join(now.select("field", F.col("value").alias("now"), F.lit(True).alias("__n")), "field", "full_outer")
    finding = F.when(F.col("__n").isNull(), "missing").when(F.col("__m").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return j.select("field", finding.alias("finding"), "was", "now").filter("finding is not null")


def cover(data: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows (key, finding, segments) of rows that are not in exactly one part: gap, overlap, or stranger if they are in none of the data."""
    tagged = data.select(key, F.lit(None).cast("string").alias("segment"))
    for name, part in parts.items():
        tagged = tagged.unionByName(part.select(key, F.lit(name).alias("segment")))
    # as many names as there are parts
    a = tagged.groupBy(key).agg(F.count_if(F.col("segment").isNull()).alias("n"), F.array_sort(F.collect_set("segment")).alias("s"), F.count("segment").alias("held"))
    finding = F.when(F.col("n") == 0, "stranger").when(F.col("held") == 0, "gap").when(F.col("held") > F.col("n"), "overlap").when(F.col("held") < F.col("n"), "gap")
    return a.select(key, finding.alias("finding"), F.array_join("s", ",").alias("segments")).filter("finding is not null")
