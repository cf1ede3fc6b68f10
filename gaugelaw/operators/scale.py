"""Structural checks of a formula on probe points inside the range of the data.

Each check is one Column, a struct (passed, value), over a row of ranges: for each variable v the
columns v_lo and v_hi. All checks of all formulas fit in one projection of that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.formula import compile_formula, finite

TINY = 1e-300


def inside(lo: Column, hi: Column, t: Column | float) -> Column:
    """The point at share t of a range: geometric if it is positive, else linear."""
    t = F.lit(t) if isinstance(t, float) else t
    return F.when(lo > 0, lo * F.pow(hi / lo, t)).otherwise(lo + (hi - lo) * t)


def relative(got: Column, want: Column, size: Column | None = None) -> Column:
    return F.abs(got - want) / F.greatest(F.abs(size if size is not None else want), F.lit(TINY))


def at(variables: list[str], t: Column | float = 0.5) -> dict[str, Column]:
    """Where the variables stand at a share of their ranges, by default in the middle."""
    return {v: inside(F.col(f"{v}_lo"), F.col(f"{v}_hi"), t) for v in variables}


def outcome(passed: Column, value: Column) -> Column:
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))


def scaling(formula: str, variables: list[str], scaled: list[str], factor: float, exponent: float, tolerance: float = 1e-4) -> Column:
    """Multiplying the scaled variables by factor multiplies y by factor ** exponent (exponent 0: invariance)."""
    base = at(variables)
    y0, y1 = compile_formula(formula, base), compile_formula(formula, base | {v: base[v] * factor for v in scaled})
    ratio = y1 / y0
    good = finite(y0) & finite(y1) & (y0 != 0) & (F.signum(y0) == F.signum(y1)) & (relative(ratio, F.lit(factor**exponent)) <= tolerance)
    return outcome(good, ratio)


def limit(formula: str, target: str, variables: list[str], var: str, to: float = 0.0, tolerance: float = 1e-3, share: float = 0.1) -> Column:
    """As var goes to a value, y goes to the target formula: the relative errors at three probes don't rise, and end small or fall by half each time.

    The probes lie at a share of var's range from the value, and at a quarter and a sixteenth of that. Where the target itself is near zero its
    largest value among the probes measures the error.
    """
    base, span = at(variables), F.col(f"{var}_hi") - F.col(f"{var}_lo")
    side = F.when(base[var] >= to, 1.0).otherwise(-1.0)
    got, want = [], []
    for part in (1.0, 4.0, 16.0):
        point = base | {var: F.lit(to) + side * (span * share / part)}
        got.append(compile_formula(formula, point))
        want.append(compile_formula(target, point))
    largest = F.greatest(*(F.abs(w) for w in want))
    size = F.when(largest > 0, largest).otherwise(1.0)
    errors = [relative(g, w, F.when(F.abs(w) > 1e-9 * size, w).otherwise(size)) for g, w in zip(got, want)]
    down = reduce(Column.__and__, (b <= a + 1e-12 for a, b in zip(errors, errors[1:])))
    half = reduce(Column.__and__, ((a <= 0) | (b <= a / 2) for a, b in zip(errors, errors[1:])))
    good = (span > 0) & reduce(Column.__and__, map(finite, [*got, *want]))
    return outcome(good & down & ((F.least(*errors) <= tolerance) | half), errors[2])


def monotonic(formula: str, variables: list[str], var: str, increasing: bool = True, samples: int = 9, least: float = 1e-3) -> Column:
    """y only rises (falls) over samples of var: the sign of each step of the probes, and the whole change, both over the largest y."""
    lo, hi, base = F.col(f"{var}_lo"), F.col(f"{var}_hi"), at(variables)
    samples, ys = max(3, samples), []
    for i in range(samples):
        t = i / (samples - 1)
        x = F.when((lo > 0) & (hi / lo >= 10), lo * F.pow(hi / lo, F.lit(t))).otherwise(lo + (hi - lo) * t)
        ys.append(compile_formula(formula, base | {var: x}))
    largest = F.greatest(*(F.abs(y) for y in ys))
    size = F.when(largest > 0, largest).otherwise(1.0)
    steps = [((b - a) if increasing else (a - b)) / size > 1e-12 for a, b in zip(ys, ys[1:])]
    whole = F.abs(ys[-1] - ys[0]) / size
    return outcome((hi > lo) & reduce(Column.__and__, map(finite, ys)) & reduce(Column.__and__, steps) & (whole >= least), whole)


def sign(formula: str, variables: list[str], expected: str = "positive", levels: int = 4, most: int = 512, tolerance: float = 0.0) -> Column:
    """The share of finite points where y has the expected sign: the middle and a grid over all variables by name, of at most `most` points together."""
    names = sorted(variables)

    def y(number: Column) -> Column:
        digit = {v: F.pmod(F.floor(number / levels**i), F.lit(levels)) / (levels - 1) for i, v in enumerate(reversed(names))}
        middle = number < 0
        return compile_formula(formula, {v: inside(F.col(f"{v}_lo"), F.col(f"{v}_hi"), F.when(middle, 0.5).otherwise(digit[v])) for v in names})

    probes = F.filter(F.transform(F.sequence(F.lit(-1), F.lit(min(most - 1, levels ** len(names)) - 1)), y), finite)
    hit = {"positive": lambda x: x > 0, "negative": lambda x: x < 0, "nonzero": lambda x: x != 0}[expected]
    share = F.try_divide(F.size(F.filter(probes, hit)), F.size(probes))
    return outcome(share >= 1 - tolerance, share)


def symmetry(formula: str, variables: list[str], one: str, other: str, tolerance: float = 1e-4) -> Column:
    """Swapping two variables at a quarter and three quarters of their common range leaves y as it is."""
    base = at(variables)
    lo, hi = F.greatest(F.col(f"{one}_lo"), F.col(f"{other}_lo")), F.least(F.col(f"{one}_hi"), F.col(f"{other}_hi"))
    p, q = inside(lo, hi, 0.25), inside(lo, hi, 0.75)
    a, b = compile_formula(formula, base | {one: p, other: q}), compile_formula(formula, base | {one: q, other: p})
    error = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(TINY))
    return outcome((lo < hi) & (error <= tolerance), error)
