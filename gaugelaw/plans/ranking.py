"""Order statistics of large tables: the k-th row of an order, found without sorting or shuffling rows.

Each step is one narrow scan. It brackets the rank between two values of a numeric key and counts what
lies below; only a bracket of few rows is looked into, of more rows it is cut again. The
cut-off found is a pair of literals, so that rows are then compared with it where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows of a bracket that are gathered to pick one of them.
LOOK_INTO = 10_000


@dataclass(frozen=True)
class Cut:
    """The row at a rank in the order of a number and then a text; None before the first row."""

    x: float | None
    tie: str = ""

    def upto(self, x: Column, tie: Column) -> Column:
        """Whether a row's rank is at most the cut's."""
        if self.x is None:
            return F.lit(False)
        return (x < self.x) | ((x == self.x) & (tie <= self.tie))


def number(x: Column) -> Column:
    """A double to order by: nulls and NaN come last."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float("inf"))).otherwise(x)


def hash_number(text: Column, at: int = 1) -> Column:
    """Twelve digits of a hexadecimal hash as a double."""
    return F.conv(F.substring(text, at, 12), 16, 10).cast("double")


def _look(df: DataFrame, x: Column, tie: Column, lo: float, hi: float, k: int) -> Cut:
    rows = sorted((r["x"], r["t"]) for r in df.filter((x >= lo) & (x <= hi)).select(x.alias("x"), tie.alias("t")).collect())
    return Cut(*rows[k - 1])


def cuts(df: DataFrame, x: Column, tie: Column, ranks: list[int], brackets: list[tuple[float, float]] | None = None, share: float = 5e-4, digit: int = 1) -> list[Cut]:
    """The rows at these ranks, from 1, in the order of x and then tie, a hexadecimal hash; rank 0 is before the first row.

    brackets: where the ranks are expected, checked by counts. Values of x that very many rows share
    are told apart by the hash, in the same way, from its given digit on.
    """
    # columns of their own: an expression that stands in several conditions would be computed in each
    df = df.select(x.alias("__x"), tie.alias("__t"))
    x, tie = F.col("__x"), F.col("__t")
    out = [Cut(None)] * len(ranks)
    todo = {i: k for i, k in enumerate(ranks) if k > 0}
    if not todo:
        return out
    span = dict(enumerate(brackets)) if brackets else {}
    if not brackets:
        n = df.count()
        at = sorted({min(1.0, max(0.0, k / n + d)) for k in todo.values() for d in (-share, share)})
        found = dict(zip(at, df.agg(F.percentile_approx(x, at, 20_000)).first()[0]))
        span = {i: (found[min(1.0, max(0.0, k / n - share))], found[min(1.0, max(0.0, k / n + share))]) for i, k in todo.items()}
    counted = df.agg(*(c for i in todo for c in (F.count_if(x < span[i][0]).alias(f"b{i}"), F.count_if((x >= span[i][0]) & (x <= span[i][1])).alias(f"n{i}")))).first()
    for i, k in todo.items():
        (lo, hi), below, inside = span[i], counted[f"b{i}"], counted[f"n{i}"]
        if not below < k <= below + inside:  # the rank lies beside its bracket
            part, rest = (df.filter(x < lo), k) if k <= below else (df.filter(x > hi), k - below - inside)
            out[i] = cuts(part, x, tie, [rest], digit=digit)[0]
        elif inside <= LOOK_INTO:
            out[i] = _look(df, x, tie, lo, hi, k - below)
        elif lo < hi:
            out[i] = cuts(df.filter((x >= lo) & (x <= hi)), x, tie, [k - below], share=share, digit=digit)[0]
        else:  # one value of very many rows
            same = df.filter(x == lo)
            least, most = same.agg(F.min(tie), F.max(tie)).first()
            out[i] = Cut(lo, least if least == most else cuts(same, hash_number(tie, digit), tie, [k - below], digit=digit + 12)[0].tie)
    return out
