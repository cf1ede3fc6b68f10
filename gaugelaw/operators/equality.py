"""Whether two formulas are the same, by their values on probe points of low discrepancy over the declared ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.evaluate import evaluate
from ..functions.formula import FormulaError
from .spec_checks import between, spread

#: Points of the sequence; with the middle and both corners 259.
POINTS = 256
#: Numbers under each of which every variable's points are evenly spread, square roots of primes.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def _shares() -> np.ndarray:
    """Where the points lie for the variable at each place: the middle, the low and the high corner, then an additive sequence."""
    turn = np.sqrt(np.array(PRIMES, float))[:, None] * np.arange(1, POINTS + 1)
    return np.concatenate([np.full((len(PRIMES), 1), 0.5), np.zeros((len(PRIMES), 1)), np.ones((len(PRIMES), 1)), turn - np.floor(turn)], 1)


def _at(text: str | None, points: dict[str, np.ndarray], size: int) -> np.ndarray:
    try:
        return evaluate(text or "", points, size)
    except FormulaError:
        return np.full(size, np.nan)


def compare(pairs: DataFrame, limit: float = 1e-6) -> DataFrame:
    """Rows (id, deviation, undefined, equal) of pairs (id, formula, reference, sampling map from a variable to [low, high], parameters map).

    deviation: the largest difference over the reference's largest value, of the points where both are finite; undefined: at how
    many points either is not; equal: no point is undefined and the deviation is at most limit. A text that is no formula is undefined everywhere. Ranges
    of up to twelve variables.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = _shares()
        size = shares.shape[1]
        for b in batches:
            found = []
            for formula, reference, sampling, parameters in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                points = {}
                if sampling is not None:
                    if len(sampling) > len(PRIMES):
                        raise ValueError(f"more than {len(PRIMES)} variables")
                    points = {k: np.nan if v is None else v for k, v in parameters or ()}
                    points |= {k: between(v, shares[i]) for i, (k, v) in enumerate(sorted(sampling, key=lambda kv: kv[0]))}
                y, want = _at(formula, points, size), _at(reference, points, size)
                ok = np.isfinite(y) & np.isfinite(want)
                if ok.any():
                    with np.errstate(all="ignore"):
                        off, most = np.abs(y - want)[ok].max(), np.abs(want)[ok].max()
                        deviation = float(off / (most if most > 0 else 1.0))
                else:
                    deviation = None
                undefined = size - int(ok.sum())
                found.append((deviation, undefined, undefined == 0 and deviation <= limit))
            more = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *more], names=["id", "deviation", "undefined", "equal"])

    kinds = StructType([pairs.schema["id"], StructField("deviation", DoubleType()), StructField("undefined", LongType()), StructField("equal", BooleanType())])
    return pairs.select("id", "formula", "reference", "sampling", F.col("parameters").cast("map<string,double>")).repartition(spread(pairs), "id").mapInArrow(work, kinds)
