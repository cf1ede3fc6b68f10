"""The gates that a formula passes, in order: dimension, expression, fit, holdout, extrapolation, scale.

Metadata gates (dimension, expression) run on the driver over formula texts. The others are aggregates
over all candidates at once: one scan fits the free scales of all of them, one measures all errors,
one gives the ranges that the structural checks probe. A gate that cannot be evaluated becomes a row
that failed, with the reason; later gates of a candidate without an expression or a fit have no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import FormulaError, compile_formula, parse
from ..functions.units import check_dimension
from . import fit, metrics

ORDER = {"dimension": 1, "expression": 2, "fit": 3, "holdout": 4, "extrapolation": 5, "scale": 6}
CHECK = "candidate string, ord int, name string, passed boolean, value double, mode string"


@dataclass(frozen=True)
class Candidate:
    """A formula over variables, and the name of its free scale: a parameter that multiplies the whole."""

    formula: str
    scale: str | None = None
    units: Mapping[str, str] = field(default_factory=dict)


def metadata_checks(spark: SparkSession, candidates: Mapping[str, Candidate], variables: Sequence[str], units: Mapping[str, str], dimension: bool = True) -> tuple[DataFrame, list[str]]:
    """(rows of the dimension gate and of expressions that are no formula, names of the candidates that go on)."""
    rows, sound = [], []
    for name, c in candidates.items():
        scale = {c.scale} if c.scale else set()
        if dimension:
            mode, passed, _ = check_dimension(c.formula, {**units, **c.units}, frozenset(scale))
        else:
            mode, passed = "disabled", True
        rows.append((name, ORDER["dimension"], "dimension", passed, None, mode))
        try:
            parse(c.formula, frozenset(variables) | scale)
            sound.append(name)
        except FormulaError:
            rows.append((name, ORDER["expression"], "expression", False, None, None))
    return spark.createDataFrame(rows, CHECK), sound


def dimension_gate(tasks: DataFrame) -> DataFrame:
    """Rows (formula, units, free, n, mode, passed, reason) of tasks (formula, units map, free array of parameters).

    Formulas with equal units are judged once, whatever the number of tasks n. mode is strict,
    structural (a parameter without a unit may have any) or skipped (units are missing or unknown).
    """
    told = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("units", F.create_map().cast("map<string,string>"))))))
    kinds = tasks.select("formula", told.alias("units"), F.array_join(F.coalesce("free", F.array().cast("array<string>")), ",").alias("free")).groupBy("formula", "units", "free").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [check_dimension(formula or "", json.loads(units), frozenset(free.split(",")) - {""}) for formula, units, free in zip(*(b.column(i).to_pylist() for i in range(3)))]
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "mode", "passed", "reason"])

    return kinds.mapInArrow(run, "formula string, units string, free string, n long, mode string, passed boolean, reason string")


def fitted(train: DataFrame, candidates: Mapping[str, Candidate], columns: Mapping[str, Column], target: str, limit: float = 0.5) -> DataFrame:
    """Rows (candidate, k, passed, value) of the free scales, from one scan of the training rows; a formula without a scale has k = 1 and no row."""
    free = {n: c for n, c in candidates.items() if c.scale}
    made = F.array(*(F.struct(F.lit(n).alias("candidate"), compile_formula(c.formula, {**columns, c.scale: 1.0}).alias("pred")) for n, c in free.items()))
    rows = train.select(F.col(target).cast("double").alias("truth"), F.inline(made))
    f = fit.fit_scale(rows, F.col("pred"), F.col("truth"), ["candidate"])
    return f.select("candidate", "k", F.coalesce(F.col("fit_error") <= limit, F.lit(False)).alias("passed"), F.col("fit_error").alias("value"))


def error_checks(seg: DataFrame, candidates: Mapping[str, Candidate], scales: DataFrame | None, columns: Mapping[str, Column], target: str, holdout: float, extrapolation: float) -> DataFrame:
    """Rows of the holdout and extrapolation gates."""
    made = F.array(*(F.struct(F.lit(n).alias("candidate"), compile_formula(c.formula, {**columns, **({c.scale: 1.0} if c.scale else {})}).alias("pred")) for n, c in candidates.items()))
    rows = seg.filter("segment <> 'train'").select("segment", F.col(target).cast("double").alias("truth"), F.inline(made))
    if scales is not None:  # one row for each candidate with a scale
        rows = rows.join(F.broadcast(scales.select("candidate", "k")), "candidate", "left").withColumn("pred", F.col("pred") * F.coalesce("k", F.lit(1.0)))
    found = metrics.checks(metrics.error_metrics(rows, ["candidate", "segment"]), ["candidate"], holdout, extrapolation)
    return found.select("candidate", (F.col("ord") + 3).cast("int").alias("ord"), "name", "passed", "value", F.lit(None).cast("string").alias("mode"))


def scale_checks(box: DataFrame, specs: Mapping[str, Sequence[tuple[str, Column]]], names: Sequence[str]) -> DataFrame:
    """Rows of the structural checks (kind, whether it holds, over box, one row of ranges); of several of a kind, with their number; for a candidate without specs a row that says so."""
    parts = []
    for n in names:
        kinds = [k for k, _ in specs.get(n, ())]
        for i, (kind, holds) in enumerate(specs.get(n, ())):
            label = f"scale-{kind}" + (f"-{kinds[: i + 1].count(kind)}" if kinds.count(kind) > 1 else "")
            parts.append((n, label, F.coalesce(holds, F.lit(False)), None))
        if not kinds:
            parts.append((n, "scale-checks-missing", F.lit(True), "skipped"))
    made = F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(ORDER["scale"] + i).alias("ord"), F.lit(label).alias("name"), ok.alias("passed"), F.lit(None).cast("double").alias("value"), F.lit(mode).cast("string").alias("mode")) for i, (n, label, ok, mode) in enumerate(parts)))
    return box.select(F.inline(made))


def verify(
    seg: DataFrame, candidates: Mapping[str, Candidate], columns: Mapping[str, Column], units: Mapping[str, str], box: DataFrame, specs: Mapping[str, Sequence[tuple[str, Column]]],
    target: str = "y", holdout: float = 0.02, extrapolation: float = 0.03, fit_limit: float = 0.5, dimension: bool = True,
) -> DataFrame:
    """Rows (candidate, ord, name, passed, value, mode): each gate that each candidate came to. seg has the columns and a segment."""
    spark = seg.sparkSession
    found, sound = metadata_checks(spark, candidates, list(columns), units, dimension)
    going = {n: candidates[n] for n in sound}
    if not going:
        return found
    null = F.lit(None).cast("string").alias("mode")
    parts, scales = [found], None
    if any(c.scale for c in going.values()):
        scales = fitted(seg.filter("segment = 'train'"), going, columns, target, fit_limit)
        parts.append(scales.select("candidate", F.lit(ORDER["fit"]).alias("ord"), F.lit("fit").alias("name"), "passed", "value", null))
    later = error_checks(seg, going, scales, columns, target, holdout, extrapolation).unionByName(scale_checks(box, specs, sound))
    if scales is not None:  # what did not fit goes no further
        later = later.join(F.broadcast(scales.filter(~F.col("passed")).select("candidate")), "candidate", "left_anti")
    return reduce(DataFrame.unionByName, [*parts, later])


def report(checks: DataFrame) -> DataFrame:
    """Rows (candidate, verdict, first_failed, failed, n_checks, hint), from rows of verify()."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "name"))))
    a = checks.groupBy("candidate").agg(F.bool_and("passed").alias("ok"), F.transform(failed, lambda x: x["name"]).alias("f"), F.count(F.lit(1)).alias("n_checks"))
    only = lambda name: F.array_join("f", ",") == name
    hint = (
        F.when(F.col("ok"), "passed").when(F.array_contains("f", "expression"), "syntax").when(F.array_contains("f", "fit"), "other family").when(only("dimension"), "units")
        .when(only("extrapolation"), "overfitted").otherwise("revise")
    )
    shape = F.when(F.exists("f", lambda x: x.startswith("scale-")), " (shape)").otherwise("")
    return a.select("candidate", F.when(F.col("ok"), "accepted").otherwise("rejected").alias("verdict"), F.get("f", F.lit(0)).alias("first_failed"), F.array_join("f", ",").alias("failed"), "n_checks", F.concat(hint, shape).alias("hint"))
