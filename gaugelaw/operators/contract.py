"""The contract of a set of tasks, as findings (task_id, severity, code).

Each of the three audits is one pass over its table: conditions over a task's metadata row, one
grouped aggregate over the cells of all tasks, and one grouped union over the ids of a set's parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import UNITS

ERROR, WARN = "error", "warn"
LAYERS = ("base", "challenge")
NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
#: File names that would give an answer away; then those that may stand beside a task.
LEAK, ALLOWED = r"(?i)(reference|answer|ground[_-]?truth|ground|solution|truth|label|golden|expected[_-]?formula)", ("data.csv", "meta.json", "data_train.csv", "split.json", "candidates.json")


def _unit_pattern() -> str:
    part = r"\(*(?:" + "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True)) + r"|-|\d+)\)*(?:\^\(?-?\d+(?:/\d+)?\)?|\d+)?\)*"
    return f"^{part}(?:[*/]{part})*$"


def _any(column: Column, test) -> Column:
    return F.coalesce(F.exists(column, test), F.lit(False))


def _twice(column: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(column)) < F.size(column), F.lit(False))


def _found(rows: DataFrame, id_col: str, conditions: list[tuple[str, str, Column]]) -> DataFrame:
    made = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.coalesce(hit, F.lit(False)).alias("hit")) for s, c, hit in conditions))
    return rows.select(F.col(id_col).alias("task_id"), F.inline(F.filter(made, lambda x: x["hit"]))).drop("hit")


def meta_findings(metas: DataFrame) -> DataFrame:
    """Findings of metadata rows (task_id, folder, var_names array, units map, layer, source array, free_parameters array, sampling map of arrays, sample_count)."""
    v, params, units, sampling = (F.col(c) for c in ("var_names", "free_parameters", "units", "sampling"))
    known = F.concat(F.coalesce(v, F.array().cast("array<string>")), F.coalesce(params, F.array().cast("array<string>")), F.array(F.lit("y")))
    keys, ranges = F.map_keys(units), F.map_values(sampling)
    pattern = _unit_pattern()
    return _found(metas, "task_id", [
        (ERROR, "MISSING_FIELD", v.isNull() | F.col("task_id").isNull() | F.col("source").isNull()),
        (ERROR, "BAD_TYPE", F.col("sample_count").isNull() | (F.col("sample_count") < 0)),
        (ERROR, "TASK_ID_MISMATCH", F.col("task_id") != F.col("folder")),
        (ERROR, "BAD_VAR_NAMES", (F.size(v) == 0) | _any(v, lambda x: x.isNull() | ~x.rlike(NAME))),
        (ERROR, "DUP_VAR", _twice(v)),
        (ERROR, "RESERVED_NAME", F.array_contains(v, "y")),
        (WARN, "FEW_VARS", F.size(v) == 1),
        (ERROR, "BAD_LAYER", ~F.col("layer").isin(*LAYERS) | F.col("layer").isNull()),
        (ERROR, "EMPTY_SOURCE", F.size("source") == 0),
        (WARN, "SOURCE_NOT_URL", _any(F.col("source"), lambda x: ~x.rlike("^https?://"))),
        (ERROR, "BAD_UNITS", units.isNull()),
        (WARN, "UNKNOWN_UNIT_KEY", _any(keys, lambda k: ~F.array_contains(known, k))),
        (WARN, "UNKNOWN_UNIT", _any(F.map_values(units), lambda u: ~F.trim(u).rlike(pattern) & (F.trim(u) != ""))),
        (WARN, "MISSING_Y_UNIT", ~F.array_contains(keys, "y")),
        (ERROR, "BAD_PARAMS", _any(params, lambda x: x.isNull() | ~x.rlike(NAME))),
        (ERROR, "PARAM_COLLISION", F.arrays_overlap(params, F.concat(v, F.array(F.lit("y"))))),
        (ERROR, "DUP_PARAM", _twice(params)),
        (ERROR, "BAD_SAMPLING", _any(ranges, lambda r: r.isNull() | (F.size(r) != 2))),
        (ERROR, "SAMPLING_UNKNOWN_VAR", _any(F.map_keys(sampling), lambda k: ~F.array_contains(v, k))),
        (ERROR, "SAMPLING_RANGE", _any(ranges, lambda r: (F.size(r) == 2) & (r[0] >= r[1]))),
    ])


def cell_findings(tasks: DataFrame, lines: DataFrame, least: int = 50, enough: int = 200) -> DataFrame:
    """Findings of data tables: tasks (task_id, var_names, header array, sample_count, sampling), lines (task_id, line_no, cells array).

    Blank lines don't count. A short or long line is ragged, and its other cells aren't judged.
    """
    cells = F.transform("cells", lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells).filter(F.exists("cells", lambda c: c != "")).join(tasks.select("task_id", "header", "sampling"), "task_id")
    whole = F.size("cells") == F.size("header")
    values = F.transform("cells", lambda c: c.try_cast("double"))
    rows = rows.withColumns({"whole": whole, "values": F.when(whole, values)})
    outside = F.exists(F.map_entries("sampling"), lambda e: (F.get("values", F.array_position("header", e["key"]).cast("int") - 1) < e["value"][0]) | (F.get("values", F.array_position("header", e["key"]).cast("int") - 1) > e["value"][1]))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    head = rows.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("whole")).alias("ragged"), F.count_if(F.exists("values", lambda x: x.isNull())).alias("text"),
        F.count_if(F.exists("values", lambda x: x.isNotNull() & ~finite(x))).alias("endless"), F.count_if(outside).alias("outside"),
    )
    by_column = rows.select("task_id", F.posexplode("values").alias("at", "v")).groupBy("task_id", "at").agg((F.min("v") == F.max("v")).alias("constant")).groupBy("task_id").agg(F.bool_or("constant").alias("constant"))
    a = tasks.join(head, "task_id", "left").join(by_column, "task_id", "left")
    n = F.coalesce("n", F.lit(0))
    return _found(a, "task_id", [
        (ERROR, "EMPTY_CSV", n == 0),
        (ERROR, "CSV_DUP_COL", _twice(F.col("header"))),
        (ERROR, "CSV_MISSING_Y", ~F.array_contains("header", "y")),
        (ERROR, "CSV_MISSING_COL", _any(F.col("var_names"), lambda x: ~F.array_contains("header", x))),
        (ERROR, "CSV_RAGGED", F.col("ragged") > 0),
        (ERROR, "CSV_NON_NUMERIC", F.col("text") > 0),
        (ERROR, "CSV_NONFINITE", F.col("endless") > 0),
        (ERROR, "CSV_TOO_FEW", (n > 0) & (n < least)),
        (WARN, "CSV_BELOW_MIN", (n >= least) & (n < enough)),
        (ERROR, "SAMPLE_COUNT_MISMATCH", F.col("sample_count") != n),
        (ERROR, "CONSTANT_COL", F.col("constant")),
        (WARN, "SAMPLING_MISMATCH", F.col("outside") > 0),
    ])


def first_bad_cells(tasks: DataFrame, lines: DataFrame, most: int = 5) -> DataFrame:
    """Rows (task_id, line_no, name, cell): of each task the first cells that are no finite number, in the order of lines and columns."""
    rows = lines.join(tasks.select("task_id", "header"), "task_id").filter(F.size("cells") == F.size("header"))
    each = rows.select("task_id", "line_no", "header", F.posexplode("cells").alias("at", "cell")).select("task_id", "line_no", "at", F.get("header", F.col("at")).alias("name"), F.trim("cell").alias("cell"))
    value = F.col("cell").try_cast("double")
    bad = each.filter(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("line_no", "at"))  # cut in each task before the shuffle
    return bad.withColumn("k", place).filter(F.col("k") <= most).select("task_id", "line_no", "name", "cell")


def set_findings(tasks: DataFrame | None, references: DataFrame, files: DataFrame, splits: DataFrame, sealed: DataFrame) -> DataFrame:
    """Findings of a set: tasks (None: their root is missing), references, splits and sealed have a task_id each, files (task_id, name, readable)."""
    if tasks is None:
        return references.sparkSession.createDataFrame([("*", ERROR, "MISSING_TASKS_ROOT")], "task_id string, severity string, code string")
    side = lambda df, name: df.select(F.col("task_id").cast("string").alias("task_id"), F.lit(name).alias("side"))
    ids = side(tasks, "task").union(side(references, "reference")).union(side(splits, "split")).union(side(sealed, "sealed"))
    has = {s: F.count_if(F.col("side") == s).alias(s) for s in ("task", "reference", "split", "sealed")}
    by_id = ids.groupBy("task_id").agg(*has.values())
    task = F.col("task") > 0
    found = _found(by_id, "task_id", [
        (ERROR, "MISSING_REFERENCE", task & (F.col("reference") == 0)),
        (ERROR, "ORPHAN_REFERENCE", ~task & (F.col("reference") > 0)),
        (ERROR, "SPLIT_MISSING", task & (F.col("split") == 0)),
        (WARN, "SEALED_MISSING", task & (F.col("split") > 0) & (F.col("sealed") == 0)),
    ])
    alike = tasks.groupBy(F.lower("task_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n"))
    found = found.union(_found(alike, "task_id", [(ERROR, "DUP_TASK_ID", F.col("n") > 1)]))
    named = files.groupBy("task_id").agg(
        F.bool_or(F.col("name").rlike(LEAK) & ~F.col("name").isin(*ALLOWED)).alias("leak"), F.bool_or(F.col("name") == "meta.json").alias("meta"),
        F.bool_or(F.col("name") == "data.csv").alias("data"), F.bool_or((F.col("name") == "meta.json") & ~F.col("readable")).alias("broken"),
    )
    by_task = tasks.select(F.col("task_id").cast("string").alias("task_id")).distinct().join(named, "task_id", "left")
    found = found.union(_found(by_task, "task_id", [
        (ERROR, "LEAK_FILE", F.col("leak")), (ERROR, "MISSING_META", ~F.coalesce("meta", F.lit(False))),
        (ERROR, "MISSING_CSV", ~F.coalesce("data", F.lit(False))), (ERROR, "BAD_JSON", F.col("broken")),
    ]))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).withColumn("task_id", F.lit("*"))
    return found.union(_found(count(tasks), "task_id", [(ERROR, "NO_TASKS", F.col("n") == 0)])).union(_found(count(references), "task_id", [(ERROR, "MISSING_REFERENCE_ROOT", F.col("n") == 0)]))
