"""Readers of numeric tables: delimited text with an unknown separator, JSON in three shapes, Parquet, wide year tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

SEPARATORS = (",", ";", "\t", "|")


class UnknownFormat(ValueError):
    """A table file whose extension has no reader."""


def sniff(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator that stands equally often, and most often, in each of the first lines; by extension if none does."""
    head = [r["value"] for r in spark.read.text(path).filter("trim(value) <> ''").limit(lines).collect()]
    often = {s: {h.count(s) for h in head} for s in SEPARATORS}
    regular = {s: min(n) for s, n in often.items() if len(n) == 1 and min(n) > 0}
    return max(regular, key=regular.get) if regular else "\t" if path.endswith(".tsv") else ","


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as strings, under their trimmed header names; a byte order mark is dropped. Names that occur twice are an error."""
    df = spark.read.csv(path, sep=separator or sniff(spark, path), header=True, inferSchema=False)
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns occur twice: {twice}")
    return df.toDF(*names)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or one object of columns, whose short columns end in nulls."""
    df = spark.read.json(path, multiLine=True)
    if df.columns and all(isinstance(f.dataType, ArrayType) for f in df.schema):
        df = df.select(F.inline(F.arrays_zip(*df.columns)))
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The reader for the path's extension."""
    match PurePosixPath(path).suffix.lower():
        case ".csv" | ".tsv" | ".txt":
            return read_delimited(spark, path)
        case ".json":
            return read_json(spark, path)
        case ".jsonl":
            return spark.read.json(path)
        case ".parquet":
            return spark.read.parquet(path)
        case other:
            raise UnknownFormat(f"no reader for {other or path}")


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns as doubles; what is no number becomes null, which the audits find."""
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in columns})


class TooFewRows(ValueError):
    """A series that is too short to be used."""


def wide_years(df: DataFrame, year: str, bands: Sequence[str] | Mapping[str, str], least: int = 0) -> DataFrame:
    """Rows (year, band, v) of a table with a column for each band; rows without a year or with a gap are dropped.

    bands: the columns, or a name for each column. Under `least` whole years are an error.
    """
    names = dict(bands) if isinstance(bands, Mapping) else {b: b for b in bands}
    df, bands = df.withColumnsRenamed(names), list(names.values())
    whole = numeric(df.filter(F.trim(year).rlike(r"^\d+$")), bands).dropna(subset=list(bands))
    if least and (n := whole.count()) < least:
        raise TooFewRows(f"{n} whole years, {least} are needed")
    return whole.select(F.trim(year).cast("int").alias("year"), *bands).unpivot("year", list(bands), "band", "v")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run.json of each run folder below root, with the folder's name as run_id; folders without one are skipped."""
    runs = spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/*/run.json")
    return runs.withColumn("run_id", F.element_at(F.split("_metadata.file_path", "/"), -2))


def read_checks(spark: SparkSession, root: str) -> DataFrame:
    """Rows (run_id, file, name, passed, metrics JSON) of the check files of all run folders below root; a file that is no object with a name is dropped."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/checks/*.json", wholetext=True)
    place = F.split("_metadata.file_path", "/")
    rows = raw.select(F.element_at(place, -3).alias("run_id"), F.element_at(place, -1).alias("file"), F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.passed").try_cast("boolean").alias("passed"), F.get_json_object("value", "$.metrics").alias("metrics"))
    return rows.filter("name is not null")


def runs_by_task(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows (task_id, run_id, verdict, n_checks, failed) of runs with their checks; a run without a task has the task null, one without checks none."""
    # a run has a few dozen checks
    failed = F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("name")))), ",")
    each = checks.groupBy("run_id").agg(F.count("*").alias("n_checks"), failed.alias("failed"))
    j = runs.select("task_id", "run_id", "verdict").join(each, "run_id", "left")
    return j.select("task_id", "run_id", "verdict", F.coalesce("n_checks", F.lit(0)).alias("n_checks"), F.coalesce("failed", F.lit("")).alias("failed"))


def read_ledger(spark: SparkSession, path: str, session: str = "session_id", time: str = "ts", kind: str = "type") -> DataFrame:
    """Rows (session, at, kind, entry JSON, sound) of the lines of a ledger, one JSON object each; a line that is none, or has no session, is kept and not sound. Blank lines are dropped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    of = lambda name: F.get_json_object("value", f"$.{name}")
    at = F.coalesce(of(time).try_cast("timestamp"), F.timestamp_millis((of(time).try_cast("double") * 1000).cast("long")))
    return lines.select(of(session).alias("session"), at.alias("at"), of(kind).alias("kind"), F.col("value").alias("entry"), (of(session).isNotNull()).alias("sound"))


def read_zonal(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """Rows (year int, bands array<double>) of lines "year,v1,...": a line with another number of cells, or with a cell that is no number, is dropped."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c).try_cast("double"))
    rows = spark.read.text(path).select(cells.alias("c")).filter((F.size("c") == arity + 1) & ~F.exists("c", lambda x: x.isNull()))
    return rows.select(F.element_at("c", 1).cast("int").alias("year"), F.slice("c", 2, arity).alias("bands"))


class WrongDigest(ValueError):
    """A file whose content is not the one that was asked for."""


def read_fixed(spark: SparkSession, path: str, names: Sequence[str], sha256: str | None = None) -> DataFrame:
    """Doubles of lines with exactly len(names) cells between white space; other lines are dropped. sha256: of the one file at path, which has to be its digest."""
    if sha256:
        found = [r["d"] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).limit(2).collect()]
        if found != [sha256]:
            raise WrongDigest(f"{path} has another digest: {found}")
    cells = F.split(F.trim("value"), r"\s+")
    values = F.transform(cells, lambda c: c.try_cast("double"))
    rows = spark.read.text(path).filter(F.size(cells) == len(names)).select(values.alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    return rows.select(*(F.element_at("v", i + 1).alias(n) for i, n in enumerate(names)))


def read_task(spark: SparkSession, folder: str, data: str = "data.csv", meta: str = "meta.json") -> tuple[DataFrame, DataFrame]:
    """(data, metadata) of a task folder; an error if either is missing. Answers, which lie elsewhere, are never read."""
    parts = {n: f"{folder.rstrip('/')}/{n}" for n in (data, meta)}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name, path in parts.items():
        p = hadoop(path)
        if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            raise FileNotFoundError(f"{folder} has no {name}")
    return read_delimited(spark, parts[data], ","), spark.read.json(parts[meta], multiLine=True)


#: Fixed value: the schema that a file of scale specs has to name.
SPEC_SCHEMA = "scale-specs@1"


def read_specs(spark: SparkSession, path: str, schema: str = SPEC_SCHEMA) -> DataFrame:
    """Rows (task_id, nominal map, place, kind, spec JSON), one for each check, of lines {"schema", "task_id", "nominal_parameters", "checks"}; a line of another schema is an error."""
    kinds = "schema string, task_id string, nominal_parameters map<string,double>, checks array<string>"
    raw = spark.read.schema(kinds).json(path)
    known = F.when(F.col("schema") == schema, F.col("task_id")).otherwise(F.raise_error(F.concat(F.lit("scale specs of another schema: "), F.coalesce("schema", F.lit("none")))).cast("string"))
    rows = raw.select(known.alias("task_id"), F.col("nominal_parameters").alias("nominal"), F.posexplode("checks").alias("place", "spec"))
    return rows.select("task_id", "nominal", "place", F.get_json_object("spec", "$.kind").alias("kind"), "spec")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Rows (task_id, place, formula, parameters map) of lines {"task_id", "candidates"}, each candidate a text or {"formula", "parameters"}."""
    rows = spark.read.schema("task_id string, candidates array<string>").json(path).select("task_id", F.posexplode("candidates").alias("place", "c"))
    whole = F.from_json("c", "formula string, parameters map<string,double>")
    return rows.select("task_id", "place", F.when(F.col("c").startswith("{"), whole["formula"]).otherwise(F.col("c")).alias("formula"), F.when(F.col("c").startswith("{"), whole["parameters"]).alias("parameters"))
