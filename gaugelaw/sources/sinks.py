"""Sinks: imported tables, sealed segments, manifests and an archive that grows by what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Names under which a manifest would list rows, which would give the sealed ones away.
INDEX_NAMES = ("index", "indices", "row", "rows", "row_ids")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir; machines share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "/tmp/checkpoints/gaugelaw"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_import(df: DataFrame, target: str, path: str, separator: str | None = None) -> None:
    """df with its target first and named y: Parquet, or delimited text with a header."""
    out = df.select(F.col(target).alias("y"), *(c for c in df.columns if c != target))
    if separator:
        out.write.csv(path, sep=separator, header=True)
    else:
        out.write.parquet(path)


def seal(segments: DataFrame, open_path: str, sealed_path: str) -> None:
    """The training rows beside the task, all others in another place, by segment."""
    segments.filter("segment = 'train'").write.partitionBy("segment").parquet(open_path)
    segments.filter("segment <> 'train'").write.partitionBy("segment").parquet(sealed_path)


def _index_names(kind, at: str = "") -> list[str]:
    if isinstance(kind, StructType):
        return [x for f in kind for x in (([f"{at}{f.name}"] if f.name.lower() in INDEX_NAMES and isinstance(f.dataType, (ArrayType, MapType, StructType)) else []) + _index_names(f.dataType, f"{at}{f.name}."))]
    if isinstance(kind, ArrayType):
        return _index_names(kind.elementType, at)
    return _index_names(kind.valueType, at) if isinstance(kind, MapType) else []


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest as JSON lines; one that lists rows is refused."""
    if found := _index_names(manifest.schema):
        raise ValueError(f"a manifest may not list rows: {found}")
    manifest.write.json(path)


def write_split(segments: DataFrame, axis: str, path: str) -> None:
    """The manifest of a split: size, range of the target and an order-free fingerprint of each segment; no row is listed."""
    from ..plans.split import fingerprint

    key = F.to_json(F.struct(*sorted(c for c in segments.columns if c != "segment")))
    write_manifest(fingerprint(segments, key, y_min=F.min("y"), y_max=F.max("y")).withColumn("axis", F.lit(axis)), path)


def split_drift(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (segment, status): equal, changed, missing or new, of a split made again against its manifest."""
    from ..plans.split import fingerprint

    key = F.to_json(F.struct(*sorted(c for c in segments.columns if c != "segment")))
    now = fingerprint(segments, key).select("segment", F.col("digest").alias("now"))
    j = now.join(manifest.select("segment", F.col("digest").alias("was")), "segment", "full_outer")
    return j.select("segment", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "equal").otherwise("changed").alias("status"))


def write_evidence(runs: DataFrame, checks: DataFrame, files: DataFrame, path: str) -> None:
    """Runs, checks and, last, the manifest of their files (run_id, rel_path, sha256), below path. Check names that a run has twice, and runs that were there with other files, are kept beside them."""
    from ..operators import evidence

    spark = runs.sparkSession
    old = _read_if_there(spark, f"{path}/manifest")
    if old is not None:
        evidence.overwritten(evidence.run_digests(old), evidence.run_digests(files), "run_id").write.mode("append").parquet(f"{path}/overwritten")
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    checks.write.mode("overwrite").parquet(f"{path}/checks")
    evidence.duplicate_checks(checks).write.mode("overwrite").parquet(f"{path}/duplicate_checks")
    files.write.mode("overwrite").parquet(f"{path}/manifest")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines and as delimited text with a header."""
    scores.write.json(f"{path}/json")
    scores.write.csv(f"{path}/csv", header=True)


def append_round(rows: DataFrame, number: int, path: str) -> None:
    """One round of a trajectory, as JSON lines below its number; a round that is written again replaces itself, as round 1 replaces all."""
    mode = "overwrite"
    out = rows.withColumn("round", F.lit(number))
    if number == 1:
        out.write.mode(mode).json(f"{path}/round=1")
        _delete_others(rows.sparkSession, path, "round=1")
    else:
        out.write.mode(mode).json(f"{path}/round={number}")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _delete_others(spark: SparkSession, path: str, keep: str) -> None:
    fs, p = _fs(spark, path)
    for f in fs.listStatus(p):
        if f.getPath().getName() != keep:
            fs.delete(f.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    fs, p = _fs(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None


def archive(spark: SparkSession, records: DataFrame, id_col: str, path: str) -> DataFrame:
    """Append the records whose id and digest the archive at path does not hold; returns the archive.

    The digest is over all columns. A second call with the same records adds nothing. The columns
    batch and digest are added; a call that adds nothing takes no batch number. Repeated records are
    stored once. One writer at a time: two that run at once may take the same number.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}), 256)
    new = records.withColumn("digest", digest).dropDuplicates([id_col, "digest"])
    held = _read_if_there(spark, path)
    batch = 1
    if held is not None:
        new = new.join(held.select(id_col, "digest"), [id_col, "digest"], "left_anti")
        batch = (held.agg(F.max("batch")).first()[0] or 0) + 1
    new.select(*records.columns, "digest", F.lit(batch).alias("batch")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
