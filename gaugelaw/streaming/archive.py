"""Streams of records: an archive without repeats, and closed windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import allocate
from ..plans.stored import stored
from ..sources.sinks import exists, shared_folder


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Parquet files at path, a folder or a pattern, as a stream of what is there and what comes later; files: how many a batch takes at most."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _run(stream: DataFrame, what: str) -> DataFrame:
    """All that is there now, in as many batches as it takes, as a table in the shared folder."""
    spark = stream.sparkSession
    path, state = shared_folder(spark, what), shared_folder(spark, f"{what}-state")
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _timed(stream: DataFrame, time_col: str) -> DataFrame:
    """Event times with the session's time zone, which watermarks need."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def archive_stream(stream: DataFrame, id_col: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Each (id, content) once. State is kept for delay, so a repeat must come within it; later rows are dropped (archive_all keeps them)."""
    digest = F.sha2(F.to_json(F.struct(*sorted(stream.columns))), 256)
    return _run(_timed(stream.withColumn("digest", digest), time_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col, "digest"]), "archive")


def archive_all(stream: DataFrame, id_col: str, time_col: str, path: str, state: str, delay_seconds: int = 600) -> DataFrame:
    """Each (id, content) of a stream once, late ones in a bucket of their own; returns the archive at path, with its columns run_name, bucket and batch.

    A row is late if it is more than delay_seconds behind the latest time of the batches before. Each gets a name, its day and the smallest
    free number of that day. What is held is told by an index of ids, digests, times and numbers beside the rows. Both are
    written by batch, so that a batch that runs again after a failure writes the same once more. state is the stream's
    checkpoint: a later call with the same state and path goes on where the last one ended. Rows without a time are late.
    """
    spark = stream.sparkSession
    columns = stream.columns
    digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    kinds = f"{id_col} {stream.schema[id_col].dataType.simpleString()}, digest string, at timestamp, day string, number long, batch long"

    def store(rows: DataFrame, batch: int) -> None:
        index = spark.read.schema(kinds).parquet(f"{path}/index") if exists(spark, f"{path}/index") else spark.createDataFrame([], kinds)
        held = index.filter(F.col("batch") < batch)
        latest = held.agg(F.max("at")).first()[0]
        new = rows.withColumns({"digest": digest, "at": F.col(time_col).cast("timestamp")}).dropDuplicates([id_col, "digest"])
        new = new.join(held.select(id_col, "digest"), [id_col, "digest"], "left_anti")
        late = F.lit(False) if latest is None else F.coalesce(F.col("at") < F.lit(latest) - F.expr(f"interval {delay_seconds} seconds"), F.lit(True))
        new = new.withColumns({"bucket": F.when(late, "late").otherwise("on_time"), "day": F.coalesce(F.date_format("at", "yyyyMMdd"), F.lit("undated"))})
        named = stored(allocate(new, held.select("day", "number"), "day", [id_col, "digest"]), "named")
        told = F.col("number").cast("string")  # four digits at least; lpad alone would cut longer ones
        named.withColumn("run_name", F.concat_ws("_", "day", F.lpad(told, F.greatest(F.lit(4), F.length(told)), "0"))).select(*columns, "digest", "run_name", "bucket").write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        named.select(id_col, "digest", "at", "day", "number").write.mode("overwrite").parquet(f"{path}/index/batch={batch}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def closed_windows(stream: DataFrame, by: str, value: str, time_col: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows (window_start, by, n, total) of the windows that the watermark has closed."""
    w = _timed(stream, time_col).withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return _run(w.select(F.col("w.start").alias("window_start"), by, "n", "total"), "windows")
