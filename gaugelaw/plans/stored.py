"""Intermediate tables in the shared folder: written once, read by the steps that follow, deleted when done."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.sinks import shared_folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of stored() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Tables that only a result's computation needs: done() writes the result and deletes them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def store(self, df: DataFrame, what: str) -> DataFrame:
        self.tables.append(stored(df, what))
        return self.tables[-1]

    def done(self, df: DataFrame, what: str) -> DataFrame:
        out = stored(df, what)
        for t in self.tables:
            forget(t)
        self.tables.clear()
        return out
