"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "/tmp/checkpoints/gaugelaw"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back, so that a lost executor costs no lineage; by: a column whose values have folders of their own."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by materialise() once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs whose results have been written: they stay until both garbage collectors run."""
    gc.collect()
    spark._jvm.System.gc()


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows: a task holds one piece of text at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 1024, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most `rows` rows and about `most` bytes of text; one row at least."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(column)), 0), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + most, "right")) - at))
            yield batch.slice(at, n)
            at += n


def in_one_task(rows: DataFrame, work: Callable[[Iterator[dict]], object]) -> object:
    """work(rows) in one task, which reads a few rows at a time; its result pickled. rows are a sample with a documented bound; the driver gets the result alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = work(r for b in slices(batches, 64) for r in b.to_pylist())
        gc.collect()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], names=["result"])

    found = rows.repartition(1).mapInArrow(run, "result binary").first()
    return pickle.loads(found["result"])


class Bags:
    """Many small arrays (buckets under 2 ** 16, weights, a few numbers each) in a few large ones, which go back to the system as a whole."""

    def __init__(self, each: int = 256):
        self.each, self.parts, self.rows = each, [], []
        self.buckets = self.weights = None
        self.start: list[int] = [0]

    def add(self, buckets: np.ndarray) -> None:
        i, n = np.unique(buckets, return_counts=True)
        self.rows.append((i.astype(np.uint16), (n / n.sum()).astype(np.float32)))
        self.start.append(self.start[-1] + len(i))
        if len(self.rows) >= self.each:
            self._close()

    def _close(self) -> None:
        if self.rows:
            self.parts.append(tuple(np.concatenate(x) for x in zip(*self.rows)))
            self.rows = []

    def __len__(self) -> int:
        return len(self.start) - 1

    def whole(self) -> Bags:
        self._close()
        if self.parts:
            self.buckets, self.weights = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        return self

    def __getitem__(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.start[j], self.start[j + 1]
        return self.buckets[a:z], self.weights[a:z]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each distinct one is hashed once."""
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    return np.array([known[w] for w in words], np.uint64)


