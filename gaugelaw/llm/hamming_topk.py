"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits. Within a block of codes, a query probes segment tables with
growing radii, one segment at a time: once segments 0 to j have been probed with radius s and the
others with s - 1, every code within Hamming distance m * s + j has been met (pigeonhole), so
the search ends as soon as k verified codes lie within that distance. Blocks of codes and blocks of
queries meet once each; the k best of each block are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, slices

SEGMENT = 16


def sign_codes(rows: DataFrame, id_col: str, vector_col: str, bits: int) -> DataFrame:
    """Rows (id, code): bit i is set if component i is positive. Vectors that are null, of another length, or hold null or NaN have no code and drop out."""
    pad = -bits % SEGMENT
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            ids, codes = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v is None or len(v) != bits or any(x is None or x != x for x in v):
                    continue
                ids.append(i)
                codes.append(np.packbits(np.pad(np.array(v) > 0, (0, pad))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(codes, pa.binary())], names=["id", "code"])

    return rows.select(id_col, vector_col).mapInArrow(run, f"id {kind}, code binary")


@cache
def masks(weight: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(SEGMENT), weight)], np.int64)


class SegmentIndex:
    """Segment tables over the distinct codes of a block; ids of equal codes are sorted, of which a search needs the first k."""

    def __init__(self, ids: np.ndarray, codes: list[bytes]):
        raw = np.frombuffer(b"".join(codes), ">u2").reshape(len(codes), -1).astype(np.int64)
        self.values, inverse = np.unique(raw, axis=0, return_inverse=True)
        by = np.lexsort((ids, inverse.ravel()))
        self.ids = ids[by]
        self.starts = np.searchsorted(inverse.ravel()[by], np.arange(len(self.values) + 1))
        self.m = self.values.shape[1]
        self.order = [np.argsort(self.values[:, j], kind="stable") for j in range(self.m)]
        self.sorted = [self.values[o, j] for j, o in enumerate(self.order)]

    def search(self, code: bytes, k: int, without: object) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest by (distance, id), ids equal to `without` left out."""
        q = np.frombuffer(code, ">u2").astype(np.int64)
        seen = np.zeros(len(self.values), bool)
        at, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = np.diff(self.starts)
        for s in range(SEGMENT + 1):
            for j in range(self.m):
                probe = q[j] ^ masks(s)
                lo, hi = np.searchsorted(self.sorted[j], probe), np.searchsorted(self.sorted[j], probe, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    n = hi[hit] - lo[hit]
                    run = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    found = self.order[j][run]
                    found = found[~seen[found]]
                    seen[found] = True
                    at.append(found)
                    distance.append(np.bitwise_count(self.values[found] ^ q).sum(1, dtype=np.int64))
                covered = np.concatenate(distance) <= self.m * s + j
                # one id more, as the query's own may be among them
                if size[np.concatenate(at)[covered]].sum() >= k + 1 and self._count(np.concatenate(at)[covered], without) >= k:
                    return self._best(np.concatenate(at), np.concatenate(distance), k, without)
        return self._best(np.concatenate(at), np.concatenate(distance), k, without)

    def _count(self, found: np.ndarray, without: object) -> int:
        return sum(int((self.ids[self.starts[i] : self.starts[i + 1]] != without).sum()) for i in found)

    def _best(self, found: np.ndarray, distance: np.ndarray, k: int, without: object) -> tuple[np.ndarray, np.ndarray]:
        ids, far = [], []
        total = 0
        for d in np.unique(distance):
            for i in found[distance == d]:
                own = self.ids[self.starts[i] : self.starts[i + 1]]
                own = own[own != without][:k]
                ids.append(own)
                far.append(np.full(len(own), d))
                total += len(own)
            if total >= k:
                break
        ids, far = np.concatenate(ids or [self.ids[:0]]), np.concatenate(far or [np.zeros(0, np.int64)])
        by = np.lexsort((ids, far))[:k]
        return ids[by], far[by]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, block_rows: int | None = None, block_queries: int = 20_000) -> DataFrame:
    """Rows (query_id, query_code, rank, id, distance): the k nearest index rows of each query row, by (distance, id).

    index and queries have (id, code) with codes of one length. A row with the query's own id is no
    result. Repeated index rows are results of their own; queries with equal id and code are
    answered once. Rows with null id or code are left out. With fewer than k rows all are returned;
    of ties at the last place the smallest ids. Index rows are copied once for each block of queries,
    queries once for each shard; other columns, whatever their names, are not read. Rows that are equal
    in id and code lie in one shard.
    """
    spark = index.sparkSession
    # codes are read several times: written once
    index = materialise(index.select("id", "code").filter("id is not null and code is not null"), "codes")
    queries = materialise(queries.select("id", "code").filter("id is not null and code is not null").distinct(), "queries")
    n, m = index.count(), queries.count()
    # as many shards as there are cores, of a few thousand rows at least and a million at most
    block_rows = block_rows or min(1_000_000, max(4_000, -(-n // spark.sparkContext.defaultParallelism)))
    shards, blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    kind = index.schema["id"].dataType.simpleString()
    own = index.withColumn("shard", F.pmod(F.xxhash64("id", "code"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", (F.pmod(F.xxhash64("id", "code"), F.lit(blocks))).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # a given number of partitions is left as it is, while small ones would be folded into one task
    own, asked = (x.repartition(4 * shards * blocks, "shard", "block") for x in (own, asked))

    def meet(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(ask):
            table = SegmentIndex(rows["id"].to_numpy(), rows["code"].tolist())
            for i, code in zip(ask["id"], ask["code"]):
                out += [(i, code, found, far) for found, far in zip(*table.search(code, k, i))]
        return pd.DataFrame(out, columns=["query_id", "query_code", "id", "distance"])

    best = own.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(meet, f"query_id {kind}, query_code binary, id {kind}, distance int")
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_code", "rank", "id", "distance")
