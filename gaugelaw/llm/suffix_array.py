"""Distributed difference-cover suffix ranking over a collection of short symbol strings.

The suffixes at positions 1 and 2 modulo 3 are sampled: their triples are sorted and named, the
names form one reduced string for each input string, and its triples are sorted in turn. Such a
name of names orders a sampled suffix by nine symbols. The remaining suffixes are sorted by
their first symbol and the rank of the sampled suffix behind it. Ranks are compared up to nine
symbols, which is all that equal_prefixes() needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

DEPTH = 9


def _triples(strings: DataFrame, sampled: bool) -> DataFrame:
    """Rows (sid, pos, t0, t1, t2); 0 stands behind the end of a string."""
    at = strings.select("sid", "syms", F.posexplode("syms").alias("pos", "t0"))
    if sampled:
        at = at.filter("pos % 3 <> 0")
    return at.select("sid", "pos", "t0", *(F.coalesce(F.try_element_at("syms", F.col("pos") + 1 + i), F.lit(0)).cast("long").alias(f"t{i}") for i in (1, 2)))


def _name(triples: DataFrame) -> DataFrame:
    """Rows (sid, pos, name): names are equal for equal triples and in their order."""
    t = ["t0", "t1", "t2"]
    # ids grow with the partition and, in it, with the row; written once, so that they stay as they are
    names = materialise(triples.select(t).distinct().repartitionByRange(*t).sortWithinPartitions(*t).withColumn("name", F.monotonically_increasing_id() + 1), "names")
    return triples.join(names, t).select("sid", "pos", "name")


def sample_ranks(strings: DataFrame) -> DataFrame:
    """Rows (sid, pos, rank) of the sampled suffixes of strings (sid, syms array<long> of positive symbols), ordered by nine symbols."""
    named = _name(_triples(strings, True))
    # names of positions 1, 4, 7, ..., an end mark, those of 2, 5, 8, ...
    order = F.array_sort(F.collect_list(F.struct((F.col("pos") % 3).alias("r"), "pos", "name")))
    both = named.groupBy("sid").agg(order.alias("x"))
    ones = F.size(F.filter("x", lambda e: e["r"] == 1))
    part = lambda r: F.transform(F.filter("x", lambda e: e["r"] == r), lambda e: e["name"])
    reduced = both.select("sid", ones.alias("ones"), F.concat(part(1), F.array(F.lit(0).cast("long")), part(2)).alias("syms"))
    reduced = materialise(reduced, "reduced")
    ranked = _name(_triples(reduced, False)).join(reduced.select("sid", "ones"), "sid").filter("pos <> ones")
    pos = F.when(F.col("pos") < F.col("ones"), 1 + 3 * F.col("pos")).otherwise(2 + 3 * (F.col("pos") - F.col("ones") - 1))
    return ranked.select("sid", pos.cast("int").alias("pos"), F.col("name").alias("rank"))


def _adjacent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (sid, pos) whose prefix equals that of a neighbour in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for b in batches:
            out = []
            for sid, pos, prefix in zip(b["sid"].to_pylist(), b["pos"].to_pylist(), b["prefix"].to_pylist()):
                if last is None:
                    first = (sid, pos, prefix)
                elif last[2] == prefix:
                    out += [(*last[:2], None), (sid, pos, None)]
                last = (sid, pos, prefix)
            yield record(out)
        # a partition's first and last rows may have their neighbours in another one
        yield record([x for x in (first, last) if x])

    def record(out: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["sid", "pos", "edge"])

    found = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("sid", "pos", "prefix").mapInArrow(run, "sid long, pos int, edge binary"), "adjacent")
    edges = found.filter("edge is not null").distinct()
    twice = edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("edge")
    return found.filter("edge is null").select("sid", "pos").union(edges.join(twice, "edge").select("sid", "pos")).distinct()


def equal_prefixes(strings: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows (sid, pos) of starts whose suffix shares its prefix with another suffix in starts.

    strings: (sid, syms array<long> of positive symbols); starts: (sid, pos, prefix binary), where
    prefix stands for the first symbols of the suffix, at most nine. Sampled and remaining suffixes
    are merged two classes at a time, each in the order that a difference cover gives them, and
    neighbours are compared; of equal prefixes all lie next to each other in that order.
    """
    ranks = materialise(sample_ranks(strings), "ranks")

    def rank(shift: int) -> DataFrame:
        return ranks.select("sid", (F.col("pos") - shift).alias("pos"), F.col("rank").alias(f"r{shift}"))

    symbol = lambda i: F.coalesce(F.try_element_at("syms", F.col("pos") + 1 + i), F.lit(0))
    rows = starts.join(strings, "sid").select("sid", "pos", "prefix", symbol(0).alias("s0"), symbol(1).alias("s1"))
    for shift in range(3):
        rows = rows.join(rank(shift), ["sid", "pos"], "left").fillna(0, [f"r{shift}"])
    rows = materialise(rows, "suffixes")
    merged = [_adjacent(rows.filter("pos % 3 <> 2"), ["s0", "r1"]), _adjacent(rows.filter("pos % 3 <> 1"), ["s0", "s1", "r2"]), _adjacent(rows.filter("pos % 3 <> 0"), ["r0"])]
    return merged[0].union(merged[1]).union(merged[2]).distinct()
