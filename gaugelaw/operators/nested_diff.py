"""Differences of nested documents: any JSON becomes rows of typed paths, and two snapshots are joined path by path.

A document is taken apart level by level with the VARIANT functions, all documents and all branches of a level in one
step; the number of steps is the depth of the deepest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order_statistics import same_group
from ..plans.stored import stored


def six_digits(x: Column) -> Column:
    """A number with six significant digits, as text; one that is then whole is written as such."""
    short = F.format_string("%.5e", x)
    whole = (F.abs(x) < 1e15) & (short.cast("double") == F.floor(short.cast("double")))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).when(whole, short.cast("double").cast("long").cast("string")).otherwise(short)


def _kind(v: Column) -> Column:
    """object, array, number, text, boolean or null."""
    told = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (told == "VOID"), "null").when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "text").when(told == "BOOLEAN", "boolean").otherwise("number")
    )


def flatten(docs: DataFrame, keys: Sequence[str], json_col: str) -> DataFrame:
    """Rows (keys..., path, kind, value) of every value in the documents: scalars, each array with its length (kind length), and each object.

    Paths are /name and [index]. Whole numbers are exact, others have six significant digits. Text that is no JSON, and null, is one row of the
    empty path and kind broken. A key that holds a slash or a bracket is written with them escaped by a backslash.
    """
    spark = docs.sparkSession
    start = docs.select(*keys, F.lit("").alias("path"), F.try_parse_json(json_col).alias("v"))
    broken = start.filter("v is null").select(*keys, "path", F.lit("broken").alias("kind"), F.lit(None).cast("string").alias("value"))
    level, out = start.filter("v is not null").withColumn("kind", _kind(F.col("v"))), broken
    while True:
        level = stored(level, "level")
        text = F.try_variant_get("v", "$", "string")
        number = F.when(F.schema_of_variant("v") == "BIGINT", text).otherwise(six_digits(F.try_variant_get("v", "$", "double")))
        value = F.when(F.col("kind") == "number", number).when(F.col("kind") != "null", text)
        out = out.unionByName(level.filter("kind not in ('object', 'array')").select(*keys, "path", "kind", value.alias("value")))
        inner = level.filter("kind in ('object', 'array')")
        if inner.isEmpty():
            return out
        # an outer explode keeps what is empty
        each = inner.select(*keys, F.col("path").alias("above"), F.col("kind").alias("holder"), "v")
        parts = each.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos").alias("at"), "key", F.col("value").alias("inside")))
        parts = stored(parts.select(*keys, "above", "holder", "at", "key", "inside"), "parts")
        sizes = parts.filter("holder = 'array'").groupBy(*keys, "above").agg(F.count("at").alias("n"))
        out = out.unionByName(sizes.select(*keys, F.col("above").alias("path"), F.lit("length").alias("kind"), F.col("n").cast("string").alias("value")))
        objects = inner.filter("kind = 'object'").select(*keys, "path", "kind", F.lit(None).cast("string").alias("value"))
        out = out.unionByName(objects)
        name = F.regexp_replace("key", r"([\\/\[\]])", r"\\$1")
        path = F.concat("above", F.when(F.col("holder") == "object", F.concat(F.lit("/"), name)).otherwise(F.concat(F.lit("["), F.col("at").cast("string"), F.lit("]"))))
        level = parts.filter("at is not null").select(*keys, path.alias("path"), F.col("inside").alias("v"), _kind(F.col("inside")).alias("kind"))


def diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str], json_col: str, environment: Sequence[str] = ("/environment",)) -> DataFrame:
    """Rows (keys..., part, path, finding, was, now) of what differs between two snapshots of documents.

    finding: added or missing (a path of one side), changed, retyped (another kind of value), length (of an array). What lies within
    such a path is not told again, but for objects and arrays of equal length, which are compared part by part. part: environment
    for paths below those named, which say where a document was made, else conclusion.
    """
    on = [*keys, "path"]
    a, b = (flatten(d, keys, json_col) for d in (expected, actual))
    names = {k: f"__by_{i}" for i, k in enumerate(on)}
    j = a.withColumnsRenamed({"kind": "kind_was", "value": "was"}).join(b.withColumnsRenamed(names | {"kind": "kind_now", "value": "now"}), same_group(on, names), "full_outer")
    finding = (
        F.when(F.col("kind_was").isNull(), "added").when(F.col("kind_now").isNull(), "missing").when(F.col("kind_was") != F.col("kind_now"), "retyped")
        .when(~F.col("was").eqNullSafe(F.col("now")), F.when(F.col("kind_was") == "length", "length").otherwise("changed"))
    )
    told = [F.when(F.col("kind_was").isNull(), F.col(names[k])).otherwise(F.col(k)).alias(k) for k in on]
    found = stored(j.withColumn("finding", finding).filter("finding is not null").select(*told, "finding", "was", "now"), "findings")
    # a place within another finding says nothing of its own
    cut = lambda i: F.substring("path", i, 1).isin("/", "[") & ((i == 1) | (F.substring("path", i - 1, 1) != "\\"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path"))), cut)
    inner = found.withColumn("__above", F.explode(F.transform(places, lambda i: F.substring("path", F.lit(1), i - 1))))
    names = {k: f"__by_{i}" for i, k in enumerate(on)}
    above = found.select(*(F.col(k).alias(n) for k, n in names.items()))
    within = inner.join(above, same_group(keys, names) & (F.col("__above") == F.col(names["path"])), "left_semi").select(*(F.col(k).alias(names[k]) for k in on)).distinct()
    found = found.join(within, same_group(on, names), "left_anti")
    below = F.lit(False)
    for e in environment:
        below = below | (F.col("path") == e) | F.col("path").startswith(f"{e}/") | F.col("path").startswith(f"{e}[")
    return found.select(*keys, F.when(below, "environment").otherwise("conclusion").alias("part"), "path", "finding", "was", "now")
