"""Near-duplicate classes with SetSketch registers.

A register holds floor(1 - log_b of a minimum of exponential variates), truncated to 16 bits: exponentially
spaced minima that merge by maximum and are equal for two sets with about the chance of their
Jaccard similarity. Bands of registers give candidates; the counts of larger, smaller and equal
registers give the most likely similarity jointly with the known set sizes; what is likely enough is
verified on the full sets.

Documents with equal sets form a class first, and only classes are compared. In each band bucket all
classes are compared with one pivot, the one that meets most others over all buckets, which links a
group of copies in work linear in its size. Only buckets whose members then still lie in several
components have the members outside the commonest one compared with the others, in blocks, where only
links that join components become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, release, slices, text_or_empty, word_hashes
from .components import connected_components

REGISTERS = 256
BASE = 1.001
RATE = 20.0
SMALL = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240607)
_multiply = _rng.integers(0, 2**32, (2, REGISTERS, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def band_rows(percent: int) -> int:
    """The most registers in a band with which a pair at the threshold is missed with a chance under 1e-8."""
    return max(r for r in range(1, 17) if r == 1 or (1 - (percent / 100) ** r) ** (REGISTERS // r) < 1e-8)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of the whole sequence if it has fewer words; none without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set; merge(sketch(a), sketch(b)) is that of the union."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    low, high = (hashes & np.uint64(2**32 - 1)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(hashes), 1024):
        v = low[at : at + 1024] * _multiply[0] + high[at : at + 1024] * _multiply[1]
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x7FEB352D)
        v ^= v >> np.uint32(15)
        least = np.minimum(least, v.min(1))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 20_000, 0, 65_535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


_grid = np.linspace(0, 1, 101)


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarities of sets of n and m members, by how many registers of the first are larger and smaller."""
    u = (n / (n + m))[:, None]
    v = 1 - u
    j = np.minimum(_grid[None, :], np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-12)
    like = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + (REGISTERS - larger - smaller)[:, None] * np.log(same)
    return j[np.arange(len(u)), like.argmax(1)]


def least_estimate(percent: int) -> float:
    """Five standard deviations under the threshold."""
    t = percent / 100
    return t - 5 * (t * (1 - t) / REGISTERS) ** 0.5


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows, of sets of n and m members, may reach the threshold."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    return fits & (likely_similarity(larger, smaller, n.astype(float), m.astype(float)) >= least_estimate(percent))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text_hash, n_shingles, fingerprint, registers); the last two are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, fingerprint, registers = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                fingerprint.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fingerprint, pa.binary()), pa.array(registers, pa.binary())], names=["id", "text_hash", "n_shingles", "fingerprint", "registers"])

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, f"id {kind}, text_hash long, n_shingles long, fingerprint binary, registers binary")


def bands(classes: DataFrame, rows: int) -> DataFrame:
    """Rows (bucket, cls): a hash of each band's number and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = REGISTERS // rows
        for b in slices(batches, 2048):
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS)[:, : count * rows].reshape(b.num_rows, count, rows)
            h = np.full((b.num_rows, count), 0, np.uint64) + np.arange(1, count + 1, dtype=np.uint64)
            for i in range(rows):
                h = (h ^ regs[:, :, i].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), count))], names=["bucket", "cls"])

    return classes.select("cls", "registers").mapInArrow(run, "bucket long, cls long")


def _regs(column: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose registers leave a chance that they are linked."""
    own = classes.select("cls", "n_shingles", "registers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            if b.num_rows:
                ok = possible(_regs(b["ra"].to_pylist()), _regs(b["rb"].to_pylist()), b["na"].to_numpy(), b["nb"].to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], names=["a", "b"])

    def side(name: str) -> DataFrame:
        return own.select(F.col("cls").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("registers").alias(f"r{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (cls, members) of the classes in wanted (cls, id, text_hash, fingerprint), from the text of one document of each; its id may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cls, members = [], []
            for c, fingerprint, text in zip(*(x.to_pylist() for x in b.columns)):
                s = shingles(text, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == fingerprint:  # else another document with the same id
                    cls.append(c)
                    members.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["cls", "members"])

    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash"), text.alias("text"))
    found = own.join(wanted, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))).select("cls", "fingerprint", "text").mapInArrow(run, "cls long, members array<long>")
    return found.dropDuplicates(["cls"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("cls").alias(c), F.col("members").alias(f"m{c}")) for c in "ab")
    both = F.size(F.array_intersect("ma", "mb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return joined.filter(100 * F.col("both") >= percent * (F.size("ma") + F.size("mb") - F.col("both"))).select("a", "b")


def block_links(members: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Linked pairs (a, b) of members (bucket, size, cls, label) with sets (cls, members) that share a bucket and differ in label, as many as connect what they connect.

    Of two members of different labels one at least is outside the bucket's commonest label. So all
    members are cut into blocks, those outside the commonest label into chunks, and each block meets
    each chunk in one group of at most about two blocks of sets: a member is copied once for each
    chunk, which is once in all if few are outside. A group compares full sets and gives one link
    for each two labels that it joins, however many pairs are linked.
    """
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.max("n").alias("n"))
    common = materialise(common, "labels")  # a table of its own, so that a crowded bucket can be split in the join
    rows = members.join(common, "bucket").withColumns({"blocks": F.ceil(F.col("size") / block).cast("int"), "chunks": F.ceil((F.col("size") - F.col("n")) / block).cast("int")}).filter("chunks > 0")
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cls"), F.col(n)).cast("int")
    own = rows.withColumns({"i": place(1, "blocks"), "j": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "probe": F.lit(False)})
    few = rows.filter("label <> common").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "j": place(2, "chunks"), "probe": F.lit(True)})
    names = ["bucket", "i", "j", "probe", "cls", "label"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, label, probe = pdf["cls"].to_numpy(), pdf["label"].to_numpy(), pdf["probe"].to_numpy()
        few, rest = np.flatnonzero(probe), np.flatnonzero(~probe)
        out: list[tuple[int, int]] = []
        if len(few) and len(rest):
            sets = pdf["members"].tolist()
            n = np.array([len(sets[i]) for i in rest])
            values, ids = np.unique(np.concatenate([sets[i] for i in rest]), return_inverse=True)
            start, mark = np.cumsum(n) - n, np.zeros(len(values), np.int64)
            names, root = np.unique(label, return_inverse=True)
            for x in few:
                own = np.searchsorted(values, sets[x])
                own = own[(own < len(values)) & (values[np.minimum(own, len(values) - 1)] == sets[x])]
                if not (root[rest] != root[x]).any():
                    continue
                mark[own] = 1
                both = np.add.reduceat(mark[ids], start)
                mark[own] = 0
                for y in rest[100 * both >= percent * (n + len(sets[x]) - both)]:
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        out.append((min(cls[x], cls[y]), max(cls[x], cls[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return own.select(names).union(few.select(names)).join(sets, "cls").groupBy("bucket", "i", "j").applyInPandas(meet, "a long, b long")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (node, label) of components (node, label) after further edges (a, b): only the labels that these touch are joined, not all nodes again."""
    ends = more
    for end in "ab":
        of = labels.select(F.col("node").alias(end), F.col("label").alias("known"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    merged = connected_components(ends)
    new = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return old.union(merged.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one for each row of docs.

    Two documents are linked if 100 times the size of the intersection of their sets of word
    shingles is at least percent times that of their union; component_id is the smallest id that a
    document can reach, and kept says that it is its own. A pair at the threshold is missed with a
    chance under 1e-8 by the bands, and under 1e-6 by the estimate. Null and empty texts have no
    shingles and no links. Repeated rows share a component (each with the smallest id is kept, ties
    too); rows with a null id take part and are kept only if no id is in their component. Very long
    texts are compared whole; a group of the last comparison holds the sets of 512 classes at most.
    Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    rows = band_rows(percent)
    known = materialise(sketches(docs, width, id_col, text_col), "sketches")
    classes = known.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = classes.select("fingerprint", "least.id", "least.text_hash", "n_shingles", "registers")
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    every = bands(classes, rows)
    crowded = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialise(every.join(crowded, "bucket"), "bands")

    score = shared.groupBy("cls").agg(F.sum("size").alias("score"))
    scored = shared.join(score, "cls")
    pivot = scored.groupBy("bucket").agg(F.max(F.struct("score", "cls")).alias("p")).select("bucket", F.col("p.cls").alias("pivot"))
    pairs = shared.join(pivot, "bucket").filter("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    pairs = materialise(likely(pairs, classes, percent), "pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialise(full_sets(docs, classes.join(ids, "cls").select("cls", "id", "text_hash", "fingerprint"), width, id_col, text_col), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()

    sets = sets_of(ends(pairs))
    links = materialise(verify(pairs, sets, percent), "links")
    labels = connected_components(links)
    release(docs.sparkSession)

    placed = shared.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    apart = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    left = materialise(placed.join(apart, "bucket"), "left")
    # small buckets pair their members by a join, of at most SMALL / 2 rows for each member
    small = left.filter(F.col("size") <= SMALL).select("bucket", "cls", "label")
    again = small.select("bucket", F.col("cls").alias("b"), F.col("label").alias("other"))
    near = small.withColumnRenamed("cls", "a").join(again, "bucket").filter("a < b and label <> other").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    near = materialise(likely(near, classes, percent), "pairs")
    far = left.filter(F.col("size") > SMALL)
    missing = ends(near).union(far.select("cls")).distinct().join(sets.select("cls"), "cls", "left_anti")
    sets = sets.union(sets_of(missing))
    found = materialise(verify(near, sets, percent).union(block_links(far, sets, percent)).distinct(), "links")
    if not found.isEmpty():
        labels = joined(labels, found)

    owner = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("fingerprint", "id", F.coalesce("label", "cls").alias("label"))
    # a table of its own, so that the classes of a very large component can be split in the join
    least = materialise(owner.groupBy("label").agg(F.min("id").alias("component_id")), "components")
    owner = owner.join(least, "label").select("fingerprint", "component_id")
    out = known.join(owner, "fingerprint", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("fingerprint").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
