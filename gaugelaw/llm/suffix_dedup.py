"""Exact removal of repeated byte strings with a distributed difference-cover suffix array.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Two reductions,
both exact, come before the suffix array, so that it runs over the few strings whose repetition is
still open, and they are short:

1. Anchors. Of the grams (a quarter as long as the string) in a string, the one with the least hash is
   its anchor, so equal strings have equal anchors at equal offsets, as a difference cover gives
   two suffixes a common sampled offset. An anchor stands for a run of string starts. Runs whose anchor
   gram occurs once cannot repeat; runs that occur twice as a whole repeat as a whole.
2. Cells. In the runs left, eight neighbouring starts share a core. A core that occurs once
   cannot repeat, and a cell that occurs twice as a whole repeats as a whole. Each other cell is
   a string of fifteen symbols: seven bytes, the core's name, seven bytes.

The suffix array of these strings (difference cover modulo 3: sort sampled triples, recurse on
names, merge the remaining suffixes, compare adjacent prefixes of eight symbols) decides the rest.
Texts are identified by two 64-bit hashes; equal texts have equal results.

The symbols of a string are bytes or, for passages of a number of words, the hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, materialise, release, slices, text_or_empty, word_hashes
from .suffix_array import equal_prefixes

CELL = 8
#: Starts of strings in a piece of a long text: what a task holds of one text at a time.
PIECE = 1 << 20
#: Neighbouring symbols in each summand of a hash, by the symbols' width.
REACH = {1: 8, 8: 2}
MULTIPLIER = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers, and those of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, m in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 2**64))):
            step = np.full(2 * n, m, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_symbols(data: bytes) -> bytes:
    """The hashes of a text's words (what stands between ASCII white space), eight bytes for each."""
    return word_hashes(data.split()).astype("<u8").tobytes()


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte behind it."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def few_words(at: np.ndarray, length: int, words: int, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Which strings of length bytes that start at these places have under `words` words with white space on both sides."""
    return np.searchsorted(behind, at + length) - np.searchsorted(first, at, "right") < words


def has_few_words(data: bytes, length: int, words: int) -> bool:
    """Whether any string of length bytes has: a string has fewest where it begins, or where it loses a word's first byte."""
    first, behind = word_places(data)
    at = np.concatenate(([0], first))
    return bool(few_words(at[at <= len(data) - length], length, words, first, behind).any())


class Hashes:
    """Hashes of any substring of a text's symbols, of width bytes each (1: bytes, 8: words).

    Sums of powers modulo 2 ** 64 alone meet in strings that are built by doubling (of two symbols,
    1,024 long). So what is summed are not symbols but mixed hashes of REACH neighbouring symbols, which
    no doubling keeps apart from their surroundings. Substrings under REACH symbols are no input.
    """

    def __init__(self, data: bytes, width: int = 1):
        if width == 8:
            raw = np.frombuffer(data, "<u8").astype(np.uint64)
            raw = np.concatenate((raw[:-1] * np.uint64(MULTIPLIER) + (raw[1:] >> np.uint64(1)), np.zeros(0, np.uint64)))
        else:
            raw = _windows(np.frombuffer(data, np.uint8), REACH[1]).copy().view("<u8").ravel()
        self.reach = REACH[width]
        up, self.down = powers(len(raw) + self.reach + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(raw + np.uint64(MULTIPLIER)) * up[: len(raw)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end - self.reach + 1] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Of the n symbols from each place on."""
        far = self.sums[n - self.reach + 1 :]
        return mixed((far - self.sums[: len(far)]) * self.down[: len(far)] + np.uint64(n))


def _windows(raw: np.ndarray, n: int) -> np.ndarray:
    """The n values from each place on."""
    return np.lib.stride_tricks.sliding_window_view(raw, n) if len(raw) >= n else np.zeros((0, n), raw.dtype)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the place of the leftmost least one, by the values' upper 40 bits; for up to 2 ** 24 values."""
    n = len(h)
    low = np.uint64(2**24 - 1)
    v = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    v[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    v = v.reshape(-1, width)
    ahead = np.minimum.accumulate(v, 1).ravel()  # from the block's begin to a place, and from a place to the block's end
    behind = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def gram_size(length: int, width: int) -> int:
    """A quarter of the string: long enough to be rare, and short enough that one anchor stands for most starts of a string's length."""
    return max(REACH[width], length // 4)


def anchors(data: bytes, length: int, width: int = 1) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, anchor place, least and most offset of the place from a string start) for each anchor of a text, cut in pieces of PIECE starts."""
    size, gram = len(data) // width, gram_size(length, width)
    out = []
    for base in range(0, size - length + 1, PIECE):
        hashes = Hashes(data[base * width : (base + PIECE + length - 1) * width], width)
        h = hashes.grams(gram)
        place = least_in_windows(h, length - gram + 1)[: min(PIECE, size - length + 1 - base)]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        p = place[first]
        low, high = p - last, p - first
        whole = mixed(hashes.of(first, last + length) + low.astype(np.uint64) * np.uint64(1 << 20) + high.astype(np.uint64))
        out.append((h[p], whole, p + base, low, high))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def _anchor_rows(texts: DataFrame, length: int, width: int, words: int | None) -> DataFrame:
    """Rows (gram, run, h1, h2, place, low, high): a run's hash covers every string of it, and its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list[np.ndarray]] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                data = text.encode()
                if words and not has_few_words(data, length, words):
                    continue
                g, whole, p, low, high = anchors(word_symbols(data) if width == 8 else data, length, width)
                out.append([g, whole, np.full(len(p), i), p, low, high])
            if out:
                g, r, i, p, low, high = (np.concatenate(x) for x in zip(*out))
                owner = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), b.column(0).take(owner), b.column(1).take(owner), *(pa.array(x.astype(np.int32)) for x in (p, low, high))],
                    names=["gram", "run", "h1", "h2", "place", "low", "high"],
                )

    return texts.mapInArrow(run, "gram long, run long, h1 long, h2 long, place int, low int, high int")


def _cut(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The binary strings symbols[first : end], of CELL - 1 rows of symbols at most, as an Arrow column."""
    n = CELL - 1
    at = first[:, None] + np.arange(n)
    inside = at < end[:, None]
    flat = symbols[at[inside]].reshape(-1)
    ends = np.cumsum(inside.sum(1) * symbols.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _cell_rows(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Rows (core, left, right, n, ref, cell) of the runs (ref, n, gram, place, low, high) listed with each text."""

    def cells(data: bytes, runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of runs, rows of (ref, n, gram, place, low, high), by place and a piece of the text at a time."""
        size = len(data) // width
        runs = runs[np.argsort(runs[:, 3], kind="stable")]
        while len(runs):
            base = max(0, int((runs[:, 3] - runs[:, 5]).min()) - 2 * CELL) if len(runs) and size > PIECE else 0
            some = runs[: max(1, int(np.searchsorted(runs[:, 3], base + PIECE)))]
            runs = runs[len(some) :]
            stop = min(size, int((some[:, 3] - some[:, 4]).max()) + length + 2 * CELL)
            piece = data[base * width : stop * width]
            hashes, symbols = Hashes(piece, width), np.frombuffer(piece, np.uint8).reshape(-1, width)
            ref, n, gram, place, low, high = some.T
            each = high // CELL - low // CELL + 1
            r = np.repeat(np.arange(len(some)), each)
            cell = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) + (low // CELL)[r]
            q = place[r] - CELL * cell - base
            end = q - (CELL - 1) + length
            core = mixed(hashes.of(q, end) ^ gram[r].view(np.uint64) ^ (cell.astype(np.uint64) << np.uint64(40)))
            left, right = _cut(symbols, np.maximum(0, q - CELL + 1), q), _cut(symbols, end, np.minimum(end + CELL - 1, len(symbols)))
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), left, right, pa.array(n[r]), pa.array(ref[r]), pa.array(cell.astype(np.int32))], names=["core", "left", "right", "n", "ref", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs = b.column(1)
            flat = np.stack([runs.flatten().field(i).to_numpy() for i in range(6)], 1).astype(np.int64)
            edges = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            made: list[pa.RecordBatch] = []
            for i, text in enumerate(b.column(0).to_pylist()):
                made += cells(word_symbols(text.encode()) if width == 8 else text.encode(), flat[edges[i] : edges[i + 1]])
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return texts.mapInArrow(run, "core long, left binary, right binary, n long, ref long, cell int")


def _open_strings(strings: DataFrame, width: int) -> DataFrame:
    """Rows (sid, back) of the strings (sid, name, left, right): the string that starts back bytes before the core also starts elsewhere."""

    def symbols(data: bytes) -> list[int]:
        return [x + 1 for x in data] if width == 1 else [(x >> 2) + 1 for x in np.frombuffer(data, "<u8").tolist()]

    above = 257 if width == 1 else 2**62 + 1  # names are larger than the other symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            sid, syms = b.column(0), []
            starts: list[tuple] = []
            for i, name, left, right in zip(*(c.to_pylist() for c in b.columns)):
                syms.append([*symbols(left), above + name, *symbols(right)])
                before, behind = len(left) // width, len(right) // width
                for back in range(min(before, CELL - 1) + 1):
                    if behind >= CELL - 1 - back:
                        window = left[len(left) - back * width :] + right[: (CELL - 1 - back) * width]
                        starts.append((before - back, bytes([back]) + name.to_bytes(8, "big") + window))
                    else:
                        starts.append((-1, b""))
                starts += [(-1, b"")] * (CELL - 1 - min(before, CELL - 1))
            where = pa.array([[s[0] for s in starts[k : k + CELL]] for k in range(0, len(starts), CELL)], pa.list_(pa.int32()))
            prefix = pa.array([[s[1] for s in starts[k : k + CELL]] for k in range(0, len(starts), CELL)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([sid, pa.array(syms, pa.list_(pa.int64())), where, prefix], names=["sid", "syms", "at", "prefix"])

    made = materialise(strings.select("sid", "name", "left", "right").mapInArrow(run, "sid long, syms array<long>, at array<int>, prefix array<binary>"), "strings")
    starts = made.select("sid", F.explode(F.arrays_zip("at", "prefix")).alias("s")).select("sid", F.col("s.at").alias("pos"), "s.prefix").filter("pos >= 0")
    found = equal_prefixes(made.select("sid", "syms"), starts)
    return found.join(strings.select("sid", (F.length("left") / width).cast("int").alias("size")), "sid").select("sid", (F.col("size") - F.col("pos")).alias("back"))


def repeated_starts(docs: DataFrame, length: int, text_col: str, width: int = 1, words: int | None = None) -> DataFrame:
    """Rows (h1, h2, first, last): runs of places where a repeated string starts, in the texts with these hashes.

    Lengths and places count symbols: bytes (width 1) or words (width 8). With words, only texts
    that have a string of length bytes with fewer words are read.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    texts = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.alias("text")).filter(F.octet_length("text") >= (length if width == 1 else 2 * length - 1))
    every = materialise(_anchor_rows(texts, length, width, words), "anchors")
    # a table of its own, so that a gram with very many anchors can be split in the join
    often = materialise(every.groupBy("gram").agg(F.count(F.lit(1)).alias("grams"), (F.min("run") < F.max("run")).alias("several")).filter("grams > 1").select("gram", "several"), "grams")
    found = materialise(every.join(often, "gram"), "anchors")
    drop_table(every)
    release(spark)
    runs = found.groupBy("gram", "run", "several").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2", "place", "low", "high")).alias("r"))
    runs = materialise(runs.select("gram", "run", "several", "n", "r.*").withColumn("ref", F.monotonically_increasing_id()), "runs")
    twice = runs.filter("n > 1").select("gram", "run")
    whole = found.join(twice, ["gram", "run"]).select("h1", "h2", (F.col("place") - F.col("high")).alias("first"), (F.col("place") - F.col("low")).alias("last"))

    open_runs = runs.filter("several")
    listed = open_runs.groupBy("h1", "h2").agg(F.collect_list(F.struct("ref", "n", "gram", F.col("place").cast("long").alias("place"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))).alias("runs"))
    # one copy of each text, combined before the shuffle
    single = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    cells = materialise(_cell_rows(single.join(listed, ["h1", "h2"]).select("text", "runs"), length, width), "cells")
    release(spark)

    strings = cells.groupBy("core", "left", "right").agg(F.sum("n").alias("m"))
    strings = materialise(strings.withColumn("sid", F.monotonically_increasing_id()), "strings")
    cores = strings.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).filter("k > 1 and least = 1")
    named = materialise(cores.select("core").withColumn("name", F.monotonically_increasing_id()), "cores")
    asked = materialise(strings.join(named, "core").select("sid", "name", "left", "right"), "asked")
    parts = [strings.filter("m > 1").select("sid", F.lit(2**CELL - 1).alias("mask"))]
    if not asked.isEmpty():
        parts.append(_open_strings(asked, width).groupBy("sid").agg(F.bit_or(F.expr("shiftleft(1, back)")).alias("mask")))
    masks = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    masks = strings.join(masks.groupBy("sid").agg(F.bit_or("mask").alias("mask")), "sid").select("core", "left", "right", "mask")
    hit = cells.filter("n = 1").join(masks, ["core", "left", "right"]).select("ref", "cell", "mask")
    at = hit.join(open_runs.filter("n = 1").select("ref", "h1", "h2", "place", "low", "high"), "ref")
    at = at.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(CELL - 1)))).filter("(shiftright(mask, back) & 1) = 1")
    at = at.withColumn("offset", F.col("cell") * CELL + F.col("back")).filter("offset between low and high")
    some = at.groupBy("h1", "h2", "place", "cell").agg(F.collect_list("offset").alias("o")).select("h1", "h2", F.explode(F.expr("transform(o, x -> place - x)")).alias("first")).withColumn("last", F.col("first"))
    out = materialise(whole.union(some), "starts")
    release(spark)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False, words: int | None = None) -> DataFrame:
    """Rows (id_col, keep..., n_bytes, n_removed, n_spans, spans, kept), one for each row of docs.

    spans: removed byte ranges (start, end), as long as possible; kept: the other bytes in order,
    which may cut a character (as_text: a string without what is left of characters that were cut). A null text counts as empty; texts under length bytes lose nothing;
    each of two equal texts of at least length bytes loses everything; repeated rows count as copies.
    length is 16 at least. Very long texts are hashed in pieces of PIECE bytes; the text itself and its spans are held whole.
    words: strings of so many words go too, from the first byte of the first word to the last one
    of the last word, whatever white space lies between them; strings of length bytes that have so
    many words inside are left to this rule, which cuts no word. Null ids stay; an empty table
    gives no rows; columns not in keep are left out.
    """
    if length < 16 or words is not None and words < 4:
        raise ValueError("length has to be 16 at least, words 4")
    columns = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    starts = repeated_starts(docs, length, text_col, words=words).withColumn("by_words", F.lit(False))
    if words:
        starts = starts.union(repeated_starts(docs, words, text_col, width=8).withColumn("by_words", F.lit(True)))
    starts = starts.groupBy("h1", "h2").agg(F.collect_set(F.struct("first", "last", "by_words")).alias("starts"))
    text = text_or_empty(text_col)
    rows = docs.select(*columns, text.alias("__text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")).join(starts, ["h1", "h2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in slices(batches):
            out: list[tuple] = []
            for text, found in zip(b["__text"].to_pylist(), b["starts"].to_pylist()):
                data, spans = text.encode(), []
                begin, behind = word_places(data) if words and found else (None, None)
                ranges = []
                for s in found or ():
                    if s["by_words"]:
                        ranges.append((int(begin[s["first"]]), int(behind[s["last"] + words - 1])))
                    elif words:
                        at = np.arange(s["first"], s["last"] + 1)
                        ranges += [(i, i + length) for i in at[few_words(at, length, words, begin, behind)].tolist()]
                    else:
                        ranges.append((s["first"], s["last"] + length))
                for first, end in sorted(ranges):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([first, end])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(spans), [{"start": a, "end": z} for a, z in spans], kept.decode("utf-8", "ignore") if as_text else kept))
            n, removed, k, spans, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in columns), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(k, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return rows.select(*columns, "__text", "starts").mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}")
