"""Alignment of two tokenizations of the same bytes by lockstep merging.

The tokens of one Arrow batch lie end to end in two arrays of byte ends, where both tokenizations of all documents
share offsets. Each lane has a pointer into either array; one step advances the pointers of
all lanes at once (that with the smaller end, both where they meet), cuts a group where the ends
are equal and drops lanes that are done. A long document is several lanes, which start at
cuts found by probing. A group's links are all pairs of its A and B tokens.

In how many documents a pair of ids is linked is counted over the corpus. Pairs that are frequent (at most `frequent` of
them, as each takes its share of all pairs) go to every task; the others, none of them hot, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, text_slices

#: How the byte-level pre-tokenizer splits a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens within texts are plain text.

    If the file's merges are in the order of their ids and it only pre-tokenizes, tiktoken encodes by its ranks, several times as fast.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.loads(self.library.to_str())
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        first = sum(len(t) == 1 for t in vocabulary)
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.fast = None
        if plain and first == 256 and made == list(range(first, first + len(made))):
            import tiktoken

            self.fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each)."""
        if self.fast:
            ids = [self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64), np.array([len(x) for x in ids], np.int64)


class Pieces:
    """A sentencepiece model, which puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) or lib.is_unknown(i) else piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library.encode(texts, num_threads=1)
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


class Groups(NamedTuple):
    """Groups in order: the first A and B token of each and the ones after its last."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first A token, first B token, A token after the last) of each lane: documents, those of over `length` A tokens in parts that start at cuts."""
    stops = np.append(starts_a[1:], len(ends_a))
    extra = (stops - starts_a - 1) // length
    if not extra.any():
        return starts_a, starts_b, stops
    document = np.repeat(np.arange(len(starts_a)), extra)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(extra) - extra, extra)
    at = starts_a[document] + (nth + 1) * length - 1  # a token that may end where a B token does
    last = np.minimum(starts_a[document] + (nth + 2) * length - 1, stops[document]) - 1
    open_ = np.arange(len(at))
    found = np.full(len(at), -1)
    while len(open_):
        place = np.searchsorted(ends_b, ends_a[at[open_]])
        hit = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[at[open_]]
        found[open_[hit]] = place[hit]
        open_ = open_[~hit]
        at[open_] += 1
        open_ = open_[at[open_] < last[open_]]
    good = found >= 0
    good[good] = at[good] + 1 < stops[document[good]]
    a, b = np.append(starts_a, at[good] + 1), np.append(starts_b, found[good] + 1)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return a, b, np.append(a[1:], len(ends_a))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stops: np.ndarray) -> Groups:
    """Advance all lanes at once; every step emits the groups that it closes."""
    i, j, stop = first_a.copy(), first_b.copy(), stops
    group_a, group_b = first_a.copy(), first_b.copy()
    emitted: list[tuple[np.ndarray, ...]] = []
    while len(i):
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        i, j = i + (a <= b), j + (b <= a)
        if cut.any():
            emitted.append((group_a[cut], i[cut], group_b[cut], j[cut]))
            group_a, group_b = np.where(cut, i, group_a), np.where(cut, j, group_b)
            live = i < stop
            if not live.all():
                i, j, stop, group_a, group_b = i[live], j[live], stop[live], group_a[live], group_b[live]
    if not emitted:
        return Groups(*(np.zeros(0, np.int64),) * 4)
    columns = [np.concatenate(c) for c in zip(*emitted)]
    order = np.argsort(columns[0])
    return Groups(*(c[order] for c in columns))


class Aligned(NamedTuple):
    """For each text: numbers of tokens, groups and links, the digest, and its distinct linked pairs (a * size of B's vocabulary + b) with their links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    offsets: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


class Aligner:
    def __init__(self, byte_path: str, piece_path: str, lane: int = 256):
        self.a, self.b, self.lane = ByteLevel(byte_path), Pieces(piece_path), lane
        self.size_a, self.size_b = np.array([len(x) for x in self.a.bytes], np.int64), np.array([len(x) for x in self.b.bytes], np.int64)
        most = max(len(self.size_a), len(self.size_b))
        width = len(str(most))
        self.digits, self.width = np.zeros((most, width + 1), np.uint8), np.array([len(str(i)) for i in range(most)])
        for i in range(most):
            self.digits[i, : self.width[i]] = list(str(i).encode())

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A counts, B ids, B counts); texts without tokens have counts of 0."""
        some = [k for k, t in enumerate(texts) if t]
        raw = [" " + texts[k] for k in some]
        ids_a, n_a = self.a.encode(raw)
        ids_b, n_b = self.b.encode([texts[k] for k in some])
        whole = "".join(raw).encode()
        # with a token for every byte and nothing that normalises, A cannot lose any
        joined_a = whole if self.a.fast else b"".join(map(self.a.bytes.__getitem__, ids_a.tolist()))
        joined_b = b"".join(map(self.b.bytes.__getitem__, ids_b.tolist()))
        size = np.array([len(r.encode()) for r in raw], np.int64)
        total_a, total_b = _sums(self.size_a[ids_a], n_a), _sums(self.size_b[ids_b], n_b)
        same = (total_a == size) & (total_b == size)
        if not (same.all() and joined_a == whole and joined_b == whole):
            starts = [np.append(0, np.cumsum(t)) for t in (size, total_a, total_b)]
            for k in range(len(some)):
                text = whole[starts[0][k] : starts[0][k + 1]]
                same[k] = text == joined_a[starts[1][k] : starts[1][k + 1]] and text == joined_b[starts[2][k] : starts[2][k + 1]]
            ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        counts_a, counts_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        counts_a[some], counts_b[some] = n_a * same, n_b * same
        return ids_a, counts_a, ids_b, counts_b

    def batch(self, texts: list[str | None]) -> Aligned:
        ids_a, n_a, ids_b, n_b = self.tokens(texts)
        live = np.flatnonzero(n_a)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        starts_a, starts_b = (np.cumsum(n_a) - n_a)[live], (np.cumsum(n_b) - n_b)[live]
        groups = lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, starts_a, starts_b, self.lane)) if len(live) else lockstep(*(np.zeros(0, np.int64),) * 5)
        bounds = np.append(np.searchsorted(groups.a, np.cumsum(n_a) - n_a), len(groups.a))
        n_groups = np.diff(bounds)
        n_links = _sums((groups.a_end - groups.a) * (groups.b_end - groups.b), n_groups)
        offsets, pairs, links = self._pairs(ids_a, ids_b, groups, n_groups)
        return Aligned(n_a, n_b, n_groups, n_links, self._digests(ids_a, ids_b, groups, n_a + n_b), offsets, pairs, links)

    def _pairs(self, ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, n_groups: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text with their links, texts in order; links are made a few million at a time."""
        wide_a, wide_b = groups.a_end - groups.a, groups.b_end - groups.b
        size, vocabulary = wide_a * wide_b, len(self.b.bytes)
        whole = len(self.a.bytes) * vocabulary
        text = np.repeat(np.arange(len(n_groups)), n_groups)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        ends, at = np.cumsum(size), 0
        while at < len(size):
            if size[at] > most:  # one group of very many links: equal ids are counted, one A id at a time
                (a, count_a), (b, count_b) = (np.unique(x, return_counts=True) for x in (ids_a[groups.a[at] : groups.a_end[at]], ids_b[groups.b[at] : groups.b_end[at]]))
                parts += [(text[at] * whole + x * vocabulary + b, n * count_b) for x, n in zip(a.tolist(), count_a.tolist())]
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            g = np.repeat(np.arange(at, stop), size[at:stop])
            k = np.arange(len(g)) - np.repeat(np.cumsum(size[at:stop]) - size[at:stop], size[at:stop])
            a, b = groups.a[g] + k // wide_b[g], groups.b[g] + k % wide_b[g]
            parts.append(np.unique(text[g] * whole + ids_a[a] * vocabulary + ids_b[b], return_counts=True))
            at = stop
        if not parts:
            return np.zeros(len(n_groups) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            keys, back = np.unique(keys, return_inverse=True)
            summed = np.zeros(len(keys), np.int64)
            np.add.at(summed, back, counts)
            counts = summed
        return np.searchsorted(keys, np.arange(len(n_groups) + 1) * whole), keys % whole, counts

    def _digests(self, ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, tokens: np.ndarray) -> list[str]:
        """SHA-256 of a1,a2|b1;a3|b2,b3 for each text; empty without tokens."""
        wide_a, wide_b = groups.a_end - groups.a, groups.b_end - groups.b
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[np.arange(len(ids_a)) + np.repeat(groups.b, wide_a)] = ids_a
        ids[np.arange(len(ids_b)) + np.repeat(groups.a_end, wide_b)] = ids_b
        mark[groups.a_end - 1 + groups.b] = ord("|")
        mark[groups.b_end - 1 + groups.a_end] = ord(";")
        width = self.width[ids]
        digits = self.digits[ids]
        digits[np.arange(len(ids)), width] = mark
        flat = digits[np.arange(digits.shape[1]) <= width[:, None]].tobytes()
        ends = np.append(0, np.cumsum(width + 1))[np.append(0, np.cumsum(tokens))]
        return [hashlib.sha256(flat[a : z - 1]).hexdigest() if z > a else "" for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `counts` values."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    key = (byte_path, piece_path)
    return _aligners.get(key) or _aligners.setdefault(key, Aligner(*key))


def linked(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs array<long>, links array<int>); row numbers the rows, once written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        for b in text_slices(batches, 2, 1024, 2_000_000):
            x = aligner.batch(b.column(2).to_pylist())
            offsets = pa.array(x.offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(x.links, pa.int64()))]
            numbers = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.array(x.digests, pa.string()), *lists], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(aligned: DataFrame, vocabulary_b: int) -> DataFrame:
    """Rows (pair, n, best), written: in how many rows a pair is linked, and whether that is the most of its A id (all, where several are)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(vocabulary_b)))  # a window has one row for each B id at most
    return materialise(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)), "pairs")


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 500_000) -> DataFrame:
    """Rows (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each input row.

    byte_path is a byte-level file of the tokenizers library, piece_path a sentencepiece model, both on every
    executor. Texts that are null or empty, or that a tokenization does not give back byte by byte (such as those that
    contain the space mark), have zeros and an empty digest. Of B ids with equal counts (ties) all are best.
    Repeated rows and ids count as documents of their own; null ids are kept. Very long texts are encoded whole and
    advance in several lanes; other columns, whatever their names, are not read; an empty table gives an empty one.
    `frequent` bounds the pairs that are sent to every task.
    """
    vocabulary_b = len(Pieces(piece_path).bytes)
    aligned = materialise(linked(docs, byte_path, piece_path, id_col, text_col), "aligned")
    counts = pair_counts(aligned, vocabulary_b)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // frequent + 1  # at most `frequent` pairs have that many of `total`
    common = counts.filter(F.col("n") >= least).toPandas().sort_values("pair")
    table = (common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(bool))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                flat, links = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
                sizes = np.diff(part.column(1).offsets.to_numpy())
                place = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
                hit = pairs[place] == flat if len(pairs) else np.zeros(len(flat), bool)
                seen = np.where(hit, links, 0)
                sums = [_sums(seen * best[place], sizes), _sums(seen * n[place], sizes)] if len(pairs) else [np.zeros(len(sizes), np.int64)] * 2
                offsets = pa.array(np.append(0, np.cumsum(_sums(~hit, sizes))), pa.int32())
                rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit], pa.int64())) for v in (flat, links)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s, pa.int64()) for s in sums), *rest], names=["row", "n_best", "count_sum", "pairs", "links"])

    looked = materialise(aligned.select("row", "pairs", "links").mapInArrow(look, "row long, n_best long, count_sum long, pairs array<long>, links array<long>"), "looked")
    rare = looked.select("row", F.inline(F.arrays_zip("pairs", "links"))).join(counts.filter(F.col("n") < least), F.col("pairs") == F.col("pair"))
    of_rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best"), F.sum(F.col("links") * F.col("n")).alias("rare_sum"))
    numbers = aligned.drop("pairs", "links").join(looked.drop("pairs", "links"), "row").join(of_rare, "row", "left")
    return numbers.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
