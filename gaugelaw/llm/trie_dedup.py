"""Exact deduplication by owners that hold whole texts in Patricia tries.

A text's key is its length, a 64-bit hash and all its bytes. Each task first puts its own texts into
a trie, so that of a text with very many copies it sends one row on. Length and hash then deal the
texts out to owners, whose tries keep, at the end of each key, the identifier that stays and the
number of rows. A trie over its bound gives up its largest subtree: on the sending side as rows
of its own, on the owner's side to a table in the shared folder whose rows the owners of the next
round take. Documents meet the owners' rows by length and hash; where two texts share these (the
owners see it, as they compare all bytes), by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, text_or_empty, text_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of length and hash before the text.
HEAD = 16
#: About the memory of a node besides its label.
NODE = 300
LABEL, CHILDREN, BEST, COUNT, SIZE = range(5)
GONE = -1  # the count of a node whose subtree has been given up


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a shares with b from `at` on; a is longer than that."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[at + low : at + half]:
            low = half
        else:
            high = half - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings; where one ends, the identifier that stays and the number of rows."""

    def __init__(self, better: Callable):
        self.better = better
        self.root = [b"", {}, None, 0, 0]

    @property
    def size(self) -> int:
        return self.root[SIZE]

    def insert(self, key: bytes, best: object, count: int) -> bool:
        """False if key lies in a subtree that has been given up."""
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node[CHILDREN].get(key[at])
            if child is None:
                added = len(key) - at + NODE
                node[CHILDREN][key[at]] = [key[at:], {}, best, count, added]
                for n in path:
                    n[SIZE] += added
                return True
            label = child[LABEL]
            if not key.startswith(label, at):
                n = common_prefix(label, key, at)
                upper = [label[:n], {label[n]: child}, None, 0, child[SIZE] + NODE]
                child[LABEL] = label[n:]
                child[SIZE] -= n
                node[CHILDREN][key[at]] = upper
                for x in path:
                    x[SIZE] += NODE
                child, label = upper, upper[LABEL]
            elif child[COUNT] == GONE:
                return False
            node, at = child, at + len(label)
            path.append(node)
        node[BEST] = self.better(node[BEST], best) if node[COUNT] else best
        node[COUNT] += count
        return True

    def walk(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        """Strings with what their ends hold, in order."""
        stack = [(self.root if node is None else node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node[LABEL]
            if node[COUNT] > 0:
                yield key, node[BEST], node[COUNT]
            stack += [(node[CHILDREN][c], key) for c in sorted(node[CHILDREN], reverse=True)]

    def give_up(self, forget: bool = False) -> tuple[bytes, Iterator[tuple[bytes, object, int]]] | None:
        """The path above the largest subtree below the first branching, and its strings; it leaves the trie. None if nothing branches.

        Later strings of it are refused; above the text, so are all with its length and hash. With forget its place is free again.
        """
        node, path, prefix = self.root, [self.root], b""
        while len(live := [c for c in node[CHILDREN].values() if c[COUNT] != GONE]) == 1 and not node[COUNT] > 0:
            node = live[0]
            prefix += node[LABEL]
            path.append(node)
        if not live:
            return None
        child = max(live, key=lambda c: c[SIZE])
        label = child[LABEL][: max(1, HEAD - len(prefix))] if len(prefix) < HEAD else child[LABEL]
        left = 0 if forget else len(label) + NODE
        for n in path:
            n[SIZE] -= child[SIZE] - left
        if forget:
            del node[CHILDREN][label[0]]
        else:
            node[CHILDREN][label[0]] = [label, {}, None, GONE, left]
        return prefix, self.walk(child, prefix)


def larger(a: object, b: object) -> object:
    return b if a is None else a if b is None else max(a, b)


def smaller(a: object, b: object) -> object:
    return b if a is None else a if b is None else min(a, b)


def _pieces(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a few MB; text: the place of a value that may be long."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text] or b"") + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _head(n: int, h: int) -> bytes:
    return n.to_bytes(8, "big") + (h & (2**64 - 1)).to_bytes(8, "big")


def _unhead(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "big"), int.from_bytes(key[8:HEAD], "big", signed=True)


def _grouped(texts: DataFrame, kind: str, better: Callable, most: int) -> DataFrame:
    """Rows (n_bytes, hash, text, best, copies) of (id, n_bytes, hash, text): each task's own copies are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def rows() -> Iterator[tuple]:
            nonlocal kinds
            trie = PatriciaTrie(better)
            out = lambda found: ((*_unhead(k), k[HEAD:], best, count) for k, best, count in found)
            for b in text_slices(batches, 3):
                kinds = [pa.int64(), pa.int64(), pa.binary(), b.column(0).type, pa.int64()]
                for i, n, h, text in zip(*(c.to_pylist() for c in b.columns)):
                    trie.insert(_head(n, h) + text, i, 1)
                    while trie.size > most and (found := trie.give_up(forget=True)):
                        yield from out(found[1])
            yield from out(trie.walk())

        held = rows()
        for first in held:  # the kinds are known once a row is there
            yield from _pieces(chain((first,), held), kinds, ["n_bytes", "hash", "text", "best", "copies"], 2)

    return texts.mapInArrow(run, f"n_bytes long, hash long, text binary, best {kind}, copies long")


def _owned(rows: DataFrame, kind: str, better: Callable, most: int) -> DataFrame:
    """Rows of one task are all that there are of their lengths and hashes: (n_bytes, hash, text, best, copies, shared, later).

    shared: other texts have this length and hash. later: the row left its trie and waits for the next
    round. Only rows with either of these carry their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def rows() -> Iterator[tuple]:
            nonlocal kinds
            trie, torn = PatriciaTrie(better), set()  # torn: lengths and hashes whose texts are not all in one trie

            def later(key: bytes, best: object, count: int) -> tuple:
                return *_unhead(key), key[HEAD:], best, count, key[:HEAD] in torn, True

            for b in text_slices(batches, 2):
                kinds = [pa.int64(), pa.int64(), pa.binary(), b.column(3).type, pa.int64(), pa.bool_(), pa.bool_()]
                for n, h, text, best, count, shared in zip(*(c.to_pylist() for c in b.columns)):
                    head = _head(n, h)
                    if shared:
                        torn.add(head)
                    if not trie.insert(head + text, best, count):
                        yield later(head + text, best, count)
                    while trie.size > most and (found := trie.give_up()):
                        above, left = found
                        if len(above) >= HEAD:
                            torn.add(above[:HEAD])
                        yield from (later(*x) for x in left)
            for head, same in groupby(trie.walk(), key=lambda x: x[0][:HEAD]):
                first, second = next(same), next(same, None)
                shared = second is not None or head in torn
                for key, best, count in chain((first,), (second,) if second else (), same):
                    yield *_unhead(head), key[HEAD:] if shared else None, best, count, shared, False

        held = rows()
        for first in held:
            yield from _pieces(chain((first,), held), kinds, ["n_bytes", "hash", "text", "best", "copies", "shared", "later"], 2)

    return rows.mapInArrow(run, f"n_bytes long, hash long, text binary, best {kind}, copies long, shared boolean, later boolean")


def owners(texts: DataFrame, keep: str = "smallest", most: int = 64_000_000) -> DataFrame:
    """Rows (n_bytes, hash, text, best, copies, shared) of the distinct texts of (id, n_bytes, hash, text binary); text only where shared."""
    kind, better = texts.dtypes[0][1], {"smallest": smaller, "largest": larger}[keep]
    rows, found, rounds = _grouped(texts, kind, better, most // 2).withColumn("shared", F.lit(False)), None, 0
    deal = rows.repartition("n_bytes", "hash")
    while True:
        done = materialise(_owned(deal, kind, better, most), "owners")
        here = done.filter(~F.col("later")).drop("later")
        found = here if found is None else found.unionByName(here)
        rest = done.filter("later").drop("later")
        if rest.isEmpty():
            return found
        rounds += 1
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2**rounds
        # texts of one length and hash meet in one task however many there are: no more tasks than what is left can fill to a quarter
        held = rest.agg(F.sum(F.col("n_bytes") + HEAD + NODE)).first()[0]
        deal = rest.repartition(min(parts, 4 * (held // most + 1)), F.xxhash64(F.lit(rounds), "n_bytes", "hash"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", ignore_case: bool = True,
    most: int = 64_000_000, content_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """Rows (id_col, keep_id, group_size, kept, n_bytes, text_sha256), one for each input row.

    Texts are equal when all their bytes are, after lower-casing A-Z if ignore_case. keep names the row of
    a group that stays: with the smallest or the largest id. A null text counts as empty, and all empty texts
    are one group. A null id never stays where another is; a group of null ids alone has a null keep_id and
    none kept. Repeated rows count as often as they are there; those with the id that stays (ties) are all
    kept. Very long texts are compared whole; other columns, whatever their names, are not read; an empty
    table gives an empty one. most bounds the bytes that a trie holds; content_hash need not be a good one.
    """
    text = text_or_empty(text_col)
    text = F.translate(text, UPPER, LOWER) if ignore_case else text
    key = [F.octet_length(text).cast("long").alias("n_bytes"), content_hash(text).cast("long").alias("hash")]
    found = owners(docs.select(F.col(id_col).alias("id"), *key, text.cast("binary").alias("text")), keep, most)
    rows = docs.select(F.col(id_col).alias("id"), *key, F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    met = rows.join(found.filter(~F.col("shared")).select("n_bytes", "hash", "best", "copies"), ["n_bytes", "hash"])
    shared = found.filter("shared")
    if not shared.isEmpty():
        whole = docs.select(F.col(id_col).alias("id"), *key, F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.cast("binary").alias("text"))
        met = met.unionByName(whole.join(shared.drop("shared"), ["n_bytes", "hash", "text"]).drop("text"))
    kept = F.coalesce(F.col("id") == F.col("best"), F.lit(False))
    return met.select(F.col("id").alias(id_col), F.col("best").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), "n_bytes", "text_sha256")
