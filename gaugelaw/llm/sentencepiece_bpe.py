"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, leftmost first, and merges its
head until no pair is left in the vocabulary. No piece of such a vocabulary has the space mark
after another character, so a text falls apart into chunks (space marks, then other characters)
that never merge with each other; equal chunks get equal ids, so each task keeps those it has seen.
New chunks are encoded together: the agendas of many short chunks are the rows of one matrix, and
each round merges the head of every row; long chunks have a heap.

Every new chunk is checked against the sentencepiece library, in one call for each Arrow batch;
``verify="texts"`` checks whole texts as well.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices, text_or_empty

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
NONE = np.int32(2**31 - 1)
NOWHERE = (int(NONE), -1)
#: Texts that every normaliser but the identity changes: ligatures, full-width letters, marks that combine, blanks.
PROBES = ("\ufb01 \uff21 \u00b2 e\u0301", "a  b ", "x\u3000y\tz", "\u2460 \u00c5 \u1e9b\u0323")


class MergeVocabulary:
    """Pieces, merge ranks and byte pieces of a merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has the space mark after another character; chunks would not be independent")
        if any(lib.decode(lib.encode(t)) != t for t in PROBES):
            raise ValueError("the model changes texts before it encodes them; chunks are taken as they are")
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in range(n):
            if lib.is_byte(i):
                self.byte_id[int(self.pieces[i][1:-1], 16)] = i
                self.byte_of[i] = int(self.pieces[i][1:-1], 16)
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.odd = self.control | set(self.byte_of)
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        order = np.unique(-np.array([lib.get_score(i) for i in range(n)]), return_inverse=True)[1]
        keys, ranks, merged = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(order[i])
                    merged.append(i)
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[by], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[by], NONE)
        self.merged = np.append(np.array(merged, np.int32)[by], np.int32(-1))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NONE where the vocabulary has no such piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, np.where((left < 0) | (right < 0), 2**62, key))
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _finish(self, symbols: Iterable[int], chars: str) -> list[int]:
        """Ids; characters without a piece become byte pieces."""
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += self.byte_id[list(chars[-2 - s].encode())].tolist()
        return out

    def encode_rows(self, chunks: list[str]) -> list[list[int]]:
        """Agendas of short chunks as rows of a matrix, merged in rounds."""
        size = np.array([len(c) for c in chunks])
        width = int(size.max())
        S = np.full((len(chunks), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        S[inside] = np.where(self.of_char[points] >= 0, self.of_char[points], -2 - np.nonzero(inside)[1])
        R, to = self.pairs(S[:, :-1], S[:, 1:])
        live = np.arange(len(chunks))
        columns = np.arange(width + 1)
        while len(live):
            best = R[live].argmin(1)
            on = R[live, best] < NONE
            live, best = live[on], best[on]
            if not len(live):
                break
            rows = np.arange(len(live))
            s, r, t = S[live], R[live], to[live]
            s[rows, best] = t[rows, best]
            take = np.minimum(columns + (columns > best[:, None]), width)
            s = np.take_along_axis(s, take, 1)
            s[:, width] = -1
            gone = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), width - 1)
            r, t = np.take_along_axis(r, gone, 1), np.take_along_axis(t, gone, 1)
            r[:, width - 1] = NONE
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width)
                k, j = rows[ok], at[ok]
                r[k, j], t[k, j] = self.pairs(s[k, j], s[k, j + 1])
            S[live], R[live], to[live] = s, r, t
        left, odd = (S != -1).sum(1).tolist(), (S < -1).any(1).tolist()
        return [self._finish(row[:n], chunk) if o else row[:n] for row, n, o, chunk in zip(S.tolist(), left, odd, chunks)]

    def encode_long(self, chunk: str) -> list[int]:
        """The agenda of one long chunk as a heap over a linked list."""
        points = np.frombuffer(chunk.encode("utf-32-le"), "<u4")
        sym = np.where(self.of_char[points] >= 0, self.of_char[points], -2 - np.arange(len(points))).astype(np.int32)
        n = len(sym)
        rank, _ = self.pairs(sym[:-1], sym[1:])
        at = np.flatnonzero(rank < NONE)
        # an entry is a pair's rank and place in one number: ordered like the agenda, and a few bytes
        heap = (rank[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(heap)
        s, before, after = array("i", sym.tobytes()), array("i", range(-1, n - 1)), array("i", [*range(1, n), -1])
        del points, sym, rank, at
        lookup: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(i: int, j: int) -> tuple[int, int]:
            """Rank and merged id of the symbols at i and j."""
            if i < 0 or j < 0 or s[i] < 0 or s[j] < 0:
                return NOWHERE
            key = (s[i], s[j])
            if key not in lookup:
                r, t = self.pairs(np.array(key[:1]), np.array(key[1:]))
                lookup[key] = int(r[0]), int(t[0])
            return lookup[key]

        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            r, t = pair(i, j)
            if r != entry >> 32 or r >= NONE:
                continue  # one of the two has merged meanwhile
            s[i], s[j] = t, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                r, _ = pair(left, right)
                if r < NONE:
                    heapq.heappush(heap, r << 32 | left)
        return self._finish((x for x in s if x != -1), chunk)

    def encode_chunks(self, chunks: list[str], wide: int = 40, block: int = 4096) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(chunks)
        short = sorted((i for i, c in enumerate(chunks) if len(c) <= wide), key=lambda i: len(chunks[i]))
        for at in range(0, len(short), block):
            part = short[at : at + block]
            for i, ids in zip(part, self.encode_rows([chunks[i] for i in part])):
                out[i] = ids
        for i, c in enumerate(chunks):
            if len(c) > wide:
                out[i] = self.encode_long(c)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the pieces; runs of byte pieces are read as UTF-8; a leading space mark of the text goes."""
        if not self.odd.intersection(ids):
            return "".join([self.plain[i] for i in ids]).removeprefix(" ")
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                parts.append(self.plain[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return text.removeprefix(" ")


class Encoder:
    """Chunks seen by one Python worker, with their ids and their decoded text."""

    def __init__(self, path: str, keep_bytes: int = 100_000_000, longest: int = 48):
        self.vocabulary, self.keep_bytes, self.longest, self.held = MergeVocabulary(path), keep_bytes, longest, 0
        self.seen: dict[str, bytes] = {}
        self.long: list[str] = []  # chunks that are forgotten after their batch
        self.odd: dict[str, str] = {}  # chunks that decoding does not give back as they were

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first space mark (the first chunk has the one that encoding puts before a text)."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or SPACE in text:
            return [c[1:] for c in CHUNK.findall(SPACE + text.replace(" ", SPACE))]
        return words

    def learn(self, chunks: list[list[str]], verify: bool) -> None:
        for c in self.long:
            del self.seen[c]
            self.odd.pop(c, None)
        if self.held > self.keep_bytes:
            self.seen.clear()
            self.odd.clear()
            self.held = 0
        new = list(set().union(*chunks).difference(self.seen))
        self.long = [c for c in new if len(c) > self.longest]
        if not new:
            return
        v = self.vocabulary
        found = v.encode_chunks([SPACE + c for c in new])
        if verify:
            theirs = v.library.encode([c.replace(SPACE, " ") or " " for c in new], num_threads=1)
            for c, ours, ids in zip(new, found, theirs):
                if ours != ids and c:
                    raise ValueError(f"encoding differs from the sentencepiece library at {c!r}")
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        end = 0
        for c, ids in zip(new, found):
            text, end, at = v.decode(ids), end + 4 * len(ids), end
            self.seen[c] = flat[at:end]
            if len(c) <= self.longest:
                self.held += 200 + 4 * len(c) + end - at  # about what an entry takes
            if text != c:
                if verify and v.library.decode(ids) != text:
                    raise ValueError(f"decoding differs from the sentencepiece library at {c!r}")
                self.odd[c] = text

    def batch(self, texts: list[str], bos: bool, eos: bool, verify: str) -> tuple[list[bytes], list[str]]:
        chunks = [self.chunks(t) for t in texts]
        self.learn(chunks, verify != "none")
        head = np.array([self.vocabulary.bos] * bos, "<u4").tobytes()
        tail = np.array([self.vocabulary.eos] * eos, "<u4").tobytes()
        get, odd = self.seen.__getitem__, self.odd
        ids = [b"".join([head, *map(get, c), tail]) for c in chunks]
        # each chunk starts with a space mark, the first one with that of encoding
        decoded = [" ".join(c if odd.keys().isdisjoint(c) else [odd.get(x, x) for x in c]) for c in chunks]
        if verify == "texts":
            library = self.vocabulary.library
            for mine, theirs in zip(ids, library.encode(texts, add_bos=bos, add_eos=eos, num_threads=1)):
                if mine != np.array(theirs, "<u4").tobytes():
                    raise ValueError("encoding of a text differs from the sentencepiece library")
        return ids, decoded


_encoders: dict[str, Encoder] = {}


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, verify: str = "chunks"
) -> DataFrame:
    """Rows (id_col, ids binary of little-endian unsigned 32-bit ids, decoded string), one for each input row.

    A null text counts as empty: begin and end ids only, decoded to an empty text. Repeated rows
    and repeated ids stay as they are; a null id is kept; an empty table gives an empty one; other
    columns, whatever their names, are not read. Of pairs with equal scores (ties) the leftmost merges
    first. A very long text is held whole; one without any blank is one chunk, whose agenda takes some
    hundred bytes a character. model is the path of a merge-type model file that every executor has.
    verify: "chunks" checks each new chunk against the library, "texts" whole texts too, "none" nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(model) or _encoders.setdefault(model, Encoder(model))
        for b in slices(batches, 512):
            ids, decoded = encoder.batch(b.column(1).to_pylist(), bos, eos, verify)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, text): the text of the ids in ids_col, binary as encode() gives them; null gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(model) or _encoders.setdefault(model, Encoder(model))
        for b in slices(batches):
            texts = [encoder.vocabulary.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
