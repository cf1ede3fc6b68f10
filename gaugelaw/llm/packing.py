"""Sum-of-squares online packing of tokenised documents into windows of fixed size.

With N(h) open windows filled to level h, a document of s tokens goes to the level that minimises
the sum of N(h) squared after the placement (a new window is level 0; ties go to the fullest).
Documents longer than a window fill whole windows first. Each task packs its partition as a stream.
The windows that are still open at its end are packed by the same rule in further rounds, of which
each brings the open windows of many tasks together, until they are few enough for one task or stop
getting fewer. Only what is open after the last round is cut: pieces of the emptiest windows fill the
fullest ones, and of the one window that stays partial the pieces are dealt to sequences of
power-of-two lengths. Nothing needs padding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, text_or_empty, text_slices

#: Sequence ids are the round's number, a partition's number and, in the lowest bits, the sequence's number in it.
LOCAL_BITS, PART_BITS, LAST_TURN = 34, 24, 31


#: Tokens of open windows that one task of a later round brings together.
ROUND_TOKENS = 4_000_000


class Levels:
    """Open windows by fill level, and the level array that placement reads."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.gain = np.zeros(size + 1, np.int64)  # change of the sum when a window enters a level
        self.gain[:size] = 1
        self.loss = np.full(size + 1, -(2**40), np.int64)  # and less this, when one leaves it
        self.loss[0] = 0

    def _recount(self, h: int, by: int) -> None:
        if 0 < h < self.size:
            self.count[h] += by
            n = int(self.count[h])
            self.gain[h], self.loss[h] = 2 * n + 1, 2 * n - 1 if n else -(2**40)

    def place(self, s: int, pieces: list[tuple]) -> list | None:
        """Put pieces of s tokens together (0 < s < size) in a window; the window's pieces if it is full now."""
        top = self.size - s
        cost = self.gain[s:] - self.loss[: top + 1]
        h = top - int(cost[::-1].argmin())
        window = self.open[h].pop() if h else []
        window += pieces
        self._recount(h, -1)
        if h + s == self.size:
            return window
        self.open.setdefault(h + s, []).append(window)
        self._recount(h + s, 1)
        return None

    def windows(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for h in sorted(self.open, reverse=True) for w in self.open[h]]


def drain(open_windows: list[list], size: int) -> tuple[list[list], list]:
    """Open windows, fullest first, made full by cutting pieces of the emptiest; also the one left, or no pieces."""
    windows = [[sum(len(p[2]) for p in w), w] for w in open_windows]
    first, last = 0, len(windows) - 1
    while first < last:
        h, window = windows[first]
        donor = windows[last]
        while h < size and donor[1]:
            doc, start, ids, total = donor[1].pop()
            n = min(size - h, len(ids))
            window.append((doc, start + len(ids) - n, ids[len(ids) - n :], total))
            if n < len(ids):
                donor[1].append((doc, start, ids[: len(ids) - n], total))
            h += n
            donor[0] -= n
        windows[first][0] = h
        first += h == size
        last -= not donor[1]
    return [w for h, w in windows if h == size], next((w for h, w in windows if 0 < h < size), [])


def powers(window: list) -> Iterator[list]:
    """The pieces of a partial window as sequences of power-of-two lengths, largest first."""
    left, pieces = sum(len(p[2]) for p in window), list(window)
    while left:
        need = n = 1 << (left.bit_length() - 1)
        out = []
        while need:
            doc, start, ids, total = pieces.pop(0)
            if len(ids) > need:
                pieces.insert(0, (doc, start + need, ids[need:], total))
            out.append((doc, start, ids[:need], total))
            need -= len(out[-1][2])
        left -= n
        yield out


def place_documents(docs: Iterator[tuple[object, np.ndarray]], levels: Levels) -> Iterator[list[tuple]]:
    """Full windows, each a list of pieces (document, start, ids, document's tokens), of (document, ids); the open ones stay in levels."""
    size = levels.size
    for doc, ids in docs:
        total = len(ids)
        whole = total - total % size
        for at in range(0, whole, size):
            yield [(doc, at, ids[at : at + size], total)]
        # a copy: an open window must not hold the ids of its batch
        if whole < total and (window := levels.place(total - whole, [(doc, whole, ids[whole:].copy(), total)])):
            yield window


def place_windows(windows: Iterator[list[tuple]], levels: Levels) -> Iterator[list[tuple]]:
    """The same of open windows, whose pieces stay together."""
    for w in windows:
        if full := levels.place(sum(len(p[2]) for p in w), w):
            yield full


class WordTokenizer:
    """Ids of a tokenizer whose tokens never span white space, from the ids of the pieces seen so far.

    If the tokenizer lower-cases and splits letters from other characters, a word of Latin letters,
    with or without one comma or full stop behind it, has the ids of its stem and of the mark. New
    stems are encoded many at a time: each ends with its only token that ends a word. Whether the
    tokenizer is of this kind is read from its description; any other one gets whole texts.
    """

    LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.keep = Tokenizer.from_file(path), keep
        self.by_word = self._splits_at_blanks()
        size = self.library.get_vocab_size()
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget(np.zeros(0, np.int64))

    def _splits_at_blanks(self) -> bool:
        """Whether white space and the borders of letters, digits and marks bound every token, and capitals don't count."""
        told = json.loads(self.library.to_str())
        norm, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        classes = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        fits = kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
        fits = fits and first["pattern"].get("Regex", "").endswith(classes) and (told.get("model") or {}).get("end_of_word_suffix") == "</w>"
        # special tokens are found before the text is normalised, and one with a blank in it would span words
        return bool(fits) and not any(any(c.isspace() for c in t["content"]) for t in told.get("added_tokens", []))

    def _forget(self, kept: np.ndarray) -> None:
        """Forget all pieces but those with these numbers; the first three are always known."""
        if not len(kept):
            first = self._encode(["", ",", "."])
            self.pieces, self.ids = pa.array(["", ",", "."]), np.concatenate(first)
            self.size = np.array([len(x) for x in first], np.int64)
            self.used = np.full(3, 2**30, np.int64)
        else:
            self.ids = self._gather(kept)
            self.pieces, self.size, self.used = self.pieces.take(pa.array(kept)), self.size[kept], np.ones(len(kept), np.int64)
            self.used[:3] = 2**30
        self.start = np.cumsum(self.size) - self.size

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for at in range(0, len(texts), 256) for e in self.library.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]

    def _encode_stems(self, stems: list[str], together: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all stems, and how many each has."""
        groups = [stems[at : at + together] for at in range(0, len(stems), together)]
        all_ids, size = [], []
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != len(group) or n.sum() != len(ids):
                each = self._encode(group)
                ids, n = np.concatenate(each), np.array([len(x) for x in each])
            all_ids.append(ids)
            size.append(n)
        return all_ids, size

    def _gather(self, number: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after another."""
        return _gathered(self.ids, self.start[number], self.size[number])

    def _numbers(self, wanted: pa.Array) -> np.ndarray:
        """Numbers of these distinct pieces; unknown ones are learned."""
        found = pc.index_in(wanted, value_set=self.pieces)
        if found.null_count and len(self.pieces) + found.null_count > self.keep:
            often = np.flatnonzero(self.used > 1)  # since the last time
            self._forget(often if len(often) <= self.keep // 2 else often[:3])
            found = pc.index_in(wanted, value_set=self.pieces)
        if found.null_count:
            new = wanted.filter(found.is_null())
            stem = pc.match_substring_regex(new, self.LETTERS)
            stems, odd = new.filter(stem), new.filter(pc.invert(stem))
            ids, size = self._encode_stems(stems.to_pylist())
            odd_ids = self._encode(odd.to_pylist())
            self.pieces = pa.concat_arrays([self.pieces, stems, odd])
            self.size = np.concatenate((self.size, *size, np.array([len(x) for x in odd_ids], np.int64)))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            self.ids = np.concatenate((self.ids, *ids, *odd_ids))
            self.start = np.cumsum(self.size) - self.size
            found = pc.index_in(wanted, value_set=self.pieces)
        number = found.to_numpy()
        self.used[number] += 1
        return number

    def _words(self, texts: pa.Array) -> pa.Array:
        """The words of each text; \x1c to \x1f are white space to Arrow and to Python, but not to the tokenizer."""
        if not pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            return pc.utf8_split_whitespace(texts)
        return pa.array([re.findall(r"(?:\S|[\x1c-\x1f])+", t) for t in texts.to_pylist()], pa.list_(pa.string()))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._encode(texts.to_pylist())
        words = self._words(texts)
        flat = words.flatten().dictionary_encode()
        unique = flat.dictionary
        # letters with one mark behind them: a stem and a mark; what is left stays as it is
        marked = pc.match_substring_regex(unique, r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[,.]$")
        mark = np.where(marked, np.where(pc.ends_with(unique, ","), 1, 2), 0)
        stem = pc.if_else(marked, pc.utf8_slice_codeunits(unique, 0, -1), unique)
        stem = pc.if_else(pc.match_substring_regex(stem, self.LETTERS), pc.utf8_lower(stem), stem).dictionary_encode()
        number = self._numbers(stem.dictionary)[stem.indices.to_numpy()]
        both = np.stack([number, mark], 1).ravel()
        ids, n = self._gather(both), (self.size[both][::2] + self.size[both][1::2])
        use = flat.indices.to_numpy()
        end = np.concatenate((np.zeros(1, np.int64), np.cumsum(n[use])))
        ids = _gathered(ids, (np.cumsum(n) - n)[use], n[use])
        edges = end[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]


    def texts(self, texts: pa.Array, longest: int = 4_000_000) -> list[np.ndarray]:
        """Ids of each text; one of many MB is cut between words, so that a few times as many bytes are held at once."""
        if not self.by_word or pc.max(pc.binary_length(texts)).as_py() <= longest:
            return self.batch(texts)
        out = []
        for text in texts.to_pylist():
            cuts = [0]
            while len(text) - cuts[-1] > longest // 4:
                m = _BLANK.search(text, cuts[-1] + longest // 4)
                if not m:
                    break
                cuts.append(m.start())
            parts = [self.batch(pa.array([text[a:z]]))[0] for a, z in zip(cuts, [*cuts[1:], len(text)])]
            out.append(np.concatenate(parts))
        return out


_BLANK = re.compile("[ \n\t]")


def _gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ids[start[0] : start[0] + n[0]], then those of the next run."""
    end = np.cumsum(n)
    return ids[np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


_tokenizers: dict[str, WordTokenizer] = {}
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _table(id_col: str, id_type: pa.DataType, sequences: Iterator[tuple[int, list[tuple], bool]]) -> Iterator[pa.RecordBatch]:
    """Batches of pieces from (sequence id, pieces, whether the window is open)."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"])

    for sequence, pieces, still_open in sequences:
        offset = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset, still_open))
            offset += len(ids)
        if len(rows) >= 500:
            yield out()
            rows.clear()
    if rows:
        yield out()


def _read_windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Windows from rows of their pieces that lie one after another."""
    last, window = None, []
    for b in batches:
        for sequence, doc, start, ids, total in zip(*(b.column(i).to_pylist() for i in (5, 0, 1, 3, 4))):
            if sequence != last and window:
                yield window
                window = []
            last = sequence
            window.append((doc, start, np.frombuffer(ids, "<u4"), total))
    if window:
        yield window


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", round_tokens: int = ROUND_TOKENS) -> DataFrame:
    """One row for each piece: id_col, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, placed (whether the sequence is a window that placement filled, not a cut at the end).

    A document is its tokenizer ids and then end_id; a null or empty text is end_id alone. Each id
    lies in exactly one piece, and the pieces of a sequence fill it without gaps. A sequence has
    size ids or a power of two; nothing needs padding. Repeated rows, equal ids and null ids are
    packed as they come, each row as a document; documents of equal length (ties) in their order; an
    empty table gives no rows; other columns, whatever their names, are not read. A very long text
    is tokenised in parts of some MB, and its whole windows are given out at once. A task holds the
    open windows' ids, at most those of its partition or of about round_tokens. Each round is
    written to the shared folder, so that a lost executor repeats none of it.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECE}, open boolean"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        words = _tokenizers.get(tokenizer) or _tokenizers.setdefault(tokenizer, WordTokenizer(tokenizer))
        end = np.array([end_id], "<u4")
        for b in text_slices(batches, 1):
            for doc, ids in zip(b.column(0).to_pylist(), words.texts(b.column(1))):
                yield doc, np.concatenate((ids, end))

    def numbered(turn: int, full: Iterator[list[tuple]], levels: Levels) -> Iterator[tuple[int, list[tuple], bool]]:
        first = turn << PART_BITS + LOCAL_BITS | TaskContext.get().partitionId() << LOCAL_BITS
        n = -1
        for n, w in enumerate(full):
            yield first + n, w, False
        for k, w in enumerate(levels.windows(), n + 1):
            yield first + k, w, True

    def typed(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            yield from _table(id_col, head.schema.field(0).type, work(chain([head], batches)))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(size)
        yield from typed(batches, lambda bs: numbered(0, place_documents(tokens(bs), levels), levels))

    def later_round(turn: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = Levels(size)
            yield from typed(batches, lambda bs: numbered(turn, place_windows(_read_windows(bs, size), levels), levels))

        return run

    def last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(bs: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], bool]]:
            levels = Levels(size)
            closed = place_windows(_read_windows(bs, size), levels)
            first = LAST_TURN << PART_BITS + LOCAL_BITS | TaskContext.get().partitionId() << LOCAL_BITS
            n = 0
            for w in closed:
                yield first + n, w, False
                n += 1
            full, rest = drain(levels.windows(), size)
            for w in chain(full, powers(rest)):
                yield first + n, w, True
                n += 1

        yield from typed(batches, run)

    def together(rows: DataFrame, tasks: int) -> DataFrame:
        dealt = rows.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else rows.repartition(1)
        return dealt.sortWithinPartitions("sequence_id", "offset")

    # closed and open windows lie in folders of their own: a later round reads no closed one
    done = materialise(docs.select(id_col, text_or_empty(text_col)).mapInArrow(first_round, schema), "packed", by="open")
    parts, left = [done.filter(~F.col("open"))], done.filter("open")
    before = None
    for turn in range(1, LAST_TURN):
        n = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = -(-n // round_tokens)
        if tasks <= 1 or before is not None and n > before / 2:
            break
        before = n
        done = materialise(together(left, tasks).mapInArrow(later_round(turn), schema), "packed", by="open")
        parts.append(done.filter(~F.col("open")))
        left = done.filter("open")
    if n:
        parts.append(together(left, max(1, tasks)).mapInArrow(last_round, schema))
    out = reduce(DataFrame.union, [p.select(done.columns) for p in parts])
    return out.select(id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", (~F.col("open")).alias("placed"))
