"""MPEG audio column: streams that carry a payload, and a reader of streams.

Writer: an ID3v2 tag, a frame with a variable-bitrate ("Xing") table, then MPEG-1 Layer III frames
at 48 kHz with checksums. The granules of a frame are silent (all side information 0) and the
payload is the frame's ancillary data: two units of 192 bytes in a frame of 160 kbit/s, an odd last
unit in one of 80 kbit/s. UTF-8 has no byte 255, so no payload looks like a frame header.

Reader: skips tags (ID3v2 of all versions with footers and unsynchronised bytes, ID3v1), looks for
a header that a second one of its version, layer and rate confirms (resynchronisation), walks the
frames in runs of equal headers, verifies the checksums of all three layers, and reads the table
("Xing", "Info" or "VBRI") with its seek points. Streams of free format have the length at which
their header comes again. Durations are exact numbers of samples; frame offsets are bytes from the
start of the stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import slices, text_or_empty

UNIT = 192
#: The most bytes of a frame of free format.
FREE = 8192
# Fixed values of the MPEG audio formats: kbit/s by index (1 to 14) and Hz by index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}


@dataclass
class Header:
    version: int  # the two bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    kbps: int
    hz: int
    protected: bool
    mono: bool
    length: int  # 0: free format
    samples: int
    bound: int = 32  # subbands of Layers I and II that are coded for each channel
    pad: int = 0

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return ((17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)) if self.layer == 3 else 0


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate, hz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
        if version != 1 and layer != 4 and rate < 15 and hz < 3 and four[3] & 3 != 2:
            kbps, hertz = KBPS[1 if version == 3 else 2, layer][rate - 1] if rate else 0, HZ[version][hz]
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            length = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
            mode = four[3] >> 6
            bound = 4 * ((four[3] >> 4 & 3) + 1) if mode == 1 else 32
            found = Header(version, layer, kbps, hertz, not four[1] & 1, mode == 3, length if rate else 0, samples, bound, pad)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial x^16 + x^15 + x^2 + 1, start value all ones."""
    if data in _crcs:
        return _crcs[data]
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    if len(_crcs) < 4096:
        _crcs[data] = crc
    return crc


# Fixed values of Layer II: bits of each subband's allocation, by table.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "e": [4] * 4 + [3] * 7 + [2] * 19}


def checked_bits(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum it covers: side information (Layer III), allocation (I), allocation and scale selection (II)."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (h.bound * channels + 32 - h.bound) if channels == 2 else 128
    each = h.kbps // channels
    sizes = ALLOCATION["e" if h.version != 3 else ("d" if h.hz == 32000 else "c") if each < 56 else "b" if each >= 96 and h.hz != 48000 else "a"]
    bits = int.from_bytes(frame[6:], "big")
    left = 8 * (len(frame) - 6)
    used, selected = 0, 0
    for band, size in enumerate(sizes):
        for _ in range(channels if band < h.bound else 1):
            used += size
            if left >= used and bits >> (left - used) & (1 << size) - 1:
                selected += 1 if band < h.bound else channels
    return used + 2 * selected


def crc_bits(data: bytes, bits: int) -> int:
    """The checksum of the first bits of data."""
    crc = crc16(data[: bits // 8])
    for i in range(bits % 8):
        top = crc >> 15 ^ (data[bits // 8] >> (7 - i) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def frame_head(kbps: int) -> bytes:
    """Header, checksum and silent side information of a protected stereo frame at 48 kHz."""
    four = bytes([0xFF, 0xFA, KBPS[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0])
    return four + struct.pack(">H", crc16(four[2:] + bytes(32))) + bytes(32)


def id3v2(title: str) -> bytes:
    text = b"\x03" + title.encode()
    frame = b"TIT2" + struct.pack(">IH", len(text), 0) + text
    n = len(frame)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame


def pad_payload(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


LARGE, SMALL, TABLE, TITLE = frame_head(160), frame_head(80), frame_head(128), id3v2("text payload")


def write_stream(payload: bytes) -> bytes:
    """A stream whose ancillary data are payload, a positive multiple of the unit without byte 255."""
    units = len(payload) // UNIT
    two, one = units // 2, units % 2
    large = np.zeros((two, 480), np.uint8)
    large[:, :38] = np.frombuffer(LARGE, np.uint8)
    large[:, 38 : 38 + 2 * UNIT] = np.frombuffer(payload, np.uint8, two * 2 * UNIT).reshape(two, 2 * UNIT)
    small = SMALL + payload[two * 2 * UNIT :] + bytes(240 - 38 - UNIT) if one else b""
    frames, size = 1 + two + one, 384 + two * 480 + one * 240
    starts = np.minimum(np.arange(100) * frames // 100, frames - 1)
    offsets = np.where(starts > 0, 384 + (starts - 1) * 480, 0)
    xing = b"Xing" + struct.pack(">III", 7, frames - 1, size) + (offsets * 256 // size).astype(np.uint8).tobytes()
    return TITLE + (TABLE + xing).ljust(384, b"\0") + large.tobytes() + small


@dataclass
class Stream:
    """What a reader finds. offsets: of each frame, without the table's; seek: the table's seek points, bytes from its frame; ancillary: the bytes after silent side information."""

    tags: list[str] = field(default_factory=list)
    title: str | None = None
    hz: int = 0
    frames: int = 0
    samples: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ancillary: list[bytes] = field(default_factory=list)
    kbps: dict[int, int] = field(default_factory=dict)


def _synchsafe(four: bytes) -> int:
    a, b, c, d = four
    return (a & 127) << 21 | (b & 127) << 14 | (c & 127) << 7 | d & 127


def _title(body: bytes, version: int) -> str | None:
    """The text of the title frame of an ID3v2 tag's body."""
    name, head = (b"TT2", 6) if version == 2 else (b"TIT2", 10)
    at = 0
    while at + head <= len(body) and body[at]:
        raw = body[at + len(name) : at + 2 * len(name)]
        size = int.from_bytes(raw, "big") if version < 4 else _synchsafe(raw)
        if body[at : at + len(name)] == name:
            text = body[at + head : at + head + size]
            if not text:
                return ""
            return text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0], "utf-8"), "replace").rstrip("\0")
        at += head + size
    return None


def _skip_tags(data: bytes, s: Stream) -> tuple[int, int]:
    """First byte behind the leading tags, and where a closing ID3v1 tag may begin (else the end)."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        version, flags = data[start + 3], data[start + 5]
        n = _synchsafe(data[start + 6 : start + 10])
        s.tags.append(f"id3v2.{version}")
        body = data[start + 10 : min(start + 10 + n, end)]
        if flags & 0x80:  # unsynchronised: a zero stands behind each byte 255
            body = body.replace(b"\xff\0", b"\xff")
        if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header
            body = body[_synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
        s.title = _title(body, version) if s.title is None else s.title
        start = min(start + 10 + n + (10 if version == 4 and flags & 0x10 else 0), end)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        return start, end - 128
    return start, end


def _alike(a: Header | None, b: Header) -> bool:
    return a is not None and (a.version, a.layer, a.hz, a.kbps > 0) == (b.version, b.layer, b.hz, b.kbps > 0)


def _free_length(data: bytes, at: int, h: Header, end: int) -> int:
    """The length of a frame of free format: where a header like its own comes next, within FREE bytes, less the padding; 0 if none does."""
    unit = 4 if h.layer == 1 else 1
    end = min(end, at + FREE)
    next_at = at + 4
    while True:
        next_at = data.find(data[at : at + 2], next_at + 1, end)
        if next_at < 0:
            return 0
        if _alike(header(data[next_at : next_at + 4]), h):
            return next_at - at - unit * h.pad


def _table(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Whether the first frame is that of a table, which is read into s."""
    mark = at + 4 + 2 * h.protected + h.side
    if data[mark : mark + 4] in (b"Xing", b"Info"):
        flags, place = int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
        if flags & 1:
            s.table_frames = int.from_bytes(data[place : place + 4], "big")
            place += 4
        if flags & 2:
            s.table_bytes = int.from_bytes(data[place : place + 4], "big")
            place += 4
        if flags & 4:  # parts of 256 of the stream's bytes
            s.seek = np.frombuffer(data[place : place + 100], np.uint8).astype(np.int64) * (s.table_bytes or len(data) - at) // 256
        return True
    if data[at + 36 : at + 40] == b"VBRI":
        if len(data) < at + 62 or not 1 <= int.from_bytes(data[at + 58 : at + 60], "big") <= 4:
            return False  # no room for a table, or entries that none has
        s.table_bytes, s.table_frames, entries, scale, size, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        raw = np.frombuffer(data[at + 62 : at + 62 + entries * size], np.uint8)
        raw = raw[: len(raw) // max(1, size) * size].reshape(-1, max(1, size)).astype(np.int64)
        s.seek = np.cumsum((raw << 8 * np.arange(size - 1, -1, -1)).sum(1)) * scale
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Frames, tags, table and checksums of a stream; damaged or foreign bytes are skipped up to the next confirmed header."""
    s = Stream()
    at, tag = _skip_tags(data, s)
    end = len(data)
    runs: list[np.ndarray] = []
    first, free = True, 0
    array = np.frombuffer(data, np.uint8)
    while at + 4 <= end:
        if at == tag < end:  # it is a tag only if no frame covers it: payloads may have its three letters there
            s.tags.append("id3v1")
            end = tag
            break
        four = data[at : at + 4]
        h = header(four)
        if h is not None and not h.length:
            free = free or _free_length(data, at, h, end)
            h = replace(h, length=free + (4 if h.layer == 1 else 1) * h.pad) if free else None
        # a header counts if one like it, or the end, follows where its frame ends
        if h is None or at + h.length > end or not (at + h.length in (tag, end) or _alike(header(data[at + h.length : at + h.length + 4]), h)):
            stop = tag if at < tag else end
            step = data.find(b"\xff", at + 1, stop)
            step = step if step >= 0 else stop
            s.skipped += step - at
            at = step
            continue
        if first:
            first = False
            s.hz = h.hz
            if _table(data, at, h, s):
                if h.protected:
                    s.checked += 1
                    s.bad_checksums += not _sound(data[at : at + h.length], h)
                at += h.length
                continue
        n = (end - at) // h.length  # frames with this very header that follow each other
        rows = array[at : at + n * h.length].reshape(n, h.length)
        same = (rows[:, :4] == rows[0, :4]).all(1)
        n = n if same.all() else int(same.argmin())
        behind = at + n * h.length
        if n > 1 and behind - h.length < tag < behind < end and not header(data[behind : behind + 4]):
            n -= 1  # cut off by a tag
        rows = rows[:n]
        head = 4 + 2 * h.protected + h.side
        if h.protected:
            s.checked += n
            # frames that agree in all that is checked are checked once
            reach = head if h.layer == 3 else min(h.length, 4 + 2 + 64)
            kinds, often = np.unique(rows[:, :reach], axis=0, return_counts=True) if n > 1 and not (rows[:, :reach] == rows[0, :reach]).all() else (rows[:1, :reach], [n])
            s.bad_checksums += int(sum(k for row, k in zip(kinds, often) if not _sound(row.tobytes(), h)))
        runs.append(at + np.arange(n, dtype=np.int64) * h.length)
        s.frames += n
        s.samples += n * h.samples
        s.kbps[h.kbps] = s.kbps.get(h.kbps, 0) + n
        if h.layer == 3 and not rows[:, 6 * h.protected or 4 : head].any():
            room = (h.length - head) // UNIT * UNIT
            s.ancillary.append(rows[:, head : head + room].tobytes())
        at += n * h.length
    s.skipped += end - at
    s.offsets = np.concatenate(runs) if runs else s.offsets
    return s


def _sound(frame: bytes, h: Header) -> bool:
    """Whether a protected frame has the checksum of its header and of what the layer protects."""
    return crc_bits(frame[2:4] + frame[6:], 16 + checked_bits(frame, h)) == int.from_bytes(frame[4:6], "big")


def feature(s: Stream) -> str:
    """Exact duration, frames, bit rates and checks of a stream in one line."""
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    last = int(s.offsets[-1]) if len(s.offsets) else -1
    return f"samples={s.samples}/{s.hz};frames={s.frames};kbps={rates};table={s.table_frames};bad_crc={s.bad_checksums}/{s.checked};skipped={s.skipped};last_frame={last}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, media): each text (null: empty) as the payload of a stream. Equal texts give equal streams.

    Ids, null ids and repeated rows stay as they are; a very long text is held whole, with its stream;
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x.encode() for x in b.column(1).to_pylist()]
            media = [write_stream(pad_payload(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, keep..., media_col, payload, samples, hz, frame_offsets, seek, title, bad_checksums, skipped, feature), one for each stream.

    A null or empty stream, and one without frames, gives an empty payload and no frames. Repeated
    rows and null ids stay; columns not in keep are left out, and so is one in keep that has the name
    of a result.
    """
    keep = tuple(c for c in keep if c not in ("payload", "samples", "hz", "frame_offsets", "seek", "title", "bad_checksums", "skipped", "feature"))
    columns = [id_col, *keep, media_col]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [read_stream(x or b"") for x in b.column(len(columns) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([b"".join(s.ancillary) for s in found], pa.binary()), pa.array([s.samples for s in found], pa.int64()), pa.array([s.hz for s in found], pa.int32()),
                 pa.array([s.offsets for s in found], pa.list_(pa.int64())), pa.array([s.seek for s in found], pa.list_(pa.int64())), pa.array([s.title for s in found], pa.string()), pa.array([s.bad_checksums for s in found], pa.int32()), pa.array([s.skipped for s in found], pa.int64()), pa.array([feature(s) for s in found], pa.string())],
                names=[*columns, "payload", "samples", "hz", "frame_offsets", "seek", "title", "bad_checksums", "skipped", "feature"],
            )

    return media.select(*columns).mapInArrow(run, f"{kinds}, payload binary, samples long, hz int, frame_offsets array<long>, seek array<long>, title string, bad_checksums int, skipped long, feature string")
