"""WARC records in Zstandard archives: one frame for each record, a dictionary in the leading skippable frame.

An archive is a binary value of a table, so that any file system Spark reads can hold it; read()
takes such a table or ``spark.read.format("binaryFile")`` over ``.warc.zst`` files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, slices, text_or_empty

# Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def mark_revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", at_least: int = 100) -> DataFrame:
    """pages with columns payload_digest, record_type and refers_to; columns of pages with these names are replaced, all others stay.

    Among rows with equal bodies of at_least bytes, those with the smallest id (ties and repeated rows
    too) are responses and the others revisits of it; a null id counts as the largest, and without
    any id all are responses. Null bodies are empty. Only digests that occur twice or more are
    joined back; they are written first, so that the join can split a digest of very many rows.
    """
    digest, first = "__digest", "__first"
    rows = pages.withColumn(digest, F.sha2(text_or_empty(body_col), 256))
    several = rows.filter(F.octet_length(text_or_empty(body_col)) >= at_least).groupBy(digest).agg(F.min(id_col).alias(first), F.count(F.lit(1)).alias("n"))
    several = materialise(several.filter(f"n > 1 and {first} is not null").select(digest, first), "digests")
    rows = rows.join(several, digest, "left")
    revisit = F.col(first).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(first))
    made = {"payload_digest": F.col(digest), "record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col(first))}
    return rows.select(*(F.col(f"`{c}`") for c in pages.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, kind: str, refers_to: object, date: str) -> bytes:
    """One record; a revisit has the HTTP headers of its response but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    # a header has one line: what would end it is percent-encoded, and then a header of its own has the whole URL
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if uri != (url or ""):
        lines.append(f"X-Page-URL: {json.dumps(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes], level: int = 3, sample_bytes: int = 1 << 20, dictionary_bytes: int = 1 << 14) -> bytes:
    """An archive of records; its dictionary is trained on the first sample_bytes of them, and absent if they are too few."""
    sample, size = [], 0
    for r in records:
        if size >= sample_bytes:
            break
        sample.append(r[: 1 << 16])
        size += len(sample[-1])
    trained = None
    if len(sample) >= 16:
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, sample)
        except zstandard.ZstdError:
            trained = None
    head = b""
    if trained:
        packed = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
        head = DICTIONARY_MAGIC + struct.pack("<I", len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=level, write_checksum=True)
    return head + b"".join(compressor.compress(r) for r in records)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows (archive, n_records, content) of archives of about archive_bytes before compression, from rows of mark_revisits().

    Null bodies are empty payloads, null urls empty URIs; repeated rows become records of their own;
    an empty table gives no archives; other columns are not read. A body is held whole, and a record
    may not be over 2 GiB, which is the most that a value of a table can have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        records: list[bytes] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.zst"]), pa.array([len(records)], pa.int64()), pa.array([make_archive(records)], pa.binary())], names=["archive", "n_records", "content"])

        size = 0
        for b in slices(batches, 64):
            for page_id, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                records.append(make_record(page_id, url, payload.encode(), digest, kind, refers, date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield out()
                    records.clear()
                    n, size = n + 1, 0
        if records:
            yield out()

    rows = pages.select(id_col, url_col, text_or_empty(body_col), "payload_digest", "record_type", "refers_to")
    return rows.mapInArrow(run, "archive string, n_records long, content binary")


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at `at` ends, from its block headers."""
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = data[at + 4] & 4
    while True:
        if pos + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            pos += 4 if checksum else 0
            if pos > len(data):
                raise ValueError("a frame is cut off")
            return pos


def read_archive(data: bytes, most: int = 1 << 31) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame; the dictionary is that of a leading skippable frame, itself compressed or not."""
    at, dictionary = 0, None
    if data[:4] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        raw = data[8 : 8 + size]
        if len(raw) < size:
            raise ValueError("the dictionary is cut off")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if data[at + 1 : at + 4] == DICTIONARY_MAGIC[1:] and data[at] >> 4 == 5:  # another skippable frame
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            continue
        if data[at : at + 4] != ZSTD_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield at, decompressor.decompress(data[at:end], max_output_size=most)
        at = end


#: Kinds of records whose block is an HTTP message; the others' block is the payload.
HTTP_TYPES = ("response", "revisit", "request")
KNOWN_TYPES = (*HTTP_TYPES, "warcinfo", "resource", "metadata", "conversion", "continuation")


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by their names in lower case."""
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}


def _unchunked(body: bytes) -> bytes:
    """The body of a message that was sent in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no length")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) < size:
            raise ValueError("a chunk is cut off")
        at = end + 4 + size


def _digest_fits(told: str, data: bytes) -> bool | None:
    """Whether a labelled digest, in hexadecimal or base 32, is that of data; None if its algorithm is not known here."""
    name, _, value = told.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(name, data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def parse_record(record: bytes) -> dict:
    """Headers by lower-case names, and payload of a record of any kind; "error" names what is wrong with it, or is None.

    The payload is the HTTP body of a response (without its chunks, if it was sent in these), request or revisit, and the whole block
    of other records. digest is that of the header, without the label sha256. Digests of unknown algorithms are not compared.
    """
    head, split, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = _fields(lines)
    kind, block = headers.get("warc-type", "").lower(), rest[:-4]
    is_http = kind in HTTP_TYPES and headers.get("content-type", "application/http").lower().startswith("application/http")
    http, http_split, body = block.partition(b"\r\n\r\n") if is_http else (b"", b"\r\n\r\n", block)
    fields = _fields(http.decode("utf-8", "replace").split("\r\n")[1:])
    length, told = fields.get("content-length", ""), headers.get("warc-payload-digest", "")
    payload, error = body, None
    if not version.startswith("WARC/1.") or not split:
        error = "no version line or header end"
    elif missing := [k for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length") if not headers.get(k.lower())]:
        error = f"missing {', '.join(missing)}"
    elif kind not in KNOWN_TYPES:
        error = f"unknown kind of record: {kind}"
    elif rest[-4:] != b"\r\n\r\n" or headers["content-length"] != str(len(block)):
        error = "block length differs from Content-Length"
    elif (block_digest := headers.get("warc-block-digest")) and _digest_fits(block_digest, block) is False:
        error = "block differs from its digest"
    elif not http_split:
        error = "no HTTP header"
    elif kind == "revisit":
        if body or not (headers.get("warc-refers-to") or headers.get("warc-refers-to-target-uri")):
            error = "revisit with a payload or without the record it refers to"
    elif is_http and kind == "response":
        if fields.get("transfer-encoding", "").lower() == "chunked":
            try:
                payload = _unchunked(body)
            except ValueError as e:
                error = str(e)
        elif length.isdigit() and len(body) != int(length):
            error = "payload differs from its length or digest"
        # some writers take the digest before the chunks are put together
        if error is None and told and _digest_fits(told, payload) is False and _digest_fits(told, body) is False:
            error = "payload differs from its length or digest"
    size = int(length) if kind == "revisit" and length.isdigit() else None if kind == "revisit" else len(payload)
    return {"headers": headers, "payload": payload, "payload_bytes": size, "digest": told.removeprefix("sha256:"), "error": error}


def read(archives: DataFrame, name_col: str = "archive", content_col: str = "content", id_type: str = "long") -> DataFrame:
    """Rows (archive, offset, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, error), one for each record.

    error is null for a sound record. A broken archive ends with one row that has its error; a
    null or empty one gives no rows. payload_bytes and payload_digest of a revisit are what its
    headers say, as it has no payload of its own.
    """
    number = (lambda x: None if x is None else int(x)) if id_type in ("long", "int") else (lambda x: x)
    id_arrow = {"long": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    names = ["archive", "offset", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    types = [pa.string(), pa.int64(), id_arrow, pa.string(), pa.string(), pa.int64(), pa.string(), id_arrow, pa.binary(), pa.string()]

    def records(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for offset, record in read_archive(data):
                r = parse_record(record)
                h = r["headers"]
                url = json.loads(h["x-page-url"]) if "x-page-url" in h else h.get("warc-target-uri", "")
                yield name, offset, number(h.get("x-page-id")), url, h.get("warc-type"), r["payload_bytes"], r["digest"], number(h.get("x-refers-to-page-id")), r["payload"], r["error"]
        except (ValueError, zstandard.ZstdError) as e:
            yield name, None, None, None, None, None, None, None, None, f"broken archive: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows: list[tuple] = []
            for row in records(b.column(0)[0].as_py(), b.column(1)[0].as_py() or b""):
                rows.append(row)
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = f"archive string, offset long, page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary, error string"
    return archives.select(name_col, content_col).mapInArrow(run, schema)
