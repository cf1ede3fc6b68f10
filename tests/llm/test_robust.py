"""Inputs that other writers make, broken tables, and texts that are one long word."""

import base64
import hashlib
import struct
import tracemalloc

import pytest
from pyspark.sql import functions as F

from gaugelaw.llm import language_id, mpeg_audio, sentencepiece_bpe, url_rules, warc_zstd
from gaugelaw.llm.queries import tokenizer_path


def record(kind, block, *more):
    lines = ["WARC/1.0", f"warc-type: {kind}", "WARC-RECORD-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    page = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(b"Wikipedia").digest()).decode()
    for told, error in ((f"sha1:{sha1}", None), ("sha1:" + "A" * 32, "payload differs from its length or digest"), ("blake9:zz", None), ("", None)):
        r = warc_zstd.parse_record(record("response", page, "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {told}", "WARC-Target-URI: https://a/%20b"))
        assert (r["error"], r["payload"], r["headers"]["warc-target-uri"]) == (error, b"Wikipedia", "https://a/%20b")
    assert warc_zstd.parse_record(record("response", page[:-20], "Content-Type: application/http"))["error"]
    for kind, block in (("warcinfo", b"software: x\r\n"), ("metadata", b""), ("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), ("resource", b"\x00\r\n\r\n\x01")):
        r = warc_zstd.parse_record(record(kind, block, "Content-Type: application/warc-fields" if kind != "request" else "Content-Type: application/http"))
        assert r["error"] is None and r["payload"] == (b"" if kind == "request" else block)
    assert "unknown kind" in warc_zstd.parse_record(record("other", b""))["error"]
    assert warc_zstd.parse_record(record("resource", b"abc", "WARC-Block-Digest: sha256:00"))["error"] == "block differs from its digest"


def test_urls_are_written_as_they_are(spark):
    urls = ["https://a/%20b", "50%25", "x\r\ny%0Az", "", None, "https://é/漢"]
    pages = spark.createDataFrame([(i, u, "body" * 100 + str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    archives = warc_zstd.write(warc_zstd.mark_revisits(pages)).collect()
    text = b"".join(r for a in archives for _, r in warc_zstd.read_archive(bytes(a["content"])))
    assert b"WARC-Target-URI: https://a/%20b\r\n" in text and b"WARC-Target-URI: 50%25\r\n" in text
    got = warc_zstd.read(spark.createDataFrame(archives)).collect()
    assert {r["page_id"]: (r["url"], r["error"]) for r in got} == {i: (u or "", None) for i, u in enumerate(urls)}


@pytest.mark.parametrize("cut", [*range(36, 70, 3), 400])
@pytest.mark.parametrize("size", [0, 1, 4, 9, 65535])
def test_short_tables(cut, size):
    """A frame with the mark of a table that ends early, or whose entries have an odd size."""
    data = bytes([0xFF, 0xFB, 0x94, 0x00]) + b"\0" * 32 + b"VBRI" + b"\0" * 6 + struct.pack(">IIHHHH", 1000, 3, 5, 1, size, 1) + b"\1" * 300
    mpeg_audio.read_stream(data[:cut])
    mpeg_audio.read_stream(data[:cut] + data[:4])


def test_one_long_word():
    """A chunk of a million characters: the library's ids, under a hundred bytes a character."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    v, library = sentencepiece_bpe.MergeVocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("abra漢字cadabra" * 300, "x" * 3000, "ю\x01z" * 500):
        assert v.encode_long("▁" + text) == library.encode(text)
    text = "theantheinabcdeз漢" * 12_000
    tracemalloc.start()
    ids = v.encode_long("▁" + text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == library.encode(text) and most < 150 * len(text)


def test_chunks_that_are_forgotten():
    """Memory of chunks is bounded by bytes, long ones go after their batch; ids stay the same."""
    path = tokenizer_path("piece_bpe_32k.model")
    small, whole = sentencepiece_bpe.Encoder(path, keep_bytes=2000, longest=10), sentencepiece_bpe.Encoder(path)
    for k in range(6):
        texts = [f"some words {k} {'longer' * 9} {'w' * k}  ▁ a", "漢字" * 40, "some words again", ""]
        assert small.batch(texts, True, True, "texts") == whole.batch(texts, True, True, "texts")
    assert len(small.seen) < len(whole.seen) and not any(len(c) > 48 for c in whole.seen if c not in whole.long)


def test_all_languages_are_learned(spark):
    """Hundreds of languages share the sample."""
    rows = [(i, " ".join([f"{chr(0x4E00 + i % 300) * 5}w{i % 300}"] * 8), f"l{i % 300:03d}") for i in range(3000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=3000)
    assert len(model.langs) == 300
    few = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=900)
    assert 200 < len(few.langs) <= 300


def test_rows_in_pieces(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 1001), ("d", 2500)], "k string, n long")
    assert {r["k"]: r["count"] for r in url_rules._repeated(df, "n").groupBy("k").count().collect()} == {"a": 1, "b": 1000, "c": 1001, "d": 2500}
    assert url_rules._repeated(df.filter(F.col("n") < 0), "n").count() == 0
