"""Each operator against a brute-force version, a library or a round trip, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugelaw.llm import hamming_topk, language_id, mpeg_audio, packing, sentencepiece_bpe, setsketch, suffix_dedup, url_rules, warc_zstd, weak_quality
from gaugelaw.llm.components import connected_components
from gaugelaw.llm.queries import ORACLE_SQL, QUERIES, STATED_RULES, tokenizer_path

WORDS = "the an of river stone héllo  wor'ld 42 ßtraße 漢字 x".split(" ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, score string"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    base += [base[0], base[1], base[1] + " more", base[2][: len(base[2]) // 2] + base[3], "", None, "   ", "漢" * 500, "word " * 6000]
    return base


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "a", "b", "c") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, "no id at all", None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(docs, path, size=256).collect()
    library = Tokenizer.from_file(path)
    want = Counter(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect())
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= 256 and total & (total - 1) == 0
    assert Counter(b"".join(x for _, x in sorted(p)) for k, p in pieces.items() if k[0] != 0) == want - Counter({next(k for k in want if want[k] and k == np.array([*library.encode(texts()[0], add_special_tokens=False).ids, 2], "<u4").tobytes()): 2})
    assert packing.pack(nothing, path).count() == 0


def test_word_tokenizer_against_library():
    import pyarrow as pa

    w = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"), keep=500)
    rng = random.Random(2)
    odd = ["".join(rng.choices([*"abZ the',.  \n\t\0éüİΣς漢🙂́\x1c\x85　½!?ªº", "<|endoftext|>", "'s"], k=rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in w.library.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for at in range(0, 3000, 500) for x in w.batch(pa.array(odd[at : at + 500]))] == want


def test_sum_of_squares_choice():
    levels = packing.Levels(10)
    for piece, size in (("a", 6), ("b", 6), ("c", 4)):
        levels.place(size, [(piece, 0, np.zeros(size, np.uint32), size)])
    assert levels.count[6] == 1 and len(levels.windows()) == 1  # c completes one of the two equal windows


def test_sum_of_squares_against_brute_force():
    rng, size = random.Random(6), 24
    levels, fills = packing.Levels(size), []
    for i in range(2000):
        s = rng.randint(1, size - 1)
        squares = lambda f: sum(n * n for h, n in Counter(f).items() if 0 < h < size)
        # the least sum of squares; of equal choices the fullest window
        options = [(squares([*fills[:k], h + s, *fills[k + 1 :]] if k is not None else [*fills, s]), -h, k) for h, k in [(0, None), *((h, fills.index(h)) for h in set(fills))] if h + s <= size]
        _, h, k = min(options, key=lambda o: o[:2])
        if k is not None:
            fills.pop(k)
        full = levels.place(s, [(i, 0, np.zeros(s, np.uint32), s)])
        assert (full is not None) == (s - h == size)
        fills += [s - h] if s - h < size else []
        assert sorted(fills) == sorted(sum(len(p[2]) for p in w) for w in levels.windows())


@pytest.mark.parametrize("round_tokens", [2000, 10**6])
def test_packing_rounds(spark, round_tokens):
    """Open windows of many tasks meet; the query's own columns against a plain tokeniser."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["stone", "river", "of", "Light,", "x."], k=rng.randint(0, 60)))) for i in range(900)]
    rows += [(5000, "word " * 3000), (5001, "w" * 3000), (5001, "w" * 3000)]
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), path, size=64, round_tokens=round_tokens).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["placed"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for s in sequences.values():
        total = sum(n for _, n, _ in s)
        assert [o for o, _, _ in sorted(s)] == [sum(n for _, n, _ in sorted(s)[:i]) for i in range(len(s))]
        assert total == 64 or (total & (total - 1) == 0 and not any(p for *_, p in s))
    for i, t in dict(rows).items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert sorted(b"".join(x for _, x in sorted(pieces[i])) if i != 5001 else ids) == sorted(ids) and len(b"".join(x for _, x in pieces[i])) == len(ids) * (2 if i == 5001 else 1)
    closed = sum(s[0][2] for s in sequences.values()) / len(sequences)
    assert closed > 0.6


def test_packing_of_equal_lengths(spark):
    """No two of them fit together: every window stays open, and is cut at the end."""
    docs = spark.createDataFrame([(i, "of " * 32) for i in range(300)], "doc_id long, text string").repartition(6)
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), size=64, round_tokens=1000).collect()
    assert sum(r["length"] for r in got) == 300 * 33 and not any(r["placed"] for r in got)


def test_tokenizer_of_another_kind(tmp_path):
    import pyarrow as pa

    w = packing.WordTokenizer(tokenizer_path("byte_bpe_50k.json"))
    texts = ["A b  c, d.", "", "héllo\n\nx"]
    assert not w.by_word and [x.tolist() for x in w.texts(pa.array(texts))] == [e.ids for e in w.library.encode_batch(texts, add_special_tokens=False)]
    w = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    long = "Some words, and\tmore. " * 2000
    assert w.texts(pa.array([long, "a"]), longest=5000)[0].tolist() == w.library.encode(long, add_special_tokens=False).ids


def test_sentencepiece(docs, nothing):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_bpe.encode(docs, path, verify="texts")
    want = Counter((r["doc_id"], tuple(ids), library.decode(ids)) for r in docs.collect() for ids in [library.encode(r["text"] or "", add_bos=True, add_eos=True)])
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in got.collect()) == want
    assert {(r["doc_id"], r["text"]) for r in sentencepiece_bpe.decode(got, path).collect()} == {(a, c) for a, _, c in want}
    assert sentencepiece_bpe.encode(nothing, path).count() == 0
    v = sentencepiece_bpe.MergeVocabulary(path)
    long = "▁" + "abra" * 300
    assert v.encode_long(long) == library.encode("abra" * 300) == v.encode_rows([long])[0]


def test_suffix_dedup(docs, nothing):
    length = 60
    rows = docs.collect()
    data = [(r["text"] or "").encode() for r in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    want = Counter()
    for r, b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[r["doc_id"], sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(docs, length)
    assert Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(nothing, length).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_suffix_dedup_hashes_keep_doubled_strings_apart(spark):
    """Sums of powers modulo 2 ** 64 meet in a doubled string and its complement."""
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    for width, data in ((1, [x[:2048].encode() for x in (one, other)]), (8, [suffix_dedup.word_symbols(" ".join(x[:2048]).encode()) for x in (one, other)])):
        a, b = (suffix_dedup.Hashes(d, width) for d in data)
        at = np.array([0])
        for n in (512, 1024, 2000):
            assert a.of(at, at + n)[0] != b.of(at, at + n)[0]
    docs = spark.createDataFrame([(1, one[:1024]), (2, other[:1024])], "doc_id long, text string")
    assert {r["n_removed"] for r in suffix_dedup.remove_repeats(docs, 1024).collect()} == {0}


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """At 400 bytes, with texts of many pieces, a hot passage and doubled strings, against brute force."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)  # this process's; tasks keep theirs
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot, long = noise(500), noise(30_000)
    rows = [noise(rng.randint(0, 700)) + hot + noise(rng.randint(0, 700)) for _ in range(40)]
    rows += [long[:9000] + noise(50) + long[20_000:], noise(333) + long[4000:26_000], "x" * 3000, "x" * 399, "x" * 400, thue_morse(1024) + noise(9), thue_morse(900), long[100:499], long[100:500]]
    texts, length = [r.encode() for r in rows], 400
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    want = {}
    for k, b in enumerate(texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[k] = bytes(x for x, g in zip(b, gone) if not g)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, length).collect()} == want
    for width, data in ((1, texts[41]), (8, suffix_dedup.word_symbols(rows[41].encode()))):
        cut = [x.tolist() for x in suffix_dedup.anchors(data, 100, width)]
        monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 20)
        whole = [x.tolist() for x in suffix_dedup.anchors(data, 100, width)]
        monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
        starts = lambda rows: sorted((p - d, p) for p, low, high in zip(*rows[2:]) for d in range(low, high + 1))
        assert starts(cut) == starts(whole)


def test_suffix_dedup_by_words(docs):
    words, length = 9, 60
    rows = docs.collect()
    data = [(r["text"] or "").encode() for r in rows]
    runs = Counter(tuple(w[i : i + words]) for w in (b.split() for b in data) for i in range(len(w) - words + 1))
    inside = lambda s: max(0, len((b"x" + s + b"x").split()) - 2)
    strings = Counter(s for b in data for i in range(len(b) - length + 1) for s in [b[i : i + length]] if inside(s) < words)
    want = Counter()
    for r, b in zip(rows, data):
        gone, at, split = bytearray(len(b)), [], b.split()
        for w in split:
            at.append(b.index(w, at[-1] + len(split[len(at) - 1]) if at else 0))
        for i in range(len(split) - words + 1):
            if runs[tuple(split[i : i + words])] > 1:
                end = at[i + words - 1] + len(split[i + words - 1])
                gone[at[i] : end] = b"\1" * (end - at[i])
        for i in range(len(b) - length + 1):
            if strings[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[r["doc_id"], bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(docs, length, words=words)
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in got.collect()) == want


def test_pipeline_passages(spark):
    rng = random.Random(8)
    fresh = iter(rng.sample(range(1000, 10_000), 900))
    word = lambda: str(next(fresh)).translate(str.maketrans("0123456789", "abcdefghij"))
    passages = {n: [word() for _ in range(n)] for n in (50, 51, 64)}
    rows = []
    for n, p in passages.items():
        for join in (" ", "  \n"):
            rows.append((len(rows), " ".join(word() for _ in range(40)) + " " + join.join(p) + " " + " ".join(word() for _ in range(40))))
    rows += [(10 + i, "w" * i + "漢" * 200 + f" {i}") for i in range(2)]  # 600 bytes, one word
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    for i, (n, p) in enumerate((n, p) for n, p in passages.items() for _ in range(2)):
        left = got[i].split()
        assert len(left) == (130 if n == 50 else 80) and (p[0] in left, p[-1] in left) == (n == 50, n == 50)
    assert got[10] == "0" and got[11] == "w1"


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, nothing, width, percent):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 500)}" for _ in range(150)]
        for k in range(45 if g == 0 else 5):
            words = list(base)
            for _ in range(k % 6):
                words[rng.randrange(150)] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, rows[0][1].upper()), (901, "a b"), (902, "A  b"), (903, ""), (904, None), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(3)
    sets = {i: frozenset(setsketch.shingles(t or "", width).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b], again = label[a], True
    got = setsketch.near_duplicates(df, width, percent).collect()
    assert len(got) == len(rows) and all((r["component_id"], r["n_shingles"], r["kept"]) == (label[r["doc_id"]], len(sets[r["doc_id"]]), label[r["doc_id"]] == r["doc_id"]) for r in got)
    assert setsketch.near_duplicates(nothing).count() == 0


def test_block_links(spark):
    """Links between labels of a crowded bucket, whatever the blocks, connect what all pairs connect."""
    rng = random.Random(14)
    rows, sets = [], {}
    for g in range(6):
        base = rng.sample(range(10**6), 40)
        for k in range(60 if g == 0 else 12):
            members = sorted({*rng.sample(base, 40 - k % 4), *(rng.randrange(10**6) for _ in range(k % 4))})
            cls = len(rows)
            sets[cls] = set(members)
            # group 0 is one label; of the others two labels each, and all of group 4 labels of their own
            rows.append((7, 0, cls, 0 if g == 0 else cls if g == 4 else 1000 + 10 * g + k % 2, members))
    rows = [(b, len(rows), c, x, m) for b, _, c, x, m in rows]
    label = {c: x for _, _, c, x, _ in rows}
    df = spark.createDataFrame(rows, "bucket long, size long, cls long, label long, members array<long>").repartition(3)

    def joined(pairs):
        root = {x: x for x in label.values()}
        for a, b in pairs:
            old, new = root[label[a]], root[label[b]]
            root = {k: new if v == old else v for k, v in root.items()}
        return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))

    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = joined([(a, b) for a in sets for b in sets if a < b and label[a] != label[b] and linked(a, b)])
    for block in (16, 256):
        found = [(r["a"], r["b"]) for r in setsketch.block_links(df.drop("members"), df.select("cls", "members"), 80, block).collect()]
        assert all(linked(a, b) and label[a] != label[b] for a, b in found) and joined(found) == want


def test_near_duplicates_without_ids(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(150)] for _ in range(4)]
    near = [" ".join([*b[:-1], "other"]) for b in base]
    a, b, c, d = (" ".join(x) for x in base)
    rows = [(5, a), (None, near[0]), (None, b), (None, near[1]), (None, c), (7, d), (7, "quite another text"), (3, near[3]), (8, c + " x"), (8, c + " x"), (None, "alone here"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # a class that has only null ids is linked as well
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs, 5, 80).collect())
    assert got == Counter([(5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (None, 8, False), (7, 3, False), (7, 7, True), (3, 3, True), (8, 8, True), (8, 8, True), (None, None, True), (None, None, True)])
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    one_of = [k for k in kept if k in ((None, b), (None, near[1]))]
    assert len(one_of) == 1 and kept == Counter([(5, a), one_of[0], (7, "quite another text"), (3, near[3]), (8, c + " x"), (None, "alone here")])


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    assert (setsketch.merge(setsketch.sketch(a), setsketch.sketch(b)) == setsketch.sketch(np.union1d(a, b))).all()
    x, y = setsketch.sketch(a), setsketch.sketch(b)
    n = np.array([2000.0])
    assert abs(setsketch.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), n, n)[0] - 0.6) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}


def test_components_with_further_edges(spark):
    edges, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (31, 20)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    got = {r["node"]: r["label"] for r in setsketch.joined(connected_components(frame(edges)), frame(more)).collect()}
    assert got == {r["node"]: r["label"] for r in connected_components(frame(edges + more)).collect()}


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(i, f"http://a/{i}\r\nb%", f"page {i} " * 30) for i in range(40)] + [(50, "u", body), (51, None, body), (49, "u", body), (60, "u", "short"), (61, "u", "short"), (62, "u", None), (63, "u", None), (None, "u", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc_zstd.write(warc_zstd.mark_revisits(pages), archive_bytes=4000)
    got = warc_zstd.read(archives).collect()
    assert all(r["error"] is None for r in got)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kinds[49] == ("response", None, 203) and kinds[50] == kinds[51] == kinds[None] == ("revisit", 49, 203)
    assert kinds[60] == kinds[61] == ("response", None, 5) and kinds[62] == ("response", None, 0)
    assert {r["url"] for r in got} == {u or "" for _, u, _ in rows}
    whole = warc_zstd.make_archive([b"r%d" % i * 50 for i in range(300)])
    assert whole[:4] == warc_zstd.DICTIONARY_MAGIC and len(list(warc_zstd.read_archive(whole))) == 300
    broken = spark.createDataFrame([("x", bytearray(whole[:-3])), ("y", None)], "archive string, content binary")
    assert [r["error"] for r in warc_zstd.read(broken).collect() if r["error"].startswith("broken")] == ["broken archive: a frame is cut off"]
    assert warc_zstd.write(warc_zstd.mark_revisits(pages.limit(0))).count() == 0


def test_hamming_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))]
    vectors += [(400 + i, vectors[0][1]) for i in range(15)] + [vectors[5], (None, vectors[6][1]), (500, None), (501, [1.0])]
    codes = hamming_topk.sign_codes(spark.createDataFrame(vectors, "id long, v array<double>"), "id", "v", 64)
    got = hamming_topk.top_k(codes, codes.filter("id % 20 = 0"), 10, block_rows=70).collect()
    all_codes = [(i, np.array(v) > 0) for i, v in vectors if i is not None and v and len(v) == 64]
    for q, code in {i: c for i, c in all_codes if i % 20 == 0}.items():
        want = sorted((int((c ^ code).sum()), i) for i, c in all_codes if i != q)[:10]
        assert [(r["distance"], r["id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert hamming_topk.top_k(codes.limit(0), codes, 3).count() == 0


def test_language_id(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    model = language_id.fit(docs)
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0, False)
    empty = language_id.fit(nothing)
    assert empty.predict("abc")[0] == "und" and language_id.identify(nothing, empty).count() == 0


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 500, 70_000])
def test_mpeg_audio_round_trip(size):
    payload = mpeg_audio.pad_payload(b"z" * size)
    assert len(payload) % 192 == 0 and len(payload) >= max(192, size)
    data = mpeg_audio.write_stream(payload)
    s = mpeg_audio.read_stream(data)
    assert b"".join(s.ancillary) == payload and s.table_frames == s.frames and s.samples == 1152 * s.frames and (s.bad_checksums, s.skipped) == (0, 0)
    assert s.title == "text payload" and s.table_bytes == len(data) - len(mpeg_audio.TITLE)
    hurt = mpeg_audio.read_stream(data[:460] + b"junk\xff\xfb" + data[460:])
    assert hurt.skipped > 0 or size < 1


@pytest.mark.parametrize("before", [74, 314])
def test_mpeg_audio_tag_in_payload(spark, before, tmp_path):
    text = "a" * before + "TAG"
    payload = mpeg_audio.pad_payload(text.encode())
    data = mpeg_audio.write_stream(payload)
    assert data[-128:-125] == b"TAG"
    tag = b"TAG" + b"title\xff".ljust(125, b"\0")
    for stream, tags in ((data, ["id3v2.3"]), (data + tag, ["id3v2.3", "id3v1"])):
        s = mpeg_audio.read_stream(stream)
        assert b"".join(s.ancillary) == payload and (s.tags, s.skipped, s.bad_checksums, s.frames) == (tags, 0, 0, 1)
    cut = mpeg_audio.read_stream(mpeg_audio.write_stream(mpeg_audio.pad_payload(b"z" * 1152))[:-100] + tag)
    assert (cut.tags, cut.frames, cut.skipped) == (["id3v2.3", "id3v1"], 2, 380)
    spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["payload_bytes"] for r in QUERIES["op8_mpeg_audio"](spark, str(tmp_path)).collect()) == [192, len(payload)]


def bits_crc(bits):
    """A second reading of the checksum, over a text of bits."""
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1) ^ (0x8005 if (crc >> 15) != int(b) else 0)
        crc &= 0xFFFF
    return crc


def as_bits(data):
    return "".join(f"{x:08b}" for x in data)


@pytest.mark.parametrize("layer, mode", [(2, 0), (2, 1), (2, 3), (1, 0), (1, 1)])
def test_mpeg_audio_layers_one_and_two(layer, mode):
    """Protected frames by hand: MPEG-1 at 44.1 kHz, stereo, joint stereo (bound 8) and mono."""
    rng = random.Random(layer + mode)
    index, kbps = (10, 192) if layer == 2 else (6, 192)
    if mode == 3 and layer == 2:
        index, kbps = 6, 96
    length = 144 * kbps * 1000 // 44100 if layer == 2 else 12 * kbps * 1000 // 44100 * 4
    four = bytes([0xFF, 0xF8 | (4 - layer) << 1, index << 4, mode << 6 | 1 << 4])
    channels, bound = (1 if mode == 3 else 2), (8 if mode == 1 else 32)
    frames = []
    for _ in range(4):
        # tables of Layer II: 96 kbit/s a channel at 44.1 kHz has 30 subbands of 4, 3 and 2 bits
        widths = ([4] * 11 + [3] * 12 + [2] * 7) if layer == 2 else [4] * 32
        head, select = "", ""
        for band, width in enumerate(widths):
            for _ in range(channels if band < bound else 1):
                value = rng.randrange(1 << width)
                head += f"{value:0{width}b}"
                if value and layer == 2:
                    select += "".join(rng.choice("01") for _ in range(2 * (1 if band < bound else channels)))
        covered = as_bits(four[2:]) + head + select
        body = (head + select).ljust(8 * (length - 6), "0")
        frames.append(four + bits_crc(covered).to_bytes(2, "big") + int(body, 2).to_bytes(length - 6, "big"))
    s = mpeg_audio.read_stream(b"".join(frames))
    assert (s.frames, s.checked, s.bad_checksums, s.skipped, s.samples) == (4, 4, 0, 0, 4 * (1152 if layer == 2 else 384))
    assert s.offsets.tolist() == [i * length for i in range(4)]
    hurt = bytearray(b"".join(frames))
    hurt[2 * length + 7] ^= 16
    assert mpeg_audio.read_stream(bytes(hurt)).bad_checksums == 1


def frames_of(kbps, n, free=0, fill=b"\0"):
    """Layer III frames without checksum at 44.1 kHz; of free format if a length is given."""
    four = bytes([0xFF, 0xFB, (0 if free else mpeg_audio.KBPS[1, 3].index(kbps) + 1) << 4, 0])
    length = free or 144 * kbps * 1000 // 44100
    return (four + fill * (length - 4)) * n, length


def test_mpeg_audio_tags_and_tables():
    body, length = frames_of(128, 5)
    title = "t" * 200
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    text = b"\x03" + title.encode()
    frame = b"TIT2" + safe(len(text)) + b"\0\0" + text
    footed = b"ID3\x04\0\x10" + safe(len(frame)) + frame + b"3DI\x04\0\x10" + safe(len(frame))
    s = mpeg_audio.read_stream(footed + body)
    assert (s.title, s.tags, s.frames, s.skipped, s.offsets[0]) == (title, ["id3v2.4"], 5, 0, len(footed))
    raw = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0\xff\xe9a"  # latin-1, as it was before unsynchronisation
    loose = raw.replace(b"\xff", b"\xff\0")
    s = mpeg_audio.read_stream(b"ID3\x03\0\x80" + safe(len(loose)) + loose + body)
    assert (s.title, s.frames) == ("ÿéa", 5)
    old = b"TT2" + (4).to_bytes(3, "big") + b"\0old"
    assert mpeg_audio.read_stream(b"ID3\x02\0\0" + safe(len(old)) + old + body).title == "old"
    import struct

    vbri = bytearray(body[:length])
    vbri[36 : 36 + 26] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 5 * length, 4, 3, 2, 2, 1)
    vbri[62:68] = struct.pack(">HHH", 100, 150, 50)
    s = mpeg_audio.read_stream(bytes(vbri) + body[: 4 * length])
    assert (s.table_frames, s.table_bytes, s.frames, s.seek.tolist()) == (4, 5 * length, 4, [200, 500, 600])
    made = mpeg_audio.read_stream(mpeg_audio.write_stream(mpeg_audio.pad_payload(b"z" * 90_000)))
    starts = made.offsets - len(mpeg_audio.TITLE)
    assert len(made.seek) == 100 and all((starts <= x + made.table_bytes // 256 + 1).any() and x < made.table_bytes for x in made.seek.tolist())


def test_mpeg_audio_free_format_and_foreign_headers():
    body, length = frames_of(0, 4, free=700)
    s = mpeg_audio.read_stream(b"junk" + body)
    assert (s.frames, s.skipped, s.offsets.tolist()) == (4, 4, [4 + 700 * i for i in range(4)])
    # a header that one of another rate follows is not confirmed
    real, length = frames_of(128, 3)
    lone = bytes([0xFF, 0xFB, 0x90, 0]) + b"\0" * (length - 4)
    other = bytes([0xFF, 0xFB, 0x94, 0]) + b"\0" * (144 * 128 * 1000 // 48000 - 4)
    s = mpeg_audio.read_stream(lone + other * 3)
    assert s.hz == 48000 and s.frames == 3 and s.skipped == length


def test_mpeg_audio_columns(docs, nothing):
    rows = mpeg_audio.read(mpeg_audio.store(docs), keep=("n_bytes",)).collect()
    want = Counter((r["doc_id"], mpeg_audio.pad_payload((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["payload"])) for r in rows) == want
    assert mpeg_audio.store(nothing).count() == 0 and mpeg_audio.feature(mpeg_audio.read_stream(b"")).startswith("samples=0")


def test_quality(spark, docs, nothing):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    rows = QUERIES["op9_quality"](spark, sf).join(labels, "doc_id").collect()
    assert sum(r["accepted"] == bool(r["label"]) for r in rows) / len(rows) > 0.95
    assert sum(not r["accepted"] for r in rows if not r["label"]) / sum(not r["label"] for r in rows) > 0.9
    models = weak_quality.fit(docs)
    got = weak_quality.classify(docs, models).collect()
    assert len(got) == docs.count() and all(not r["accepted"] for r in got if r["doc_id"] in (64, 65, 66))
    assert weak_quality.classify(nothing, weak_quality.fit(nothing)).count() == 0


def test_label_model_keeps_kinds_of_junk_apart_from_good_texts():
    """Two kinds of bad texts, each of which most labellers call good; the smaller one stays bad whatever its share."""
    for repeated in (10, 40, 90):
        patterns = {"11111111": 860 - repeated, "1111-111": 20, "0-00-111": 45, "00-10111": 40, "11111-00": repeated // 2, "11111000": repeated // 2, "--------": 3}
        m = weak_quality.fit_labels(patterns)
        assert [m.of(p) > 0.5 for p in ("11111111", "1111-111", "0-00-111", "00-10111", "11111-00", "11111000")] == [True, True, False, False, False, False]
        assert (m.bad_of_good <= 0.02).all() and 0.7 < m.prior < 0.95 and (m.accuracy > 0.5).all()
    assert weak_quality.fit_labels({}).prior == 0.85


def test_quality_of_long_texts(spark):
    """Texts of any length train; without any sample the label model decides."""
    good = lambda i: " ".join(f"Word{(i * j) % 89} follows the river and light number {j}." for j in range(400))
    rows = [(i, good(i)) for i in range(30)] + [(100 + i, " ".join("# @@ %%% $$ &" for _ in range(1500 + i))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("mine")).withColumn("votes", F.lit(1))
    models = weak_quality.fit(docs)
    assert models[1].trained > 0
    for m in (models, (models[0], weak_quality.fit_scorer([]))):
        got = {r["doc_id"]: r["accepted"] for r in weak_quality.classify(docs, m, keep=("doc_id", "quality")).collect()}
        assert all(got[i] == (i < 100) for i, _ in rows)
    again = weak_quality.fit_scorer([("a b c", 0.5), ("a b c", 0.5)])  # ties say nothing
    assert 0 < again.score("a b c") < 1


def test_language_of_long_texts(spark):
    english, french = "the river and the stone were there when we came to the old house ", "les rivières et la pierre où nous étions près de cette maison ancienne "
    rows = [(i, french * (200 + i), "fr") for i in range(20)] + [(100 + i, english * (1 + i % 3), "en") for i in range(60)] + [(500, "\U00030000\U00030001", "xx"), (None, english, "en"), (7, english, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    model = language_id.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model, keep=("doc_id", "score")).collect()}
    assert {(i, "fr") for i in range(20) if i != 7} | {(100 + i, "en") for i in range(60)} <= got
    assert len(language_id.ngram_buckets("\U00030000", 16)) and "xx" in model.langs


def test_pipeline_keeps_columns(spark):
    """Extra columns named as results are, null ids and rows that share an id stay."""
    words = "the river stone of an old house where light came down upon every field and road until evening".split()
    rng = random.Random(12)
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, k=60)).capitalize() + ".", "en", "s", 1, 0.5, "q", True, 3, "v") for i in range(60)]
    rows += [(5, " ".join(rng.choices(words, k=60)).capitalize() + ".", "en", "s", 1, 0.5, "q", True, 3, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, quality string, kept boolean, first_id long, row string").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.filter("score = 0.5 and quality = 'q' and kept and first_id = 3 and row = 'v'").count() == len(rows)
        docs = out
    assert docs.filter("doc_id is null").count() == 7 and docs.filter("doc_id = 5").count() == 2
    assert corpus_pipeline.pack(spark, docs, "").count() >= len(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1?x", "HTTP://EXAMPLE.COM/en/77", "https://x.net/de/8", "https://example.net/de/81#z", "https://org/es/", "ftp://q.io", None, "no scheme", "http://spam.io/pills/1", "http://notcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, f"http://spam.io/pills/{i}" if i % 3 == 1 else f"http://fine.io/news/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, int(i % 3 != 1), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge(pages, labels, STATED_RULES).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(10)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[7]["path"]) == ("a.example.com", "/en/1", "", "")
    assert url_rules.judge(pages, labels.limit(0), STATED_RULES).filter("verdict = 'block'").count() == 4


def test_url_rules_have_the_words_of_the_contract(spark, tmp_path):
    """Of the contract's list net/de/ allows, against a mined rule too, and example.net/de/8 blocks."""
    urls = ["http://a.com/en/", "http://example.com/en/71", "http://net/de/", "http://x.net/de/8", "http://example.net/de/7", "http://b.example.net/de/81", "http://org/es/1"]
    spark.createDataFrame([*enumerate(urls), *((100 + i, f"http://spam{i}.net/de/{i}") for i in range(20))], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(100 + i, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op10_url_rules"](spark, str(tmp_path)).collect()}
    de = ("net/de/", "allow")
    assert [got[i] for i in range(7)] == [("com/en/", "block"), ("example.com/en/7", "allow"), de, de, de, ("example.net/de/8", "block"), ("org/es/", "block")]
    assert {got[100 + i] for i in range(20)} == {de}


@pytest.mark.parametrize("rows, support", [(12, 0.002), (900, 0.002), (200, 0.02)])
def test_url_rules_mined(spark, rows, support):
    from itertools import combinations

    rng = random.Random(rows)
    data = []
    for i in range(rows):
        tokens = {"http", "#", *rng.sample("abcde", 2), *(("utm", "feed") if rng.random() < 0.3 else ())} | ({"rare", "host"} if i in (1, 2, 3) else set())
        data.append((sorted(tokens), i in (1, 2, 3) or rng.random() < (0.7 if "a" in tokens else 0.1)))
    least, n, b = max(1, -(-rows * support // 1)), Counter(), Counter()
    for tokens, block in data:
        for k in range(1, len(tokens) + 1):
            for c in combinations(tokens, k):
                n[c] += 1
                b[c] += block
    sure = {frozenset(c): b[c] / n[c] for c in n if b[c] >= least and b[c] / n[c] >= 0.5}
    want = {(" ".join(sorted(s)), round(p, 9), round(b[tuple(sorted(s))] / rows, 9)) for s, p in sure.items() if not any(frozenset(c) in sure and sure[frozenset(c)] >= p for k in range(1, len(s)) for c in combinations(s, k))}
    got = url_rules.mine(spark.createDataFrame([*data, (["x"], None), ([], True)], "tokens array<string>, block boolean"), support).collect()
    assert {(r["rule_id"], round(r["confidence"], 9), round(r["support"], 9)) for r in got} == want and len(got) == len(want)
    assert (support > 0.01) or {"rare", "host"} <= {r["rule_id"] for r in got}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) & {"decoded_texts", "undetermined_texts", "stored_payloads", "stated_url_rules", "op4_warc", "op6_hamming_topk"}))
def test_against_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    rows = QUERIES[name](spark, sf).select(*want.columns).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall()) and rows


def test_clashing_columns(spark):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "http://a.io/x", body, 9, "d", "t"), (2, None, body, 9, "d", "t"), (2, None, body, 9, "d", "t")], "page_id long, url string, html string, first_id long, payload_digest string, record_type string")
    marked = warc_zstd.mark_revisits(pages)
    assert [(r["record_type"], r["refers_to"], r["first_id"]) for r in marked.orderBy("page_id").collect()] == [("response", None, 9), ("revisit", 1, 9), ("revisit", 1, 9)]
    assert warc_zstd.read(warc_zstd.write(marked)).filter("error is null").count() == 3
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = url_rules.judge(pages.withColumns({"host": F.lit("h"), "block": F.lit(1), "rule": F.lit("r")}), labels, STATED_RULES)
    assert judged.count() == 3 and judged.filter("page_id = 1").first()["host"] == "a.io"
    codes = hamming_topk.sign_codes(spark.createDataFrame([(i, [float(i % 3) - 1] * 16, "s", 1) for i in range(9)], "id long, v array<double>, code string, shard int"), "id", "v", 16)
    got = hamming_topk.top_k(codes.withColumns({"block": F.lit(1), "rank": F.lit(2)}), codes.withColumn("shard", F.lit(3)), 2).collect()
    assert len(got) == 18 and {r["rank"] for r in got} == {1, 2}
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, payload string, media string")
    assert mpeg_audio.read(mpeg_audio.store(docs)).count() == 1 and mpeg_audio.read(mpeg_audio.store(docs).withColumn("payload", F.lit(1)), keep=("payload",)).columns.count("payload") == 1


def components(sets, percent):
    label = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                if a != b and label[a] < label[b] and (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b]):
                    label[b], again = label[a], True
    return label


def without_repeats(texts, words, length):
    """Texts less their runs of so many words, and their strings of so many bytes with fewer words, that stand more than once."""
    data = [t.encode() for t in texts]
    runs = Counter(tuple(w[i : i + words]) for w in (b.split() for b in data) for i in range(len(w) - words + 1))
    strings = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone, places, at = bytearray(len(b)), [], 0
        for w in b.split():
            at = b.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        split = b.split()
        for i in range(len(split) - words + 1):
            if runs[tuple(split[i : i + words])] > 1:
                a, z = places[i][0], places[i + words - 1][1]
                gone[a:z] = b"\1" * (z - a)
        for i in range(len(b) - length + 1):
            if strings[b[i : i + length]] > 1 and len((b"x" + b[i : i + length] + b"x").split()) - 2 < words:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_pipeline_against_brute_force(spark):
    """Each stage on what its predecessor kept."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {name: None for name, _ in corpus_pipeline.STAGES}
    frame = raw
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        docs[name] = frame.collect()
        frame = spark.createDataFrame(docs[name], frame.schema).repartition(3)
    before = {r["doc_id"]: r["text"] for r in docs["quality"]}
    sets = {i: frozenset(setsketch.shingles(t, 5).tolist()) for i, t in before.items()}
    label = components(sets, 80)
    assert {r["doc_id"] for r in docs["near_dedup"]} == {i for i in sets if label[i] == i}
    kept = sorted((r["doc_id"], r["text"]) for r in docs["near_dedup"])
    want = dict(zip((i for i, _ in kept), without_repeats([t for _, t in kept], 51, 400)))
    assert {r["doc_id"]: r["text"] for r in docs["suffix_dedup"]} == want and all(r["n_chars"] == len(r["text"]) for r in docs["suffix_dedup"])
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = {}
    for r in docs["packing"]:
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in want.items()}
    # language and quality leave nearly all documents that are labelled good
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()} & {r["doc_id"] for r in raw.collect()}
    assert len(good - {r["doc_id"] for r in docs["quality"]}) <= 0.02 * len(good)


def test_very_long_texts(spark):
    """A text of some MB among short ones, with a near copy and a passage in common with another."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near = list(words)
    near[777] = near[100_000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[5000:5100])), (4, "short one"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs, 400).collect()}
    assert got[3] == (len(rows[2][1]), 1) and got[2][1] == 3 and got[4] == got[5] == (0, 0)
    model = language_id.train([("the river and the stone", "en"), ("les rivières et la pierre", "fr")] * 20)
    assert language_id.identify(docs, model).count() == 5 and weak_quality.classify(docs, weak_quality.fit(docs)).count() == 5


def test_url_rules_with_repeated_labels_and_long_urls(spark):
    urls = [(i, f"http://bad{min(i % 4, 1)}.io/x/{i}") for i in range(40)] + [(90, "http://bad0.io/" + "a/" * 50_000), (91, ""), (92, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(0, 40, 4)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, []).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(40)) and got[90] == "block" and got[91] == got[92] == "allow"


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept = docs.count()
        assert kept <= n
        n = kept
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == n
