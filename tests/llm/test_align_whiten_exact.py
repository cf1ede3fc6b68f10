"""Alignment, whitening and exact deduplication against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelaw.llm import alignment, trie_dedup, whitening
from gaugelaw.llm.queries import DEVIATION_SQL, OP13_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
CLASHES = "doc_id long, text string, row string, id string, pairs string, n string, hash string, best string, n_bytes string"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], CLASHES).repartition(4)


def odd_texts(n=150, seed=4):
    rng = random.Random(seed)
    signs = [*"abZ the',.  \n\t\0éüİΣς漢🙂́½!?ª_0123²", "<|endoftext|>", "</s>", "'s", "ing", "    "]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(0, 80)))) for i in range(n)]
    return [*rows, rows[3], (1000, rows[5][1]), (1001, None), (1002, ""), (1003, "a ▁ b"), (None, "Some words again"), (1004, "long words and " * 3000 + "x" * 4000)]


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    counts, found = Counter(), []
    for i, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        groups = []
        if t and b"".join(map(of_a, x)) == raw == b"".join(map(of_b, y)):
            ends = [np.cumsum([len(of(k)) for k in ids]).tolist() for of, ids in ((of_a, x), (of_b, y))]
            low = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                groups.append(tuple([k for k, e in zip(ids, end) if low < e <= cut] for ids, end in zip((x, y), ends)))
                low = cut
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        counts.update(links.keys())
        found.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    for i, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (
            i, n_a, n_b, len(groups), links.total(), sum(m for k, m in links.items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("frequent", [500_000, 300, 1])
def test_alignment(spark, frequent):
    """All pairs sent, some sent, all but the commonest joined."""
    rows = [r for r in odd_texts() if r[0] != 1004] + [(1004, "long words and " * 100 + "x" * 300)]
    got = alignment.align(frame(spark, rows), A, B, frequent=frequent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_alignment(rows))


def test_alignment_lanes():
    """Lanes of a long text, its parts shorter than a group, and one lane for each text give the same."""
    texts = [t for _, t in odd_texts()] + ["漢字" * 2000, " " * 3000, "\n" * 2000]
    want = alignment.Aligner(A, B, lane=10**9).batch(texts)
    for lane in (1, 3, 64):
        got = alignment.Aligner(A, B, lane=lane).batch(texts)
        assert got.digests == want.digests and all((g == w).all() for g, w in zip((*got[:4], *got[5:]), (*want[:4], *want[5:])))


def test_alignment_of_large_groups():
    """Groups with many tokens on both sides, in one piece and by counts of equal ids."""
    x = alignment.Aligner(A, B)
    rng = np.random.default_rng(1)
    ids_a, ids_b = rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    groups = alignment.Groups(*(np.array(v) for v in ([0, 100, 101], [100, 101, 400], [0, 250, 251], [250, 251, 300])))
    want = [p.tolist() for p in x._pairs(ids_a, ids_b, groups, np.array([2, 0, 1]))]
    for most in (1, 1000, 20_000):
        assert [p.tolist() for p in x._pairs(ids_a, ids_b, groups, np.array([2, 0, 1]), most)] == want
    assert sum(want[2]) == 100 * 250 + 1 + 299 * 49


def test_byte_level_against_library():
    """The fast encoder and the library agree; a file with a normaliser has the library alone."""
    a = alignment.ByteLevel(A)
    texts = [" " + t for _, t in odd_texts(2000, seed=9) if t] + ["".join(random.Random(k).choices("etaoinshrdlu", k=25)) for k in range(5000)]
    ids, counts = a.encode(texts)
    assert a.fast is not None and ids.tolist() == [i for e in a.library.encode_batch(texts, add_special_tokens=False) for i in e.ids] and counts.sum() == len(ids)


def test_alignment_of_nothing(spark):
    assert alignment.align(frame(spark, odd_texts()).limit(0), A, B).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(frame(spark, [(1, None), (2, "")]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def dense(v):
    x = np.unique(np.floor(256 * np.array(v, float)), axis=0)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((48, 48)) * np.linspace(2, 0.2, 48)
    v = (rng.standard_normal((300, 48)) @ mix).astype(np.float32).tolist()
    v[7] = v[9]
    bad = [None, [float("nan")] * 48, [1.0] * 47 + [None], [float("inf")] * 48, [1.0] * 5, [], [1e30] * 48]
    data = [(i, x, "p", "q", "r") for i, x in enumerate([*v, *bad])] + [(None, v[0], "", "", ""), (3, v[3], "", "", "")]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, x string, id string, component string").repartition(3)
    got = whitening.whiten(rows).collect()
    x, values, vectors = dense(v)
    n = len(x)
    total = x.sum(0)
    assert len(got) == 4 * 302 and {r["n"] for r in got} == {n} and all(r["certified"] for r in got)
    sign = {}
    for r in got:
        k, own = r["component"] - 1, np.floor(256 * np.array(v[r["vec_id"] or 0], float))
        want = (own - x.mean(0)) @ vectors[:, k] / np.sqrt(values[k])
        sign.setdefault(k, np.sign(want * r["whitened"]))
        assert abs(r["whitened"] - sign[k] * want) < 1e-9 and abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-10
        assert int(r["deviation"]) == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, total)) and r["identity_error"] < 1e-9


def test_whitening_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)] * 2
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], abs(r["whitened"]) if r["whitened"] is not None else None) for r in two} == {(1, 1, 1.0), (2, 1, 1.0), (1, 2, None), (2, 2, None)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 3.0])], schema)).collect()
    apart = 256 * int(np.float32(1e15)) * 2
    assert {int(r["deviation"]) for r in huge} == {apart**2 + 768**2}


@pytest.mark.parametrize("name, v", [
    ("flat", np.diag(np.linspace(1, 1.1, 80))), ("equal", np.eye(60)), ("tie at the end", np.diag([5.0] * 3 + [2.0] * 4 + [1.0] * 60)), ("rank two", np.diag([3.0, 1.0] + [0.0] * 60)),
    ("falling", np.diag(2.0 ** -np.arange(70))), ("one far off", np.diag([1e9, *np.linspace(2, 1, 70)])), ("small", np.diag([3.0, 2.0])), ("hundreds", np.diag(np.linspace(1, 3, 400))),
])
def test_components(name, v):
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal(v.shape))[0]
    v = turn @ v @ turn.T
    e, q, certified = whitening.top_components(lambda x: v @ x, len(v), np.trace(v))
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(4, len(v)) and np.abs(e - want).max() <= 1e-12 * want[0] and np.abs(v @ q - q * e).max() <= 1e-11 * want[0]
    assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12 and certified == (name != "equal")


def test_probes_find_what_the_block_has_missed():
    """A block that starts without the largest component must not be certified with the others."""
    rng, v = np.random.default_rng(5), np.diag([9.0, *np.linspace(2, 1, 63)])
    g = rng.standard_normal((64, whitening.PROBES))
    y = whitening.chebyshev(lambda x: v @ x, g, 1.0, 1.6, 1.9, 10, lambda x: x)
    assert np.linalg.norm(y, axis=0).min() > 1


def exact(rows, pick=min):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    for i, t in rows:
        text = (t or "").encode().lower()
        ids = [x for x in groups[text] if x is not None]
        best = pick(ids) if ids else None
        yield i, best, len(groups[text]), i is not None and i == best, len(text), hashlib.sha256(text).hexdigest()


def copies(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abAB é漢İ", k=rng.randint(0, 12))) for _ in range(150)]
    rows = [(i, rng.choice(base)) for i in range(500)] + [(600, None), (601, ""), (602, "w" * 400_000), (603, "W" * 400_000), (604, "w" * 399_999), (5, "a"), (5, "a"), (None, "a"), (None, "never seen"), (None, "NEVER seen")]
    return rows


@pytest.mark.parametrize("most, content_hash", [(64_000_000, F.xxhash64), (3000, F.xxhash64), (64_000_000, lambda c: F.lit(1)), (4000, lambda c: F.length(c) % 2), (1500, lambda c: F.lit(7))])
def test_exact_groups(spark, most, content_hash):
    """Tries that hold all, tries that give up subtrees again and again, and hashes that tell nothing."""
    rows = copies()
    for keep, pick in (("smallest", min), ("largest", max)):
        got = trie_dedup.exact_groups(frame(spark, rows), keep=keep, most=most, content_hash=content_hash).collect()
        assert Counter(map(tuple, got)) == Counter(exact(rows, pick))


def test_exact_groups_of_one_crowded_hash(spark, monkeypatch):
    """Many rounds, as a trie holds few of the texts with one length and hash: their tasks follow what is left."""
    docs, parts = frame(spark, [(i, f"{i % 16:02d}" * 5) for i in range(20)]), []
    real = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: parts.append(n) or real(self, n, *cols))
    got = trie_dedup.exact_groups(docs, most=1500, content_hash=lambda c: F.lit(7)).collect()
    assert Counter(map(tuple, got)) == Counter(exact([(i, f"{i % 16:02d}" * 5) for i in range(20)], min))
    assert len(parts) > 4 and max(parts[1:]) <= 4 * (20 * (10 + trie_dedup.HEAD + trie_dedup.NODE) // 1500 + 1)


def test_exact_groups_of_other_kinds(spark):
    assert trie_dedup.exact_groups(frame(spark, copies()).limit(0)).collect() == []
    rows = spark.createDataFrame([("b", "X"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert {tuple(r)[:4] for r in trie_dedup.exact_groups(rows).collect()} == {("b", "a", 2, False), ("a", "a", 2, True), ("c", "c", 1, True)}
    assert {tuple(r)[:3] for r in trie_dedup.exact_groups(rows, ignore_case=False).collect()} == {("b", "b", 1), ("a", "a", 1), ("c", "c", 1)}


def test_trie():
    rng = random.Random(8)
    trie, want = trie_dedup.PatriciaTrie(trie_dedup.smaller), {}
    left = []
    for i in range(3000):
        key = bytes(rng.choices(b"ab", k=rng.randint(16, 30)))
        trie.insert(key, i, 1)
        best, n = want.get(key, (i, 0))
        want[key] = (min(best, i), n + 1)
        if i % 500 == 499:
            left += trie.give_up(forget=True)[1]
    assert [k for k, *_ in trie.walk()] == sorted(k for k, *_ in trie.walk())
    found = defaultdict(lambda: [10**9, 0])
    for k, best, n in [*left, *trie.walk()]:
        found[k] = [min(found[k][0], best), found[k][1] + n]
    assert {k: tuple(v) for k, v in found.items()} == want
    above, gone = trie.give_up()
    gone = list(gone)
    assert gone and not trie.insert(gone[0][0], 1, 1) and not any(k == gone[0][0] for k, *_ in trie.walk())
    sizes = lambda node: len(node[0]) + (trie_dedup.NODE if node is not trie.root else 0) + sum(map(sizes, node[1].values()))
    assert trie.size == sizes(trie.root)


def test_queries(spark):
    """The registered queries over the smallest tables, by SQL and by brute force."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in (("op13_exact_dedup", OP13_SQL), ("vector_deviations", DEVIATION_SQL)):
        want = con.sql(sql)
        assert Counter(map(tuple, QUERIES[name](spark, SF).select(want.columns).collect())) == Counter(want.fetchall())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_alignment"](spark, SF).collect())) == Counter(brute_alignment(rows))
