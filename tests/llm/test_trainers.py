"""The trained models against plain loops, and the edge cases of operators and pipeline that their own tests leave out."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugelaw.llm import hamming_topk, language_id, mpeg_audio, packing, sentencepiece_bpe, trie_dedup, url_rules, warc_zstd, weak_quality
from gaugelaw.llm.queries import STATED_RULES, tokenizer_path


def plain_labels(texts, rounds=300, prior=0.85, start=(0.005, 0.3), most_wrong=0.02, least_found=0.05):
    """Expectation-maximisation text by text, in Python numbers."""
    k = len(weak_quality.LABELLERS)
    good, bad = [start[0]] * k, [start[1]] * k

    def posterior(v):
        odds = math.log(prior / (1 - prior))
        for x, g, b in zip(v, good, bad):
            odds += 0 if x == "-" else math.log(g / b) if x == "0" else math.log((1 - g) / (1 - b))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        q = [posterior(v) for v in texts]
        new = []
        for weights, s, low, high in ((q, start[0], 1e-4, most_wrong), ([1 - x for x in q], start[1], least_found, 0.95)):
            share = []
            for j in range(k):
                said = sum(w for w, v in zip(weights, texts) if v[j] == "0")
                cast = sum(w for w, v in zip(weights, texts) if v[j] != "-")
                share.append(min(max((said + 10 * s) / (cast + 10), low), high))
            new.append(share)
        prior = min(max((sum(q) + 1) / (len(q) + 2), 0.01), 0.99)
        moved = max(abs(a - b) for old, now in ((good, new[0]), (bad, new[1])) for a, b in zip(old, now))
        good, bad = new
        if moved < 1e-6:
            break
    return prior, good, bad, {v: posterior(v) for v in texts}


def test_label_model_against_a_loop():
    rng = random.Random(4)
    k = len(weak_quality.LABELLERS)
    texts = ["".join(rng.choices("01-", (0.5, 0.2, 0.3) if i % 5 == 0 else (0.01, 0.6, 0.39), k=k)) for i in range(400)]
    m = weak_quality.fit_labels(dict(Counter(texts)))
    prior, good, bad, posterior = plain_labels(texts)
    assert m.prior == pytest.approx(prior, rel=1e-9) and m.bad_of_good == pytest.approx(good, rel=1e-9) and m.bad_of_bad == pytest.approx(bad, rel=1e-9)
    assert m.posterior == pytest.approx(posterior, rel=1e-9)


def test_scorer_against_a_loop():
    """Gradient descent written out bucket by bucket."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["river", "stone", "Light"], k=12)), 0.9) if i % 3 else ("".join(rng.choices("#$%&QX 9", k=60)) + " x", 0.1) for i in range(60)]
    s = weak_quality.fit_scorer(rows, bits=10, epochs=3)
    weights, extra = [0.0] * 1024, [0.0] * 3
    texts = []
    for text, good in rows:
        c = Counter(weak_quality.shape_buckets(text, 10).tolist())
        texts.append(({b: n / sum(c.values()) for b, n in sorted(c.items())}, weak_quality.Scorer.shares(text).tolist(), good))
    bad = sum(1 - g for *_, g in texts)
    weigh = min(max((len(texts) - bad) / bad, 0.1), 20.0)
    order = np.random.default_rng(3)
    for epoch in range(3):
        step = 4.0 / (1 + epoch)
        for j in order.permutation(len(texts)):
            shares, more, y = texts[j]
            z = sum(weights[b] * x for b, x in shares.items()) + sum(a * b for a, b in zip(extra, more))
            g = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * (y + (1 - y) * weigh)
            g = max(-4, min(4, g))
            for b, x in shares.items():
                weights[b] -= step * 10 * g * x
            extra = [e - 0.5 * step * g * v for e, v in zip(extra, more)]
    assert s.trained == 60 and s.weights == pytest.approx(weights, rel=1e-4, abs=1e-5) and s.extra == pytest.approx(extra, rel=1e-4, abs=1e-5)


def test_language_training_against_a_loop():
    """The same draws, with embeddings, softmax and gradients written out."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choices(w, k=9)), lang) for lang, w in (("aa", ["river", "stone", "of"]), ("bb", ["fluss", "stein", "von"]), ("cc", ["rivière", "pierre", "de"])) for _ in range(25)]
    m = language_id.train(rows, bits=8, width=4, epochs=2)
    draws = np.random.default_rng(7)
    E, W = draws.normal(0, 0.1, (256, 4)).astype(np.float32).astype(float).tolist(), draws.normal(0, 0.1, (4, 3)).astype(np.float32).astype(float).tolist()
    bias = [0.0] * 3
    bags = []
    for text, lang in rows:
        c = Counter(language_id.ngram_buckets(text, 8).tolist())
        bags.append(({b: n / sum(c.values()) for b, n in c.items()}, ("aa", "bb", "cc").index(lang)))
    order = draws.permutation(len(bags))
    fit = order[int(len(bags) * 0.25) :]
    for epoch in range(2):
        step = 0.5 * (1 - epoch / 2)
        for j in draws.permutation(fit):
            bag, y = bags[j]
            x = [sum(w * E[b][d] for b, w in bag.items()) for d in range(4)]
            z = [sum(x[d] * W[d][c] for d in range(4)) + bias[c] for c in range(3)]
            p = [math.exp(v - max(z)) for v in z]
            g = [v / sum(p) - (c == y) for c, v in enumerate(p)]
            back = [sum(W[d][c] * g[c] for c in range(3)) for d in range(4)]
            W = [[W[d][c] - step * x[d] * g[c] for c in range(3)] for d in range(4)]
            bias = [b - step * v for b, v in zip(bias, g)]
            for b, w in bag.items():
                E[b] = [e - min(step * 20 * w, 0.5) * v for e, v in zip(E[b], back)]
    product = [[sum(e[d] * W[d][c] for d in range(4)) for c in range(3)] for e in E]
    assert m.langs == ["aa", "bb", "cc"] and np.abs(m.weights - np.array(product)).max() < 2e-3 and np.abs(m.bias - np.array(bias)).max() < 2e-3
    assert 0 <= m.reject_below <= 0.5


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_nothing(spark, monkeypatch):
    """Every stage, and all of them together, on a table without rows and on one of nulls and empty texts."""
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "   ", None, None, 3)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        monkeypatch.setattr(corpus_pipeline, "table", lambda *_, d=docs: d)
        assert corpus_pipeline.run(spark, "nowhere").count() == 0


def test_operators_on_nothing(spark):
    codes = hamming_topk.sign_codes(spark.createDataFrame([(1, [1.0] * 8), (2, [-1.0] * 8)], "id long, v array<float>"), "id", "v", 8)
    assert hamming_topk.top_k(codes, codes.limit(0), k=3).count() == 0 and hamming_topk.top_k(codes.limit(0), codes, k=3).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert url_rules.judge(pages, labels, STATED_RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/en/x", "")], "page_id long, url string, html string")
    assert url_rules.judge(some, labels.limit(0), STATED_RULES).first()["verdict"] == "block"
    assert warc_zstd.read(warc_zstd.write(warc_zstd.mark_revisits(pages))).count() == 0


def test_texts_of_several_megabytes(spark):
    """Whole texts of over three million bytes go through packing, WARC, encoding, media columns and tries beside small and equal ones."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    big = "Light on the river, 42 stones; " * 110_000
    docs = spark.createDataFrame([(1, big), (2, big.upper()), (3, "small"), (4, None)], "doc_id long, text string").repartition(2)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html"))
    ids = {i: np.array([*Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in ((1, big), (3, "small"), (4, None))}
    pieces = {}
    for r in packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(x for _, x in sorted(pieces[i])) for i in ids} == ids
    got = {r["page_id"]: (r["payload_bytes"], r["error"]) for r in warc_zstd.read(warc_zstd.write(warc_zstd.mark_revisits(pages))).collect()}
    assert got == {1: (len(big), None), 2: (len(big), None), 3: (5, None), 4: (0, None)}
    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    encoded = {r["doc_id"]: r["n"] for r in sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), bos=False, eos=False).select("doc_id", (F.length("ids") / 4).cast("int").alias("n")).collect()}
    assert encoded[1] == len(library.encode(big)) and encoded[3] == len(library.encode("small")) and encoded[4] == 0
    media = mpeg_audio.read(mpeg_audio.store(docs), keep=("n_bytes",)).select("doc_id", "n_bytes", F.sha2(F.expr("substring(payload, 1, n_bytes)"), 256).alias("h")).collect()
    assert {(r["doc_id"], r["n_bytes"]) for r in media} == {(1, len(big)), (2, len(big)), (3, 5), (4, 0)} and len({r["h"] for r in media}) == 4
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in trie_dedup.exact_groups(docs).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
