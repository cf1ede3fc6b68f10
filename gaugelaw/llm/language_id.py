"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are its character n-grams (2 to 4) over lower-case letters, with one blank for
each run of other characters, hashed to buckets. The mean of their embeddings goes through a
softmax. Both layers are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows; the parts of a fixed share set aside give the softmax temperature and the confidence
under which a prediction is rejected. Prediction runs over whole texts inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Bags, in_one_task, materialise, slices

UND = "und"


@cache
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def ngram_buckets(text: str, bits: int) -> np.ndarray:
    """Buckets of the n-grams of a whole text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, points, 32).astype(np.uint32)
    c = np.concatenate(([32], c[np.concatenate(([True], letter[1:] | letter[:-1]))], [32])).astype(np.uint32)
    out = []
    h = c * np.uint32(0x9E3779B1)
    for n in range(2, 5):
        if len(c) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0x9E3779B1)
        out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """weights: the product of embeddings and softmax layer, a row for each bucket."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, accepted); "und" if there is no letter or nothing was learned."""
        found = ngram_buckets(text, self.bits) if text and self.langs else ()
        if not len(found):
            return UND, 0.0, False
        z = (self.weights[found].mean(0, dtype=np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.reject_below)


def train(
    rows: Iterable[tuple[str, str]], bits: int = 16, width: int = 16, epochs: int = 6, rate: float = 0.5, held: float = 0.25, reject_share: float = 0.001, seed: int = 7
) -> Model:
    """A model from rows (text, language); texts without a letter don't count. reject_share: of rightly predicted held-out texts, so many at most fall under the confidence limit."""
    bags, labels = Bags(), []
    for text, lang in rows:
        if len(found := ngram_buckets(text, bits)):
            bags.add(found)
            labels.append(lang)
    bags.whole()
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), bits, 1.0, 1.0)
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    W = rng.normal(0, 0.1, (width, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    number = {y: i for i, y in enumerate(langs)}
    order = rng.permutation(len(bags))
    test, fit = order[: int(len(bags) * held)], order[int(len(bags) * held) :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for j in rng.permutation(fit):
            i, w = bags[j]
            x = w @ E[i]
            z = x @ W + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[number[labels[j]]] -= 1
            back = W @ g
            W -= step * np.outer(x, g)
            b -= step * g
            # rows are scaled up, as each has a small share of the mean
            E[i] -= np.outer(np.minimum(step * 20 * w, 0.5), back)
    z = np.array([w @ E[i] @ W + b for i, w in (bags[j] for j in test)], np.float64).reshape(len(test), len(langs))
    y = np.array([number[labels[j]] for j in test], int)

    def prob(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    temperature, limit = 1.0, 0.0
    if len(test):
        temperature = min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(np.maximum(prob(t)[np.arange(len(y)), y], 1e-9)).mean())
        p = prob(temperature)
        right = np.sort(p.max(1)[p.argmax(1) == y])
        # below chance nothing is accepted; a limit above one half would reject what the softmax itself prefers
        limit = min(0.5, max(1 / len(langs), float(right[int(len(right) * reject_share)]) * 0.999 if len(right) else 0.0))
    return Model(langs, (E @ W).astype(np.float32), b.astype(np.float64), bits, temperature, limit)


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, sample: int = 6000, id_col: str = "doc_id"
) -> Model:
    """Train on about per_language rows of each language, or fewer if that would be over `sample` rows in all, picked by a hash of id and text.

    The bound is twice `sample` rows, which all languages share alike; every language that has a row in the sample is learned, and
    whole texts are read. One task holds the sample, as the distinct n-grams of each text, and trains; the driver gets the model
    alone. Rows with null text or language don't count, of repeated rows all or none are picked, ties in the hash go by
    text, and an empty table gives a model that predicts "und".
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return train([])
    share = F.floor(F.least(F.lit(1.0), F.lit(min(per_language, sample / languages)) / F.col("n")) * 1_000_000)
    picked = rows.join(counts.select("lang", share.alias("share")), "lang").filter(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
    picked = picked.select("text", "lang", "h").orderBy("h", "text").limit(2 * sample)
    return in_one_task(picked, lambda found: train((r["text"], r["lang"]) for r in found))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep..., lang_pred, score, accepted), one for each row of docs.

    "und", score 0 and not accepted for a null or empty text or one without a letter; of equally
    likely languages the first by name. Repeated rows and null ids stay as they are; whole texts are
    read, however long, one at a time; columns not in keep are left out, and so is one in keep that
    has the name of a result. An empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(keep) if text_col in keep else [*keep, text_col]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            lang, score, accepted = zip(*map(m.predict, b[text_col].to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    return docs.select(*columns).mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")
