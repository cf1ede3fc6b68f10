"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each whole text. Spark counts the vote patterns of
all documents, of which there are at most 3 to the number of labellers; expectation-maximisation
over the counted patterns estimates how often each labeller is right on good and on bad texts, and a
posterior for each pattern.
Posterior labels of a bounded sample train a hashed linear scorer, which then scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Bags, in_one_task, slices, text_or_empty

LINE = re.compile(r"[\n.]+")
#: Words among which distinct ones are counted.
BLOCK = 256
_upper, _lower = range(65, 91), range(97, 123)
_symbols = [c for c in b"!#$%&*+/<=>@[\\]^_`{|}~"]


def _judge(x: float, good: bool, bad: bool) -> str:
    return "1" if good else "0" if bad else "-"


def votes(text: str) -> str:
    """A character for each labeller: 1 good, 0 bad, - no vote. A text without words gets no votes."""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper = int(raw[65:91].sum())
    letters = upper + int(raw[97:123].sum() + raw[0xC2:0xF5].sum())
    visible = max(1, int(raw.sum() - raw[9:14].sum() - raw[32] - raw[0x80:0xC0].sum()))
    symbols = int(raw[_symbols].sum()) / visible
    shouting = upper / max(1, letters)
    bare = sum(not w[:1].isalnum() and len(w) <= 2 for w in words) / n
    short = sum(len(w) <= 4 and w[0].isalnum() for w in words) / n
    odd_ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)'\"" for w in words) / n
    lines = [x for x in LINE.split(text) if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    # by blocks, as longer texts repeat more of their words
    distinct = sum(len(set(words[at : at + BLOCK])) for at in range(0, n, BLOCK)) / n
    twice = sum(map(eq, words, words[1:])) / n
    out = [
        _judge(symbols, symbols < 0.02, symbols > 0.08),
        _judge(shouting, shouting < 0.2 and letters >= 10, shouting > 0.5 and letters >= 10),
        _judge(bare, bare < 0.03, bare > 0.15),
        _judge(short, 0.2 < short < 0.8 and n >= 20, short < 0.1 and n >= 20),
        _judge(odd_ends, odd_ends < 0.05, odd_ends > 0.3),
        _judge(repeated, repeated < 0.2 and len(lines) >= 4, repeated > 0.5 and len(lines) >= 4),
        _judge(distinct, distinct > 0.4 and n >= 20, distinct < 0.2 and n >= 20),
        _judge(twice, twice < 0.05 and n >= 10, twice > 0.2),
    ]
    return "".join(out)


#: What each vote is about.
LABELLERS = ("symbols", "capitals", "bare symbols as words", "short words", "word ends", "repeated sentences", "distinct words", "words said twice")


@dataclass
class LabelModel:
    """prior: share of good; bad_of_good, bad_of_bad: of each labeller's votes on good and on bad texts, the share that says bad. No vote says nothing."""

    prior: float
    bad_of_good: np.ndarray
    bad_of_bad: np.ndarray
    posterior: dict[str, float] = field(default_factory=dict)

    def of(self, pattern: str) -> float:
        """Chance that a text with these votes is good."""
        v = np.frombuffer(pattern.encode(), np.uint8)
        z = np.log(self.prior / (1 - self.prior))
        z += np.log(self.bad_of_good / self.bad_of_bad)[v == ord("0")].sum() + np.log((1 - self.bad_of_good) / (1 - self.bad_of_bad))[v == ord("1")].sum()
        return float(1 / (1 + np.exp(np.clip(-z, -500, 500))))

    @property
    def accuracy(self) -> np.ndarray:
        """The share of each labeller's votes that is right, with votes on texts of both kinds in proportion."""
        return self.prior * (1 - self.bad_of_good) + (1 - self.prior) * self.bad_of_bad


def fit_labels(patterns: dict[str, int], rounds: int = 300, prior: float = 0.85, start: tuple[float, float] = (0.005, 0.3), most_wrong: float = 0.02, least_found: float = 0.05) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    start: the shares of votes on good and on bad texts that say bad, before any text is seen; they
    weigh as much as ten votes. Labellers are rules that seldom blame a good text: of these at most
    most_wrong, and of bad ones at least least_found. Without these bounds one kind of bad texts can
    become a part of the good ones, as each rule calls other kinds than its own good.
    """
    k = len(LABELLERS)
    m = LabelModel(prior, np.full(k, start[0]), np.full(k, start[1]))
    keys, n = list(patterns), np.array(list(patterns.values()), float)
    votes = np.array([list(p.encode()) for p in keys]).reshape(len(keys), k)
    for _ in range(rounds if len(keys) else 0):
        q = np.array([m.of(p) for p in keys])
        share = []
        for weight, s in ((n * q, start[0]), (n * (1 - q), start[1])):
            bad, cast = weight @ (votes == ord("0")), weight @ (votes != ord("-"))
            share.append((bad + 10 * s) / (cast + 10))
        new = LabelModel(float(np.clip((n @ q + 1) / (n.sum() + 2), 0.01, 0.99)), np.clip(share[0], 1e-4, most_wrong), np.clip(share[1], least_found, 0.95))
        done = max(np.abs(new.bad_of_good - m.bad_of_good).max(), np.abs(new.bad_of_bad - m.bad_of_bad).max()) < 1e-6
        m = new
        if done:
            break
    m.posterior = {p: m.of(p) for p in keys}
    return m


_shape = np.full(256, ord("a"), np.uint8)  # letters, and bytes over 127, are one shape, capitals and digits others
_shape[:128] = np.arange(128)
_shape[list(_upper)], _shape[list(_lower)], _shape[48:58] = ord("A"), ord("a"), ord("9")
_shape[9:14] = 32


def shape_buckets(text: str, bits: int) -> np.ndarray:
    """Hashed 1-, 3- and 6-grams of a text's letter shapes."""
    c = _shape[np.frombuffer(f" {text} ".encode(), np.uint8)].astype(np.uint32)
    out = [c * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)]
    three = (c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1]) * np.uint32(0xC2B2AE35) + c[2:]
    three = (three ^ (three >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    out.append(three >> np.uint32(32 - bits))
    out.append((three[:-3] * np.uint32(0x165667B1) ^ three[3:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Scorer:
    """A linear score over the mean of hashed features; the shares of words said twice and of repeated sentences count too. trained: on how many texts."""

    weights: np.ndarray
    extra: np.ndarray
    bits: int
    trained: int = 0

    @staticmethod
    def shares(text: str) -> np.ndarray | None:
        words, lines = text.split(), LINE.split(text)
        return np.array([1.0, sum(map(eq, words, words[1:])) / len(words), 1 - len(set(lines)) / len(lines)]) if words else None

    def score(self, text: str) -> float:
        """Chance of good; 0 for a text without words."""
        extra = self.shares(text)
        if extra is None:
            return 0.0
        z = self.weights[shape_buckets(text, self.bits)].mean() + self.extra @ extra
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_scorer(rows: Iterable[tuple[str, float]], bits: int = 16, epochs: int = 12, rate: float = 4.0, seed: int = 3) -> Scorer:
    """Logistic regression by stochastic gradient descent on rows (text, how good it is); good and bad weigh alike."""
    s = Scorer(np.zeros(1 << bits), np.zeros(3), bits)
    bags, shares, goodness = Bags(), [], []
    for text, good in rows:
        if (extra := s.shares(text)) is not None:
            bags.add(shape_buckets(text, bits))
            shares.append(extra)
            goodness.append(good)
    bags.whole()
    s.trained = len(bags)
    bad = sum(1 - y for y in goodness)
    weigh = min(max((len(bags) - bad) / bad, 0.1), 20.0) if bad > 0 else 1.0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for j in rng.permutation(len(bags)):
            (i, x), extra, y = bags[j], shares[j], goodness[j]
            z = s.weights[i] @ x + s.extra @ extra
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * (y + (1 - y) * weigh)
            g = float(np.clip(g, -4, 4))
            s.weights[i] -= step * 10 * g * x
            s.extra -= 0.5 * step * g * extra
    return s


def vote(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep..., votes), one for each row of docs."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(map(votes, b.column(0).to_pylist()), pa.string())], names=[*keep, "votes"])

    return docs.select(text_or_empty(text_col).alias("__text"), *keep).mapInArrow(run, f"{kinds}votes string")


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 4000) -> tuple[LabelModel, Scorer]:
    """The label model over all documents' votes, and a scorer from about `sample` texts, picked by a hash of id and text.

    The bound is 2 x sample rows, whose whole texts train the scorer. One task holds the sample and trains; the driver gets the models and the counted vote patterns, at most 3 to
    the number of labellers. Of repeated rows all or none are picked; ties in the hash go by text.
    Without a text that has words, scores are the label model's posteriors; an empty table gives
    the labellers' start values.
    """
    patterns = {r["votes"]: r["n"] for r in vote(docs, text_col).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_labels(patterns)
    n = max(1, sum(patterns.values()))
    rows = docs.select(text_or_empty(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).filter(F.pmod("h", F.lit(1_000_000)) < int(1e6 * min(1.0, sample / n)))
    voted = vote(rows.select(F.col("text").alias("whole"), "h"), "whole", keep=("whole", "h"))
    picked = voted.filter("whole <> ''").orderBy("h", "whole").limit(2 * sample)
    return model, in_one_task(picked, lambda found: fit_scorer((r["whole"], model.of(r["votes"])) for r in found))


def classify(docs: DataFrame, models: tuple[LabelModel, Scorer], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """Rows (keep..., votes, posterior, quality, accepted), one for each row of docs.

    quality is the scorer's; accepted means that it is at least `least` (a tie is accepted). A null
    or empty text, or one without words, gets no votes, quality 0 and is not accepted. Repeated rows
    and null ids stay; whole texts are read, however long, one at a time; columns not in keep are
    left out, and so is one in keep that has the name of a result. An empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in ("votes", "posterior", "quality", "accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    columns = list(keep) if text_col in keep else [*keep, text_col]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, scorer = shared.value
        known = dict(labels.posterior)
        for b in slices(batches):
            texts = [x or "" for x in b[text_col].to_pylist()]
            given = [votes(t) for t in texts]
            for p in set(given) - known.keys():
                known[p] = labels.of(p)
            if scorer.trained:
                quality = [scorer.score(t) for t in texts]
            else:
                quality = [known[p] if t.split() else 0.0 for t, p in zip(texts, given)]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), pa.array(given, pa.string()), pa.array([known[p] for p in given], pa.float64()), pa.array(quality, pa.float64()), pa.array([q > 0 and q >= least for q in quality], pa.bool_())],
                names=[*keep, "votes", "posterior", "quality", "accepted"],
            )

    return docs.select(*columns).mapInArrow(run, f"{kinds}votes string, posterior double, quality double, accepted boolean")
