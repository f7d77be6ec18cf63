"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  What they agree on, counted
over all documents, lets expectation-maximisation estimate how accurate each one is; the
posterior of a document's votes is its label.  A linear scorer over hashed words is trained on
the posteriors of a bounded sample and scores every whole text.

Defined results: a text without words (null, empty, blank) gets no votes and score 0, so it is
not kept; repeated rows are scored one by one; an empty table gives an empty result; further
columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import blocks_for, hash_share, small_batches, table
from visitweave.llm.registry import query

#: Documents the scorer is trained on, about; twice as many at most.
TRAIN_ROWS = 4_000
#: Slots of the hashed word features.
SLOTS = 1 << 16
EM_ROUNDS = 50
TRAIN_STEPS = 300
#: Words whose weight a worker remembers.
KNOWN_WORDS = 100_000
# Chosen here: frequent function words of four languages; longer prose of another one gets a bad vote of this labeller only.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not are this or an at from"
    " der die das und ist von zu mit den ein eine nicht für auf im sich des dem"
    " le la les de des et est un une en que qui dans pour sur pas par au"
    " el los las y es una del por con se su para lo como al".split())
SYMBOLS = "#*$%&|<>"
GOOD, BAD, NOTHING = 2, 1, 0
_STOP = re.compile(r"[.!?](?:\s|$)")


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NOTHING


def votes(text: str, words: list[str]) -> tuple[int, ...]:
    """One vote per labeller; ``words`` are the lower-cased words of ``text``."""
    n = len(words)
    if not n:
        return (NOTHING,) * len(LABELLERS)
    return tuple(rule(text, words, n) for rule in LABELLERS.values())


def _symbols(text, words, n):
    share = sum(map(text.count, SYMBOLS)) / n
    return _vote(share > 0.1, share < 0.02)


def _function_words(text, words, n):
    share = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    return _vote(n >= 20 and share < 0.05, share > 0.12)


def _stutter(text, words, n):
    share = sum(map(eq, words, words[1:])) / n
    return _vote(n >= 10 and share > 0.1, n >= 20 and share < 0.05)


def _variety(text, words, n):
    share = len(set(words)) / n
    return _vote(n >= 20 and share < 0.15, n >= 20 and share > 0.3)


def _lines(text, words, n):
    lines = [x for x in text.split("\n") if x]
    share = 1 - len(set(lines)) / max(1, len(lines))
    return _vote(len(lines) > 2 and share > 0.3, len(lines) > 2 and share < 0.1)


def _sentences(text, words, n):
    share = len(_STOP.findall(text)) / n
    return _vote(n >= 40 and share < 0.01, 0.02 < share < 0.5)


def _line_length(text, words, n):
    mean = n / (text.count("\n") + 1)
    return _vote(n >= 20 and mean < 2.5, mean > 6)


def _word_length(text, words, n):
    mean = sum(map(len, words)) / n
    return _vote(mean < 2 or mean > 20, n >= 20 and 3 < mean < 12)


LABELLERS = {
    "symbols": _symbols, "function_words": _function_words, "stutter": _stutter, "variety": _variety,
    "lines": _lines, "sentences": _sentences, "line_length": _line_length, "word_length": _word_length,
}


def pattern(text: str | None) -> int:
    """All votes on a text as one number, a base-3 digit per labeller."""
    text = text or ""
    code = 0
    for vote in votes(text, text.lower().split()):
        code = code * 3 + vote
    return code


class LabelModel(NamedTuple):
    """Share of good documents, and how often each labeller that votes says what of bad and good ones.

    Not voting says nothing of a document, so its chance is 1 for both.
    """

    prior: float
    chances: np.ndarray   # [labeller, class, vote]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        digits = _digits(patterns, len(self.chances))
        logs = np.log(np.array([1 - self.prior, self.prior])) + sum(
            np.log(self.chances[j][:, digits[:, j]]).T for j in range(len(self.chances)))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def _digits(patterns, m):
    return np.stack([np.asarray(patterns) // 3 ** (m - 1 - j) % 3 for j in range(m)], axis=1).astype(int)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Fit the label model to the number of documents with each vote pattern.

    Labellers are made to be rarely wrong when they say bad, so it starts from the number of bad
    votes, which also settles which class is the good one.
    """
    m = len(LABELLERS)
    digits, counts = _digits(patterns, m), np.asarray(counts, float)
    good = 1 / (1 + np.exp(2.0 * (digits == BAD).sum(1) - 2.0))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        chances = np.empty((m, 2, 3))
        for j in range(m):
            for c in range(2):
                seen = np.bincount(digits[:, j], weight[c], 3)[1:] + 0.5   # never impossible
                chances[j, c] = 1.0, *(seen / seen.sum())
        prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1e-9), 0.001, 0.999))
        model = LabelModel(prior, chances)
        good = model.posterior(patterns)
    return model


def label_model(docs: DataFrame, text: str = "text") -> LabelModel | None:
    """The label model of all documents: at most 3 to the number of labellers rows are gathered."""
    def count(batches):
        for batch in batches:
            found = Counter(map(pattern, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                             ["pattern", "n"])
    rows = docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect()
    rows.sort()
    return expectation_maximisation(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None


def slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares: every word, its last character, and words that repeat the one before."""
    words = (text or "").lower().split()
    found: Counter = Counter()
    for word, k in Counter(words).items():
        found[slot(word)] += k
        found[slot("\x01" + word[-1])] += k
    found[slot("\x02")] += sum(map(eq, words, words[1:]))
    n = max(1, len(words))
    return np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found)) / n


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = TRAIN_STEPS) -> Scorer:
    """Logistic regression on soft labels, by full-batch steps with per-slot step sizes."""
    weights, bias = np.zeros(SLOTS), 0.0
    if not rows:
        return Scorer(weights.astype(np.float32), bias)
    at = np.concatenate([r[0] for r in rows])
    share = np.concatenate([r[1] for r in rows]).astype(float)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    want = np.array([r[2] for r in rows])
    past, past_bias = np.full(SLOTS, 1e-12), 1e-12
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights[at] * share, len(rows)) + bias, -60, 60))) - want
        step = np.bincount(at, off[doc] * share, SLOTS) / len(rows) + 1e-6 * weights
        past += step ** 2
        weights -= 0.5 * step / np.sqrt(past)
        past_bias += off.mean() ** 2
        bias -= 0.1 * off.mean() / np.sqrt(past_bias)
    return Scorer(weights.astype(np.float32), float(bias))


def training_rows(docs: DataFrame, model: LabelModel, text: str = "text", rows: int = TRAIN_ROWS) -> list:
    """Hashed features and posteriors of about ``rows`` documents (twice as many at most), drawn by a hash of doc_id and text."""
    parts = blocks_for(docs.count(), rows)
    sample = docs.select(text, F.xxhash64(F.lit("order"), "doc_id", text).alias("order")).filter(
        hash_share(parts, "doc_id", text) == 0)

    def hashed(batches):
        for batch in batches:
            pairs = [(x, k) for x, k in zip(*(c.to_pylist() for c in batch.columns)) if x and x.strip()]
            if pairs:
                texts = [x for x, _ in pairs]
                label = model.posterior(np.array([pattern(x) for x in texts]))
                found = [features(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes() for a, _ in found]), pa.array([b.tobytes() for _, b in found]), pa.array(label),
                     pa.array([k for _, k in pairs], pa.int64())], ["at", "share", "label", "order"])
    got = sample.mapInArrow(hashed, "at binary, share binary, label double, order long").orderBy("order").limit(2 * rows).collect()
    got.sort(key=lambda r: (r.label, bytes(r.at), bytes(r.share)))   # sums in one order
    return [(np.frombuffer(r.at, np.int32), np.frombuffer(r.share, np.float32), r.label) for r in got]


class _Weights(dict):
    """Weight of a word with its last character, worked out at first sight."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        value = float(self.weights[slot(word)] + self.weights[slot("\x01" + word[-1])])
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


def _score(text: str | None, known: _Weights, bias: float) -> float:
    words = (text or "").lower().split()
    if not words:
        return 0.0
    total = sum(map(known.__getitem__, words))
    total += float(known.weights[slot("\x02")]) * sum(map(eq, words, words[1:]))
    return float(1 / (1 + np.exp(-np.clip(total / len(words) + bias, -60, 60))))


def fit(docs: DataFrame, text: str = "text") -> tuple[LabelModel | None, Scorer]:
    small_batches(docs.sparkSession)
    model = label_model(docs, text)
    return model, train(training_rows(docs, model, text) if model else [])


def score(docs: DataFrame, model: LabelModel | None, scorer: Scorer, text: str = "text") -> DataFrame:
    """``doc_id, posterior, score, kept`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)   # as large as SLOTS

    def rate(batches):
        known = _Weights(sent.value.weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            chance = model.posterior(np.array([pattern(x) for x in texts], dtype=int)) if model and texts else []
            marks = [_score(x, known, sent.value.bias) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chance, pa.float64()), pa.array(marks, pa.float64()),
                 pa.array([m >= 0.5 for m in marks], pa.bool_())], ["doc_id", "posterior", "score", "kept"])
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(
        rate, "doc_id long, posterior double, score double, kept boolean")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier takes for good, columns unchanged."""
    _, scorer = fit(docs, text)
    sent, place = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text)

    def pick(batches):
        known = _Weights(sent.value.weights)
        for batch in batches:
            marks = [_score(x, known, sent.value.bias) >= 0.5 for x in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(marks, pa.bool_()))
    return docs.mapInArrow(pick, docs.schema)


@query("op3_weak_label_quality")
def op3_weak_label_quality(spark, sf_dir):
    """Weak label, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *fit(docs))
