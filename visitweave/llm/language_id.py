"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes, with the counts of the bytes
that followed.  A byte is coded in the longest context known; if it never followed there, an
escape is coded and the next shorter context takes over, at last any byte with equal chance.
With the counts frozen after training, the code length of a text is a sum of table entries, and
the language that codes a text shortest is its prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the
first language in alphabetical order; repeated rows are predicted one by one; an empty table
gives an empty result, one without training rows gives ``und`` only; further columns are left
alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitweave.llm.common import durable, small_batches, table
from visitweave.llm.registry import query

#: Distinct texts of each language that its counts are taken from, at most.
TRAIN_TEXTS = 1_500
#: Ranges of hashes out of which a language's texts are chosen, so that no task sorts all of them.
DRAWS = 64
ORDER = 3
#: Bytes that are coded at once.
CODED = 1 << 20
UNKNOWN = "und"


class Level(NamedTuple):
    """Contexts of one length: the pairs of context and symbol seen in training, and the contexts.

    ``bits`` is the code length of each pair in every language; in a context that is known, a symbol that no language saw
    there costs ``escape`` and then what it costs in the shorter context.
    """

    pairs: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class ByteModel(NamedTuple):
    """Frozen code lengths.

    ``symbol`` gives each byte its place in a small alphabet (0 stands for the text's start and
    for bytes never seen), ``short`` the code length of a symbol after one other, for every language, and ``levels``
    what was seen after two and three.  Only what was seen is stored.
    """

    languages: list[str]
    symbol: np.ndarray
    short: np.ndarray
    levels: list[Level]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of every text under every language."""
        total = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            data = np.frombuffer(bytes(ORDER) + text.encode("utf-8", "surrogatepass"), np.uint8)
            for at in range(0, len(data) - ORDER, CODED):
                symbols = self.symbol[data[at:at + CODED + ORDER]].astype(np.int64)
                if at == 0:
                    symbols[:ORDER] = 0          # the start
                total[i] += self.cost(symbols)
        return total

    def cost(self, symbols: np.ndarray) -> np.ndarray:
        """Bits of all symbols but the first three, which are only context."""
        n = len(self.short)
        total, last = np.zeros(len(self.languages)), symbols[ORDER:]
        open_ = np.arange(len(last))
        for k in range(ORDER, 1, -1):
            level = self.levels[k - 2]
            context = np.zeros(len(open_), np.int64)
            for j in range(k):
                context = context * n + symbols[ORDER - k + j:][open_]
            found, at = _places(level.pairs, context * n + last[open_])
            total += level.bits.T @ np.bincount(at[found], minlength=len(level.bits))
            open_, context = open_[~found], context[~found]
            known, at = _places(level.contexts, context)
            total += level.escape.T @ np.bincount(at[known], minlength=len(level.escape))
        total += np.einsum("ij,ijl->l", np.bincount(symbols[ORDER - 1:-1][open_] * n + last[open_], minlength=n * n).reshape(n, n), self.short)
        return total


def _places(table_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are in a sorted table, and where."""
    at = np.minimum(np.searchsorted(table_, values), len(table_) - 1)
    return table_[at] == values, at


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n``: four bytes in a row (as one number, starts as 256), counted in each language."""
    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                found = []
                for x in (t for t, l in zip(texts, langs) if l == name):
                    b = np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                    b = np.concatenate([np.full(ORDER, 256), b])
                    found.append(((b[:-3] * 257 + b[1:-2]) * 257 + b[2:-1]) * 257 + b[3:])
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(n)],
                                                 ["lang", "gram", "n"])
    return docs.select(lang, text).mapInArrow(count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances of the next symbol in contexts with ``counts``, falling back on those of ``shorter``.

    A context seen n times with d different symbols escapes with chance d / (n + d).  After an
    escape the symbols it knows are ruled out, so the shorter context's chances are scaled to
    the others; all chances add up to one.
    """
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    escape = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
    open_ = np.where(counts > 0, 0.0, shorter)
    left = open_.sum(1, keepdims=True)
    own = counts / np.maximum(1, total + np.where(left > 0, kinds, 0))   # nothing left: no escape needed
    return np.where(counts > 0, own, escape * open_ / np.where(left > 0, left, 1.0))


def build(rows: list[tuple[str, int, int]]) -> ByteModel | None:
    """Tables from gram counts."""
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    lang = np.array([langs.index(r[0]) for r in rows])
    gram, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
    used = sorted(set((gram % 257).tolist()))
    symbol = np.zeros(257, np.int16)
    symbol[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    parts = [symbol[gram // 257 ** k % 257].astype(np.int64) for k in (3, 2, 1, 0)]
    # Symbol 0 is coded for bytes never seen in training.
    base = np.full((1, size), 1 / (size + 255))
    base[0, 0] = 1 - base[0, 1:].sum()
    short = np.empty((size, size, len(langs)))
    for i in range(len(langs)):
        own = lang == i
        one = code_lengths(np.bincount(parts[3][own], n[own], size)[None], base)
        short[:, :, i] = code_lengths(np.bincount(parts[2][own] * size + parts[3][own], n[own], size ** 2).reshape(size, size), one)
    levels: list[Level] = []

    def chances(k: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Chance of symbols after contexts of ``k`` symbols, for every language."""
        if k == 1:
            return short[context, last]
        level = levels[k - 2]
        out = chances(k - 1, context % size ** (k - 1), last)
        known, at = _places(level.contexts, context)
        out = np.where(known[:, None], out * np.exp2(-level.escape[at]), out)
        found, at = _places(level.pairs, context * size + last)
        return np.where(found[:, None], np.exp2(-level.bits[at]), out)
    context = parts[2]
    for k in (2, 3):
        context = parts[3 - k] * size ** (k - 1) + context
        pairs, at = np.unique(context * size + parts[3], return_inverse=True)
        seen = np.zeros((len(pairs), len(langs)))
        np.add.at(seen, (at, lang), n)
        contexts, of = np.unique(pairs // size, return_inverse=True)
        sums = lambda x: np.stack([np.bincount(of, x[:, i], len(contexts)) for i in range(len(langs))], 1)
        below = chances(k - 1, pairs // size % size ** (k - 1), pairs % size)
        total, kinds = sums(seen), sums((seen > 0).astype(float))
        left = np.maximum(0.0, 1 - sums(np.where(seen > 0, below, 0.0)))       # what the unseen symbols have
        left[left < 1e-12] = 0.0
        scale = np.where(total > 0, kinds / np.maximum(1, total + kinds) / np.where(left > 0, left, 1), 1.0)
        own = seen / np.maximum(1, (total + np.where(left > 0, kinds, 0))[of])
        levels.append(Level(pairs, -np.log2(np.where(seen > 0, own, scale[of] * below)), contexts, -np.log2(scale)))
    return ByteModel(langs, symbol[:256], -np.log2(short), levels)


def training_texts(docs: DataFrame, most: int = TRAIN_TEXTS) -> DataFrame:
    """At most ``most`` distinct texts of each language: those with the smallest hashes.

    They are chosen among the first of each range of hashes, so a language with a third of all texts is sorted by many tasks.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    drawn = known.select("lang", "h").distinct().withColumn("draw", F.floor(F.col("h").cast("double") / 2.0 ** 64 * DRAWS))
    first = drawn.withColumn("place", place("lang", "draw")).filter(F.col("place") <= most)
    # At most ``most`` texts of a range, DRAWS ranges of a language.
    chosen = first.withColumn("place", place("lang")).filter(F.col("place") <= most).groupBy("lang").agg(F.max("h").alias("last"))
    # One row per language; stored, Spark knows how small it is and moves no texts for the join.
    near = known.join(durable(chosen.withColumnRenamed("lang", "_lang")), (known["lang"] == F.col("_lang")) & (F.col("h") <= F.col("last")))
    return near.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, most: int = TRAIN_TEXTS) -> ByteModel | None:
    """Learn from ``docs(text, lang)``."""
    small_batches(docs.sparkSession)
    rows = count_grams(training_texts(docs, most)).collect()   # as many as the bounded sample has
    return build(sorted((r.lang, r.gram, r.n) for r in rows))


def predict(docs: DataFrame, model: ByteModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` from ``docs(doc_id, held_out, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)   # as large as what the sample holds

    def name(batches):
        model = sent.value
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            known = np.array(batch.column(3).to_pylist(), bool)
            if model is None or not texts:
                known[:] = False
                lengths, best = np.zeros((len(texts), 1)), np.zeros(len(texts), int)
            else:
                lengths = model.lengths(texts)
                best = lengths.argmin(1)
            least = lengths.min(1, initial=np.inf) if len(texts) else np.zeros(0)
            odds = 1 / np.exp2(np.maximum(-1000, least[:, None] - lengths)).sum(1)
            per_byte = least / np.maximum(1, [len(x.encode("utf-8", "surrogatepass")) for x in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, odds, 0.0)), pa.array(np.where(known, per_byte, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "held_out", "text", letters).mapInArrow(
        name, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op1_ppm_language")
def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), held_out().alias("held_out"), "text", "lang")
    model = fit(docs.filter("not held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
