"""Interactions of filters, from one survival word per document.

With five filters there are 32 subsets of them.  A document's word has bit s set when no filter
of subset s removes it: a truth table in 32 bits.  Counting each bit over all words gives the
survivors of every subset, and the figures of any order of the filters are differences of such
counts.  Tasks count bits by carry-save addition: three rows of words become one row of sums and
one row of carries of twice the weight, so whole rows of words are added by five bit operations,
and single bits are looked at only in the few rows that are left.

What crosses the network is 32 counts per part and label class of a task, whatever the number of documents.

Defined results: a null text counts as empty, a null part as the empty string; a document without
a label is neither good nor toxic, one with several labels is what any of them says; a null
doc_id is smaller than none, so it never makes another text a repetition and has no labels;
repeated rows count one by one; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import attach, durable, table, words_of
from visitweave.llm.registry import query

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The word of a document that fails one filter only: the subsets without that filter.
WITHOUT = [sum(1 << s for s in range(SUBSETS) if not s >> f & 1) for f in range(len(FILTERS))]
#: Words that are added side by side.
LANES = 64
#: Parts whose sums a task holds at once; with more it hands on what it has.
HELD = 2_000
COUNTS = "part string, good boolean, toxic boolean, survivors array<long>"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


class CarrySave:
    """Counts of each of 32 bits over many words."""

    def __init__(self):
        self.planes: list[np.ndarray] = []      # up to two rows of each weight 1, 2, 4, ...

    def add(self, words: np.ndarray) -> None:
        rows = np.zeros(-(-len(words) // LANES) * LANES, np.uint32)
        rows[:len(words)] = words
        self._add(rows.reshape(-1, LANES), 0)

    def _add(self, rows: np.ndarray, power: int) -> None:
        if power == len(self.planes):
            self.planes.append(rows[:0])
        rows = np.concatenate([self.planes[power], rows])
        while len(rows) > 2:
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n:2 * n], rows[2 * n:3 * n]
            half = a ^ b
            self._add((a & b) | (half & c), power + 1)
            rows = np.concatenate([half ^ c, rows[3 * n:]])
        self.planes[power] = rows

    def counts(self) -> np.ndarray:
        bits = [np.unpackbits(rows.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                .sum(0, dtype=np.int64) << power for power, rows in enumerate(self.planes)]
        return np.sum(bits, axis=0, dtype=np.int64) if bits else np.zeros(32, np.int64)


def text_failures(text: Column, words: Column) -> list[Column]:
    """Filters A to D: few words, few distinct words, many capitals, symbols."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]


def survival_word(failures: list[Column]) -> Column:
    """The subsets of filters that a document survives, as the bits of a number."""
    kept = [F.when(fails, F.lit(word)).otherwise(F.lit((1 << 32) - 1)) for fails, word in zip(failures, WITHOUT)]
    return reduce(lambda a, b: a.bitwiseAND(b), kept)


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, word`` of every document.

    Filter E is a lookup of the text's smallest doc_id; only texts that come twice take part in it.
    """
    whole = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
    split = whole.select("*", words_of(F.col("text")).alias("words"))
    failures = text_failures(F.col("text"), F.col("words"))
    rows = durable(split.select("doc_id", "part", survival_word([*failures, F.lit(False)]).alias("word"),
                                F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")
    repeats = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return attach(rows, durable(copies), ["key"], "copies", rows.count()).select(
        "doc_id", "part", F.when(repeats, F.col("word").bitwiseAND(F.lit(WITHOUT[4]))).otherwise(F.col("word")).alias("word"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic``, false where no label says so."""
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    none = F.lit(False)
    known = rows.filter("doc_id is not null").join(said, "doc_id", "left").select(
        *rows.columns, F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    return known.unionByName(rows.filter("doc_id is null").withColumn("good", none).withColumn("toxic", none))


def survivors(rows: DataFrame) -> DataFrame:
    """``part, good, toxic, survivors``: documents of each class that survive each subset of filters."""
    def batch_of(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([bool(k[1] & 1) for k in keys], pa.bool_()),
             pa.array([bool(k[1] & 2) for k in keys], pa.bool_()),
             pa.array([held[k].counts().tolist() for k in keys], pa.list_(pa.int64()))],
            ["part", "good", "toxic", "survivors"])

    def count(batches):
        held: dict = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            kind = batch.column(1).to_numpy(False).astype(np.int64) + 2 * batch.column(2).to_numpy(False)
            code = parts.indices.to_numpy().astype(np.int64) * 4 + kind
            order = np.argsort(code, kind="stable")
            words = batch.column(3).to_numpy()[order].astype(np.uint32)
            found, starts = np.unique(code[order], return_index=True)
            names = parts.dictionary.to_pylist()
            for c, own in zip(found.tolist(), np.split(words, starts[1:])):
                held.setdefault((names[c // 4], c % 4), CarrySave()).add(own)
            if len(held) > HELD:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)
    sums = rows.select("part", "good", "toxic", "word").mapInArrow(count, COUNTS)
    each = [F.sum(F.get("survivors", F.lit(s))).alias(f"s{s}") for s in range(SUBSETS)]
    return sums.groupBy("part", "good", "toxic").agg(*each).select(
        "part", "good", "toxic", F.array(*[f"s{s}" for s in range(SUBSETS)]).alias("survivors"))


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from the survivors of the subsets."""
    total = lambda s, only=F.lit(True): F.sum(F.when(only, F.get("survivors", F.lit(s))).otherwise(F.lit(0)))
    lists = [F.array(*[total(s, only) for s in range(SUBSETS)]).alias(name)
             for name, only in (("every", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    parts = counts.groupBy("part").agg(*lists)
    orders = [[FILTERS.index(x) for x in order] for order in permutations(FILTERS)]
    at = np.repeat(np.array(orders), 5, axis=0)[np.arange(600), np.tile(np.arange(5), 120)]
    before = np.array([sum(1 << f for f in order[:step]) for order in orders for step in range(5)])
    after = before | (1 << at)
    names = ["".join(FILTERS[f] for f in order) for order in orders for _ in range(5)]
    steps = np.tile(np.arange(1, 6, dtype=np.int32), 120)
    all_but = (SUBSETS - 1) & ~(1 << at)

    def rows(batches):
        for batch in batches:
            for part, *figures in zip(*(c.to_pylist() for c in batch.columns)):
                every, good, toxic = (np.array(x, np.int64) for x in figures)
                removed = every[before] - every[after]
                shapley = np.array([removed[at == f].sum() for f in range(5)])
                columns = [every[after], removed, every[0] - every[1 << at] - removed,
                           every[all_but] - every[SUBSETS - 1], good[before] - good[after], toxic[before] - toxic[after],
                           shapley[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(at), pa.string()), pa.array(names, pa.string()), pa.array(steps, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in columns]],
                    [f.split()[0] for f in REPORT.split(", ")])
    return parts.mapInArrow(rows, REPORT)


OP13_SQL = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
x as (select t, min(doc_id) as first from d group by t),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 200 then 1 else 0 end
      + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
      + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end
      + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
      + case when first < w.doc_id then 16 else 0 end as mask
  from w join x using (t) left join l on l.doc_id = w.doc_id),
c as (
  select part, s, count(*) filter (mask & s = 0) as n, count(*) filter (mask & s = 0 and good) as good,
    count(*) filter (mask & s = 0 and toxic) as toxic
  from m, (select unnest(generate_series(0, 31)) as s) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as before
  from o, (select unnest([1, 2, 3, 4, 5]) as step)),
g as (
  select part, list(n order by s) as n, list(good order by s) as good, list(toxic order by s) as toxic from c group by part),
r as (
  select part, filter_order, step, bit, n[before + bit + 1] as kept, n[before + 1] - n[before + bit + 1] as removed,
    n[1] - n[bit + 1] - removed as redundant, n[32 - bit] - n[32] as unique_fails,
    good[before + 1] - good[before + bit + 1] as good_lost, toxic[before + 1] - toxic[before + bit + 1] as toxic_lost
  from g, s)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""


@query("op13_survival_words", OP13_SQL)
def op13_survival_words(spark, sf_dir):
    """What each filter removes, in every order of the filters, per source."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return report(survivors(labelled(rows, table(spark, sf_dir, "labels"))))
