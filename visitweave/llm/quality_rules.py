"""Quality rules as a short-circuit cascade.

Each rule is a SQL condition that rejects a document.  On a bounded sample of raw texts every rule is
timed and its rejections are counted; the cascade then asks the rules in the order of
rejections per second, and a rule is evaluated only for documents that all rules before it
let through.  The words of a text are split once for all rules, so what splitting costs is no rule's
cost.  The order changes the cost, never the verdict.

Defined results: a null text counts as empty; an empty or blank text has no words and is
rejected by the word count; repeated rows are judged one by one; an empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import durable, hash_share, let, table, words_of
from visitweave.llm.registry import query

#: Rows of the sample on which rules are timed, about; twice as many at most.
SAMPLE_ROWS = 2_000
#: Fixed value: the characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"


class Rule(NamedTuple):
    """A condition, or what makes one of a value that all rules share."""

    name: str
    rejects: Column | Callable[[Column], Column]

    def of(self, value: Column | None) -> Column:
        return self.rejects if value is None else self.rejects(value)


class Estimate(NamedTuple):
    """What the sample says of a rule."""

    name: str
    seconds: float
    rejected: int
    rows: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def n_symbols(text: Column) -> Column:
    """Symbols are one byte each, so the bytes that leave with them count them."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Window hashes carry the window's place in their low bits (as many as the text needs), so sorting plain
    longs puts windows side by side that agree in the rest.  Whether such neighbours are equal is told by their words;
    when they are not, which takes a collision, all windows of that hash are looked at.
    """
    n = F.size(words)
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1

    def hashes(low):
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: (
            F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))))

    def repeated(low, found):
        place = lambda x: x.bitwiseAND(low).cast("int")
        same = lambda a, b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])
        no = F.lit(False)

        def near(x, j):
            before, after = F.when(j > 0, F.get(found, j - 1)), F.get(found, j + 1)
            like_before, like_after = (F.coalesce(_alike(x, y, low), no) for y in (before, after))
            return F.when(~like_before & ~like_after, no).when(like_before & same(place(x), place(before)), True).when(
                like_after & same(place(x), place(after)), True).otherwise(
                F.exists(found, lambda y: (y != x) & _alike(x, y, low) & same(place(x), place(y))))
        starts = F.sort_array(F.transform(F.filter(found, near), lambda x: x.bitwiseAND(low)))
        zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("until"))
        step = lambda a, x: F.struct(
            (a["covered"] + x + 3 - F.greatest(x, a["until"])).alias("covered"), (x + 3).alias("until"))
        return F.aggregate(starts, zero, step, lambda a: a["covered"])
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        let(ones, lambda low: let(hashes(low), lambda found: repeated(low, found))))


def _alike(a: Column, b: Column, low: Column) -> Column:
    """Equal but for the low bits."""
    return a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and text with word, symbol, line and repetition counts."""
    whole = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = whole.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    return split.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stat_rules() -> list[Rule]:
    """The rules of the digest, over the columns of ``with_stats``."""
    return [
        Rule("few_words", F.col("n_words") < 50),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split("text", "\n"))),
        Rule("few_letters", 10 * F.length(F.regexp_replace("text", "[^\\p{L}]", "")) < 5 * F.col("word_chars")),
    ]


def text_rules(text: str = "text") -> list[Rule]:
    """The same rules over a text and its words (which they share), so that a rule not reached costs nothing."""
    whole = F.coalesce(F.col(text), F.lit(""))
    chars = lambda w: F.length(F.array_join(w, ""))
    return [
        Rule("few_words", lambda w: F.size(w) < 50),
        Rule("repeated_words", lambda w: 100 * n_repeat_words(w) > 50 * F.size(w)),
        Rule("symbols", lambda w: 10 * n_symbols(whole) > F.size(w)),
        Rule("word_length", lambda w: let(chars(w), lambda c: (c < 2 * F.size(w)) | (c > 20 * F.size(w)))),
        Rule("repeated_lines", lambda w: 2 * n_dup_lines(whole) > F.size(F.split(whole, "\n"))),
        Rule("few_letters", lambda w: 10 * F.length(F.regexp_replace(whole, "[^\\p{L}]", "")) < 5 * chars(w)),
    ]


def shared_words(text: str = "text") -> Column:
    return words_of(F.col(text))


def estimate(df: DataFrame, rules: list[Rule], by: list[str], sample_rows: int = SAMPLE_ROWS,
             shared: Column | None = None) -> list[Estimate]:
    """Time and count every rule on a sample of about ``sample_rows`` rows drawn by a hash of ``by``.

    What the shared value costs is timed without any rule and taken off.
    """
    parts = max(1, df.count() // max(1, sample_rows))
    sample = durable(df.filter(hash_share(parts, *by) == 0).limit(2 * sample_rows))
    rows = sample.count()

    def timed(condition):
        start = time.perf_counter()
        row = sample.agg(F.count_if(condition)).first()
        return time.perf_counter() - start, row[0]

    def whole(rule):
        return rule.of(None) if shared is None else let(shared, rule.of)
    nothing = Rule("nothing", F.lit(False) if shared is None else lambda value: F.size(value) < 0)
    floor = min(timed(whole(nothing))[0] for _ in range(2))
    found = []
    for rule in rules:
        seconds, rejected = timed(whole(rule))
        found.append(Estimate(rule.name, max(seconds - floor, 1e-4), rejected, rows))
    return found


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, the best first; ties by name."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def rejected(rules: list[Rule]) -> Column:
    """True when a rule rejects; later rules are evaluated only where earlier ones did not."""
    return reduce(lambda rest, rule: F.when(rule.rejects, True).otherwise(rest), reversed(rules), F.lit(False))


def cascade(docs: DataFrame, rules: list[Rule], by: list[str] | None = None, sample_rows: int = SAMPLE_ROWS,
            shared: Column | None = None) -> Column:
    """The verdict of the ordered cascade as a condition over ``docs``: true rejects.

    With ``shared``, a value worked out once per row, rules make their conditions of it.
    """
    order = ordered(rules, estimate(docs, rules, by or ["doc_id"], sample_rows, shared))
    if shared is None:
        return rejected(order)
    return let(shared, lambda value: rejected([Rule(r.name, r.of(value)) for r in order]))


def keep(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, columns unchanged."""
    return docs.filter(~cascade(docs, text_rules(text), ["doc_id", text], sample_rows, shared_words(text)))


OP6_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, string_split(t, chr(10)) as l from d),
p as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
g as (select doc_id, i, x, lead(x) over o as y, lead(x, 2) over o as z from p window o as (partition by doc_id order by i)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, x, y, z) as n from g where z is not null) where n > 1),
c as (select doc_id, count(distinct i + k) as n from r, (values (0), (1), (2)) as v(k) group by doc_id),
s as (
  select w.doc_id, t, l, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) as n_dup_lines,
         coalesce(c.n, 0) as n_repeat_words
  from w left join c on c.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
            or 2 * n_dup_lines > len(l) or 10 * length(regexp_replace(t, '[^\\pL]', '', 'g')) < 5 * word_chars) as kept
from b
"""


@query("op6_quality_cascade", OP6_SQL)
def op6_quality_cascade(spark, sf_dir):
    """Counts of every document and the verdict of the cascade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The counts are asked for, so the rules compare those; their order is that of the rules over raw texts.
    order = ordered(stat_rules(), estimate(docs, text_rules(), ["doc_id", "text"], shared=shared_words()))
    return with_stats(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~rejected(order)).alias("kept"))
