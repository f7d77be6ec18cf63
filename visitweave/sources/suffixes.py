"""Public-suffix rules.

A rule is exact (``co.uk``), a wildcard (``*.ck``, stored as ``ck``) or an exception
(``!www.ck``, stored as ``www.ck``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.config import BROADCAST_KEYS
from visitweave.storage import durable


class SuffixRules(NamedTuple):
    """One row per suffix, ``(suffix, exact, exception, wildcard)``, and the most labels in one.

    ``patterns`` are the rules compiled for an expression: what the end of a name must match, and how many
    labels its suffix then has; the first that matches counts.  ``None`` if there are too many rules.
    """

    frame: DataFrame
    depth: int
    patterns: list[tuple[str, int]] | None = None


def trie_pattern(names: list[str]) -> str:
    """A regular expression for exactly these names, as a trie of their characters.

    What names have in common at the start is written once, so a match looks at each character of a
    text about once, however many names there are.
    """
    trie: dict = {}
    for name in names:
        node = trie
        for c in name:
            node = node.setdefault(c, {})
        node[""] = {}
    quoted = lambda c: c if c.isalnum() or c == "-" else "\\" + c if c == "." else f"\\x{{{ord(c):x}}}"

    def written(node: dict) -> str:
        prefix = ""
        while len(node) == 1 and "" not in node:         # a chain without branches
            (c, node), = node.items()
            prefix += quoted(c)
        branches = [quoted(c) + written(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return prefix
        whole = f"(?:{'|'.join(branches)})"
        return prefix + whole + ("?" if "" in node else "")
    return written(trie)


def compiled(rows: list) -> list[tuple[str, int]]:
    """Patterns of ``(suffix, exact, exception, wildcard)`` rows, the longest suffixes first.

    Of one length, a rule itself goes before an exception, and that before a wildcard.
    """
    by_length: dict[tuple[int, int], list[str]] = {}
    for suffix, *kinds in rows:
        n = suffix.count(".") + 1
        for kind, given in enumerate(kinds):
            if given:
                by_length.setdefault((-(n + (kind == 2)), kind), []).append(suffix)
    lead = (r"(?:^|\.)", r"(?:^|\.)", r"(?:^|\.)[^.]+\.")
    return [(f"{lead[kind]}{trie_pattern(names)}$", -length - (kind == 1))
            for (length, kind), names in sorted(by_length.items())]


def suffixes(spark: SparkSession, rules: list[str]) -> SuffixRules:
    """Rules in list notation (``com``, ``*.ck``, ``!www.ck``)."""
    names = {r.removeprefix("*.").removeprefix("!") for r in rules}
    text = " ".join(sorted(names))
    listed = {k: " ".join(n for n in sorted(names) if mark + n in rules)
              for k, mark in (("exact", ""), ("exception", "!"), ("wildcard", "*."))}
    frame = spark.range(1).select(F.explode(F.split(F.lit(text), " ")).alias("suffix")).select(
        "suffix", *[F.array_contains(F.split(F.lit(t), " "), F.col("suffix")).alias(k) for k, t in listed.items()])
    rows = [(n, n in rules, "!" + n in rules, "*." + n in rules) for n in sorted(names)]
    return SuffixRules(frame, max(n.count(".") + 1 for n in names), compiled(rows))


def read_suffixes(spark: SparkSession, path: str) -> SuffixRules:
    """Rules from a file in the public suffix list's own text format."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    lines = spark.read.text(path).select(rule.alias("rule")).filter("rule <> '' and not startswith(rule, '//')")
    frame = durable(lines.groupBy(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix")).agg(
        F.bool_or(~F.col("rule").rlike(r"^(\*\.|!)")).alias("exact"),
        F.bool_or(F.col("rule").startswith("!")).alias("exception"),
        F.bool_or(F.col("rule").startswith("*.")).alias("wildcard")))
    size, depth = frame.agg(F.count(F.lit(1)), F.max(F.size(F.split("suffix", r"\.")))).first()
    if size > BROADCAST_KEYS:
        return SuffixRules(frame, depth or 1)
    rows = frame.select("suffix", "exact", "exception", "wildcard").collect()     # as many as were counted
    return SuffixRules(F.broadcast(frame), depth or 1, compiled(sorted(map(tuple, rows))))
