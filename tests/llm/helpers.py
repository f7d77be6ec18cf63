"""Small documents with every odd case, and plain-Python counterparts."""

from __future__ import annotations

import re

DOC = "doc_id long, text string, lang string, source string, n_chars long, _range int, key string, shard int, node long"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
PROSE = ("The river ran past the old mill and the people of the town said that it was as high as it had been "
         "in a hundred years, for the rain had not stopped since the day before. ")


def documents(spark, rows):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``, with extra columns of clashing names."""
    whole = [(i, t, *(rest or ("en",)), "s", len(t or ""), 7, "k", 3, 5) for i, t, *rest in rows]
    return spark.createDataFrame(whole, DOC)


def odd_documents(spark):
    """Nulls, an empty, a blank and a very long text, ties, and rows that come twice."""
    return documents(spark, [
        (1, None), (2, ""), (3, " \t\n "), (4, "word " * 60_000), (5, PROSE * 4), (6, PROSE * 4), (6, PROSE * 4),
        (7, "été ß 😀 x" * 30), (None, "no number"), (8, "one"), (9, "\x1c a\x85b c　d"), (10, "<|endoftext|> A  b\n c ")])


def lower(text):
    """Lower-cased A-Z only."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, width=3):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked(a, b, link=85):
    return bool(a and b) and 100 * len(a & b) >= link * len(a | b)


def smallest_reachable(sets, link=85):
    """Component of every document by comparing all pairs: ``{doc_id: smallest doc_id}``."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if linked(sets[i], sets[j], link):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
