"""The prefix trie and the filter audit against brute force."""

import random
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

from tests.compare import compare, connection
from tests.llm.helpers import WORD, documents, odd_documents
from visitweave.llm import filter_audit as A, prefix_trie as T
from visitweave.llm.common import attach

TURNS = "conv_id long, turn long, role string, text string, depth int, conv string, k int, words string"


def conversations(spark, rows):
    """Turns with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "c", 2, "w") for r in rows], TURNS)


def plain_trie(rows):
    """Every node by walking all rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x[1] for x in sorted(r, key=lambda x: x[0])] for c, r in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    children, leaves, saved = {}, {}, {}
    for path, members in nodes.items():
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        gain = (len(members) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + gain
    for path, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(members) if built[c] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children.get(path, 0),
                    leaves[path], saved[path], sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(turns, **sizes):
    if sizes:
        built, convs = T.rebuild(turns)
        nodes = T.trie(built, convs, **sizes)
    else:
        nodes = T.trie(*T.rebuild(turns))
    return sorted((tuple(r) for r in nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def drawn_turns(seed, n=90, longest=9):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(200), n):
        for t in range(draw.choice([1, 2, 3, longest])):
            rows.append((c, t, draw.choice(["user", "assistant"]) if t else "user", f"say {'x ' * draw.randrange(2)}"))
    return rows + [(c, t, "user", "the same") for c in range(300, 340) for t in range(7)]


def test_trie_same_as_sql(spark, sf):
    assert compare(T.op12_prefix_ranges(spark, sf), connection(sf), T.OP12_SQL) is None


@pytest.mark.parametrize("sizes", [{"stretch": 128, "block_units": 7}, {"stretch": 2, "block_units": 11}])
def test_trie_by_brute_force(spark, sizes):
    rows = drawn_turns(len(sizes) + sizes.get("stretch", 0))
    assert found_trie(conversations(spark, rows[::-1]), **sizes) == plain_trie(rows)


def test_long_conversations_in_many_stretches(spark):
    rows = [(c, t, "user", f"turn {t if t < stop else (t, c)}") for c, stop in ((20, 90), (40, 90), (41, 33), (60, 16))
            for t in range(90)]
    assert found_trie(conversations(spark, rows), stretch=4, block_units=5) == plain_trie(rows)


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "nobody"), (1, None, None, None), (1, 0, "user", "a"), (2, 0, None, ""), (3, 5, "user", "w " * 50_000),
            (4, 1, "user", "b"), (4, 1, "user", "b"), (-7, 0, "user", "minus"), (20, 0, "user", "one"), (21, 0, "user", "own")]
    plain = [r for r in rows if r[0] != -7]
    got = found_trie(conversations(spark, rows))
    assert sum(r[1] == 0 for r in got) == 1 and got[[r[1] for r in got].index(0)][3] == 7
    assert found_trie(conversations(spark, plain)) == plain_trie(plain)
    assert found_trie(conversations(spark, rows[:1])) == []


def test_range_minima_find_what_a_walk_finds():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 5, 200)
    values[0] = -1
    minima = T.Minima(values)
    at, least = np.repeat(np.arange(200), 5), np.tile(np.arange(5), 200)
    left, right = minima.left(at, least), minima.right(at, least)
    for i, d, lo, hi in zip(at, least, left, right):
        assert lo == next(p for p in range(i, -1, -1) if p == 0 or values[p - 1] < d)
        assert hi == next(p for p in range(i, 200) if p == 199 or values[p + 1] < d)
    low, high = np.minimum(at, np.roll(at, 77)), np.maximum(at, np.roll(at, 77))
    assert minima.between(low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]


def plain_audit(rows, labels):
    """``rows(doc_id, source, text)``: the filters applied one after another, for every order."""
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    judged = []
    for i, source, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= x <= "Z" for x in text) > 2 * len(text), "D": any(x in "#$%&*|" for x in text),
                 "E": i is not None and text in first and first[text] < i}
        judged.append((source or "", fails, (i, "q") in labels, (i, "t") in labels))
    out = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        rows_of, sums = [], {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [j for j in left if j[1][f]]
                kept = [j for j in left if not j[1][f]]
                sums[f] = sums.get(f, 0) + len(gone)
                rows_of.append([part, "".join(order), step + 1, len(kept), len(gone),
                                sum(j[1][f] for j in own) - len(gone), sum([x for x in "ABCDE" if j[1][x]] == [f] for j in own),
                                sum(j[2] for j in gone), sum(j[3] for j in gone), f])
                left = kept
        out += [(*r[:-1], sums[r[-1]]) for r in rows_of]
    return sorted(out)


def found_audit(docs, labels):
    return sorted(tuple(r) for r in A.report(A.survivors(A.labelled(A.judged(docs), labels))).collect())


LABELS = "doc_id long, quality int, toxic int, part string, word string"


def test_audit_same_as_sql(spark, sf):
    assert compare(A.op13_survival_words(spark, sf), connection(sf), A.OP13_SQL) is None


def test_audit_by_brute_force(spark):
    draw = random.Random(5)
    texts = ["", "A b", "w " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(230)), "x # y",
             "x\x0by z" * 90]
    rows = [(draw.randrange(70), draw.choice([None, "", "s1", "s2"]), draw.choice([*texts, None])) for _ in range(150)]
    rows += [(None, "s1", texts[3]), (None, None, texts[3])]
    labels = [(draw.randrange(70), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(50)] + [(None, 1, 1)]
    said = {(i, k) for i, q, t in labels if i is not None for k, v in (("q", q), ("t", t)) if v == 1}
    docs = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, source string, text string, key string, word long")
    table_of = spark.createDataFrame([(*r, "p", "w") for r in labels], LABELS)
    assert found_audit(docs, table_of) == plain_audit(rows, said)


def test_audit_of_odd_documents(spark):
    df, none = odd_documents(spark), spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.source, r.text) for r in df.collect()]
    assert found_audit(df, none) == plain_audit(rows, set())
    assert found_audit(df.limit(0), none) == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 100_003])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    sums = A.CarrySave()
    for part in np.array_split(words, 3):
        sums.add(part)
    assert sums.counts().tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_hot_keys_are_attached_like_others(spark):
    rows = spark.range(5000).selectExpr("id", "case when id < 2000 then 0 when id < 2004 then null else id end as key")
    facts = rows.groupBy("key").count().filter("key % 3 = 0").selectExpr("key", "count as weight", "key * 2 as twice")
    got = {r.id: r.twice for r in attach(rows, facts, ["key"], "weight", 5000).collect()}
    keys = {i: 0 if i < 2000 else None if i < 2004 else i for i in range(5000)}
    assert got == {i: k * 2 if k is not None and k % 3 == 0 else None for i, k in keys.items()}
