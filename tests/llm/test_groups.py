"""Near duplicates, shards and fingerprints against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash

from tests.compare import compare, connection
from tests.llm.helpers import PROSE, documents, odd_documents, shingle_set, smallest_reachable
from visitweave.llm import near_dedup as N, order_minhash as O, sharding as S
from visitweave.llm.common import range_numbers, ranges_for, sift
from visitweave.llm.components import components


def test_near_duplicates_same_as_sql(spark, sf):
    assert compare(N.op9_odd_sketches(spark, sf), connection(sf), N.OP9_SQL) is None


def near_copies(n, edits, seed):
    """Copies of one text with up to ``edits`` words replaced, so only some pairs are linked."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(500)}" for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(words)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(150)] = f"new{draw.random()}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("edits", [2, 5, 9])
def test_large_group_of_near_copies(spark, edits):
    texts = near_copies(250, edits, edits) + near_copies(30, 3, 77) + [f"alone {i} " * 9 for i in range(20)]
    texts += texts[:40]
    df = documents(spark, list(enumerate(texts)))
    want = smallest_reachable({i: shingle_set(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in N.duplicates(df).collect()} == want


def test_looser_links_of_wider_shingles(spark):
    texts = near_copies(120, 6, 5) + near_copies(60, 9, 6) + ["a b c d", "a b c d", "a b c d e"]
    want = smallest_reachable({i: shingle_set(t, 5) for i, t in enumerate(texts)}, 80)
    got = N.duplicates(documents(spark, list(enumerate(texts))), link=80, width=5).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, 5)) for i, t in enumerate(texts)}


def test_near_duplicates_of_odd_documents(spark):
    df = odd_documents(spark)
    got = {r.doc_id: r for r in N.duplicates(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert N.duplicates(df).count() == df.count()
    for i, r in got.items():
        assert r.n_shingles == len(shingle_set(texts[i]))
    assert got[6].component_id == 5 and not got[6].kept
    assert all(got[i].kept and got[i].component_id == i and got[i].n_shingles == 0 for i in (1, 2, 3))
    kept = N.keep(df)
    assert kept.columns == df.columns and N.duplicates(df.limit(0)).count() == 0 and N.keep(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def plain_groups(rows, link, width):
    """Group number of every row by comparing all pairs of rows; none for a row without words."""
    sets = {i: shingle_set(t, width) for i, (_, t) in enumerate(rows)}
    return {i: g if sets[i] else None for i, g in smallest_reachable(sets, link).items()}


@pytest.mark.parametrize("link, width", [(85, 3), (80, 5)])
def test_rows_without_and_with_shared_doc_ids(spark, link, width, monkeypatch):
    near = near_copies(12, 1, 3)
    rows = [(None, PROSE), (5, PROSE), (6, PROSE), (7, "u " * 9), (7, PROSE + "and so on"), (7, PROSE + "and so on"), (8, near[0]),
            (8, near[1]), (None, near[2]), (None, near[2]), (9, near[3]), (None, "alone " * 4), (None, "alone " * 4), (None, None),
            (3, ""), (3, ""), (4, None), (2, "a b c d e f"), (2, "g h i j k l"), (2, "g h i j k l"), (11, near[4])]
    groups = plain_groups(rows, link, width)
    named = {}
    for i, g in groups.items():
        if g is not None and rows[i][0] is not None:
            named[g] = min(rows[i][0], named.get(g, rows[i][0]))
    want = sorted(((d, len(shingle_set(t, width)), d if groups[i] is None else named.get(groups[i])) for i, (d, t) in enumerate(rows)), key=str)
    df = documents(spark, rows)
    for listed in (200_000, 1):                       # a list of keys, and a bitmap
        monkeypatch.setattr("visitweave.llm.common.LISTED", listed)
        if listed == 1:
            got = N.duplicates(df, link, width).collect()
            assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
            assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        kept = N.keep(df, link, width)
        assert kept.columns == df.columns
        rest = [(r.doc_id, r.text) for r in kept.collect()]
        assert [rest.count(x) for x in set(rest)] == [rows.count(x) if not shingle_set(x[1], width) else 1 for x in set(rest)]
        assert {x for x in rest if not shingle_set(x[1])} == {r for r in rows if not shingle_set(r[1])}
        first = {}
        for i, g in groups.items():
            if g is not None:
                order = (rows[i][0] is None, rows[i][0] or 0)
                first[g] = min(order, first.get(g, order))
        ids = sorted((d is None, d or 0) for d, t in rest if shingle_set(t, width))
        assert ids == sorted(first.values())
        assert {groups[rows.index(x)] for x in rest} - {None} == set(first)


def test_sifting_lets_all_wanted_through(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "id * 7 as other")
    wanted = spark.range(0, 3000, 5).selectExpr("id", "id * 7 as other")
    for listed in (200_000, 1):
        monkeypatch.setattr("visitweave.llm.common.LISTED", listed)
        inside = {r.id for r in sift(rows, wanted, ["id", "other"]).collect()}
        outside = {r.id for r in sift(rows, wanted, ["id", "other"], inside=False).collect()}
        assert inside >= set(range(0, 3000, 5)) and len(inside) < 900
        assert inside | outside == set(range(3000)) and not inside & outside


def test_capital_letters_beyond_ascii_are_kept_apart(spark):
    got = N.duplicates(documents(spark, [(1, "Été a b c d"), (2, "été a b c d"), (3, "ÉTé A B C D"), (4, "Été A B C D")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_odd_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    for share in (0.8, 0.85, 0.9, 0.95):
        errors = []
        for _ in range(30):
            x = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
            common = round(2000 * share / (1 + share))
            a, b = x, np.concatenate([x[:common], draw.integers(0, 1 << 63, 1000 - common, dtype=np.uint64)])
            z = sum(int(v).bit_count() for v in (N.odd_sketch(N.samples(a)) ^ N.odd_sketch(N.samples(b))).view(np.uint64))
            errors.append(N.estimate(z) - common / (2000 - common))
        assert abs(np.mean(errors)) < 0.015 and np.max(np.abs(errors)) < 0.075


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(4).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i % 40}" if i < 120 else f"single {i}") for i in range(500)] + [(500 + i, "hot") for i in range(90)]
    got = S.shard_documents(documents(spark, rows)).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1 and set(got.law) == {"rows"}
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    texts = dict(rows)
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 8 and r.text_crc32 == crc32(data)
    spread = got.assign(text=got.doc_id.map(texts)).groupby("text").shard.nunique()
    assert spread.pop("hot") <= 7                       # 90 copies need four shards of 24 or 25
    assert (spread == 1).mean() > 0.9


def test_moves_cut_fewer_links_than_the_start(spark):
    units = spark.createDataFrame([(f"k{i}", s, 1 + (i + s) % 3) for i in range(60) for s in range(i % 5, 24, 5)],
                                  "key string, start int, weight long")
    total = units.agg({"weight": "sum"}).first()[0]
    got = S.propagate(units, 1.3 * total / 24).toPandas()
    assert got.groupby("shard").weight.sum().max() <= max(1.3 * total / 24, got.groupby("start").weight.sum().max())
    assert got.groupby("key").shard.nunique().mean() < 0.5 * got.groupby("key").start.nunique().mean()


def plain_hash(*values):
    """Strings as UTF-8 and 32-bit numbers, each hashed with the hash of those before it as seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_propagation(units, capacity):
    """Label propagation unit by unit: ``{(key, start): shard}`` and the number of rounds."""
    shard, weight = {(k, s): s for k, s, _ in units}, {(k, s): w for k, s, w in units}
    for number in itertools.count():
        held, full, largest = Counter(), Counter(), Counter()
        for (k, s), at in shard.items():
            w = weight[k, s]
            held[k, at] += w
            full[at] += w
            largest[k] = max(largest[k], w)
        rank = {(k, at): (n, plain_hash(k, at, number)) for (k, at), n in held.items()}
        best = {}
        for (k, at), r in rank.items():
            if full[at] + largest[k] <= capacity:
                best[k] = max(best.get(k, (r, at)), (r, at))
        asked = defaultdict(list)
        for (k, s), at in shard.items():
            if k in best and best[k][1] != at and best[k][0] > rank[k, at]:
                gain = math.floor(2 * math.log2(best[k][0][0] / rank[k, at][0]) + 0.5)
                asked[best[k][1]].append(((15 - min(15, max(0, gain))) * 256 + plain_hash(k, s, number) % 256, k, s))
        if not asked:
            return shard, number
        moves = []
        for to, own in asked.items():
            for step in sorted({x for x, _, _ in own}):
                if full[to] + sum(weight[k, s] for x, k, s in own if x <= step) <= capacity:
                    moves += [(k, s, to) for x, k, s in own if x == step]
        for k, s, to in moves or [(*min(own)[1:], to) for to, own in asked.items()]:
            shard[k, s] = to


@pytest.mark.parametrize("seed, shards, room", [(1, 6, 1.1), (2, 4, 1.02), (3, 24, 3.0)])
def test_propagation_by_brute_force(spark, seed, shards, room):
    draw = random.Random(seed)
    units = [(f"k{i}", s, draw.choice([1, 1, 2, 9])) for i in range(40) for s in range(shards) if draw.random() < 0.4]
    units += [("hot", s, 60) for s in range(shards)]
    capacity = room * sum(w for *_, w in units) / shards
    want, rounds = plain_propagation(units, capacity)
    got = S.propagate(spark.createDataFrame(units, "key string, start int, weight long"), capacity).collect()
    assert {(r.key, r.start): r.shard for r in got} == want and rounds > 1
    # Nothing can move any more.
    held, full = Counter(), Counter()
    for r in got:
        held[r.key, r.shard] += r.weight
        full[r.shard] += r.weight
    largest = {k: max(w for x, _, w in units if x == k) for k in {k for k, *_ in units}}
    for (k, at), n in held.items():
        if full[at] + largest[k] <= capacity:
            assert all(n <= m for (x, s), m in held.items() if x == k and s != at)


def test_one_heavy_step_does_not_end_the_rounds(spark):
    """All units that ask share a step, and together they are too much for the shard."""
    units = [("a", 0, 3), *[("a", s, 2) for s in range(1, 9)]]
    got = S.propagate(spark.createDataFrame(units, "key string, start int, weight long"), 7.0).toPandas()
    assert got.groupby("shard").weight.sum().max() == 7


def test_shards_of_odd_documents(spark):
    df = odd_documents(spark)
    got = S.shard_documents(df).toPandas()
    assert len(got) == df.count() and got.groupby("shard").size().max() == 1 and (got.slot == 0).all()
    assert got[got.doc_id.isin([1, 2])]["size"].tolist() == [8, 8]
    assert S.shard_documents(df.limit(0)).count() == 0


def plain_fingerprint(text):
    """Order MinHash with one k-mer after another."""
    h, seen, numbered = O.kmers(text), {}, []
    for x in h.tolist():
        numbered.append((x, seen.setdefault(x, 0)))
        seen[x] += 1
    mixed = O._spread(np.array([(x + n * int(O._TURN)) % (1 << 64) for x, n in numbered], np.uint64)) >> np.uint64(32)
    out = []
    for factor in O._FACTORS[:, 0].tolist():
        order = sorted(range(len(h)), key=lambda i: (int(mixed[i]) * factor % (1 << 32), i))[:O.PICKED]
        total = np.full(1, np.uint64(len(h) < O.PICKED))
        for i in sorted(order):
            total = O._spread(total * O._TURN + h[i:i + 1])
        out.append(int(total[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi", "ab" * 40, PROSE, "été ß 😀 x" * 30, "x" * 9000])
def test_fingerprint_by_brute_force(text):
    assert O.fingerprint(text).tolist() == plain_fingerprint(text)


def test_fingerprints_feel_the_order_of_text():
    draw = random.Random(2)
    words = [f"w{draw.random()}" for _ in range(400)]
    text, turned = " ".join(words), " ".join(words[200:] + words[:200])
    edited = " ".join(words[:300] + [f"w{draw.random()}" for _ in range(100)])
    a = O.fingerprint(text)
    assert O.likeness(a, O.fingerprint(edited)) > 0.2
    assert O.likeness(a, O.fingerprint(turned)) < 0.8      # the same k-mers, in another order
    assert O.likeness(a, O.fingerprint(" ".join(reversed(words)))) < 0.7


def test_edited_texts_and_next_documents(spark):
    rows = [(10 * i, x) for i, x in enumerate([PROSE * 3, None, "abcde", "", "xy" * 50, "é😀" * 20, PROSE])]
    got = {r.doc_id: r for r in O.fingerprints(documents(spark, rows[::-1]), range_bytes=50).collect()}
    texts = [t or "" for _, t in rows]
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert r.fingerprint == O.fingerprint(text).tobytes().hex()
        assert r.near_next == O.likeness(O.fingerprint(text), O.fingerprint(after))


def test_ranges_follow_the_bytes_up_to_a_number(spark):
    df = documents(spark, [(i, "x" * 84) for i in range(200)])
    assert [ranges_for(df, size) for size in (1 << 24, 10_000, 100)] == [1, 2, 200]
    assert ranges_for(df, 100, most=7) == 7 and ranges_for(df.limit(0)) == 1
    assert ranges_for(documents(spark, [(i, None) for i in range(100)]), 100) == 16
    dealt = range_numbers(df.select("doc_id", "text"), "doc_id", 7).groupBy("_range").count().collect()
    assert len(dealt) == 7 and max(r["count"] for r in dealt) < 60


def test_fingerprints_of_odd_documents(spark):
    df = odd_documents(spark)
    got = O.fingerprints(df, range_bytes=100).collect()
    assert len(got) == df.count() and len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert O.fingerprints(df.limit(0)).count() == 0 and O.fingerprints(df.limit(1)).first().near_next == 1.0
