"""Vectors near each other, against all pairs."""

import numpy as np
import pytest

from tests.compare import compare, connection
from visitweave.llm import grid_join as G

VECTORS = "vec_id long, embedding array<double>, label int, node long, block int, weight string"


def vectors(spark, rows):
    """Vectors with extra columns of clashing names."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, "w")
                                  for i, v, label in rows], VECTORS)


def plain(rows, limit=0.98):
    """``{(vec_id, n_links, component_id, kept)}`` by comparing all pairs of rows."""
    n = len(rows)
    ok = [i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
          and any(x != 0 for x in v) for i, v, label in rows]
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], float) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if G.cosine(x, y) >= limit:
                    links[a] += 1
                    links[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[root(i)] = min(rows[i][0], smallest.get(root(i), rows[i][0]))
    first = [smallest.get(root(i)) for i in range(n)]
    return sorted([(rows[i][0], links[i], first[i], rows[i][0] == first[i]) for i in range(n)], key=str)


def found(df, **options):
    return sorted((tuple(r) for r in G.linked(df, **options).collect()), key=str)


def clustered(seed, n=260, dims=24):
    """Centres with near copies at all distances around the limit, exact copies and multiples."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[draw.integers(6)] + draw.normal(size=dims) * draw.choice([0.05, 0.12, 0.2, 1.0])
        rows.append((i, v.tolist(), int(draw.integers(2))))
    return rows + [(n + i, rows[i % 9][1], rows[i % 9][2]) for i in range(60)] + [
        (n + 100 + i, (np.array(rows[i][1]) * 3.5).tolist(), rows[i][2]) for i in range(8)]


def test_vectors_same_as_sql(spark, sf):
    assert compare(G.op11_grid_order(spark, sf), connection(sf), G.OP11_SQL) is None


@pytest.mark.parametrize("block_rows", [1, 40])
def test_links_and_components_by_brute_force(spark, block_rows):
    rows = clustered(block_rows, n=60 if block_rows == 1 else 260)
    want = plain(rows)
    assert any(r[1] > 3 for r in want) and any(r[1] == 0 for r in want)
    assert found(vectors(spark, rows[::-1]), block_rows=block_rows) == want


def test_a_large_group_of_near_copies(spark):
    draw = np.random.default_rng(8)
    centre = draw.normal(size=32)
    rows = [(i, (centre + 0.13 * draw.normal(size=32)).tolist(), 1) for i in range(700)] + [
        (1000 + i, draw.normal(size=32).tolist(), 1) for i in range(100)]
    assert found(vectors(spark, rows), block_rows=150) == plain(rows)


def test_chains_over_many_blocks(spark):
    angles = [i * 0.19 for i in range(33)]                       # neighbours are linked, second neighbours are not
    rows = [(100 - i, [np.cos(x), np.sin(x), 0.0], 4) for i, x in enumerate(angles)]
    got = found(vectors(spark, rows), block_rows=3)
    assert got == plain(rows) and {r[2] for r in got} == {68}


def test_cosines_at_the_limit(spark):
    rows = [(1, [1.0, 0, 0], 1), (2, [49.0, float(np.sqrt(50 * 50 - 49 * 49)), 0], 1), (3, [0.98, float(np.sqrt(1 - 0.98 ** 2)), 0], 1),
            (4, [3.0, 4.0, 0.0], 2), (5, [3.0, 4.0, 1.0], 2)]
    assert found(vectors(spark, rows)) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0, 0, 0], 1), (4, [1, None, 0], 1), (5, [1, nan, 0], 1), (6, [1, inf, 0], 1),
            (7, [1, 0, 0], None), (None, [1, 0, 0], 1), (8, [1, 0, 0], 1), (9, [1, 0, 0], 1), (9, [1, 0, 0], 1), (9, [0, 1, 0], 1),
            (10, [1, 0], 1), (11, [1e-300, 0, 0], 1), (12, [1e300, 1e290, 0], 1), (13, [-1, 0, 0], 1), (14, [1, -0.0, 0], 1),
            (15, [1, 0, 0], 2)]
    df = vectors(spark, rows)
    assert found(df) == plain(rows) and found(df.limit(0)) == []
    assert found(vectors(spark, rows[:7])) == plain(rows[:7])
