"""Groups that are too large for one task give the same rows as ordinary ones."""

import random

import pytest
from pyspark.sql import functions as F

from visitweave.operators import grouped
from visitweave.operators.grouped import Running

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    # User "a" holds most rows, many of them at the very same time.
    rnd = random.Random(3)
    data = [(u, rnd.choice([5, 5, 5, rnd.randrange(100)]), i, rnd.randrange(10))
            for i, u in enumerate(["a"] * 400 + ["b"] * 30 + ["c"] * 7 + [None] * 90)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "u string, t long, id long, x long").repartition(5).cache()


def _by_user(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.t, r.id)):
        out.setdefault(r.u, []).append(r)
    return out


def test_finds_only_large_groups(rows):
    hot = grouped.find_hot(rows, ["u"], 50)
    assert {r[0] for r in hot.frame.collect()} == {"a", None} and hot.rows == 490
    assert grouped.find_hot(rows, ["u"], 1000).rows == 0


@pytest.mark.parametrize("limit", [10**6, 50, 10])
def test_running_values(rows, limit):
    hot = grouped.find_hot(rows, ["u"], limit)
    got = grouped.running(rows, ["u"], ORDER, {
        "n": Running("count"), "s": Running("sum", F.col("x")),
        "before": Running("sum", F.col("x"), inclusive=False),
        "top": Running("max", F.when(F.col("x") < 9, F.col("x"))),
        "seen": Running("count", inclusive=False)}, hot).collect()
    assert len(got) == 527
    by_id = {r.id: r for r in got}
    for user in _by_user(rows).values():
        total, top = 0, None
        for i, r in enumerate(user):
            g = by_id[r.id]
            assert g.before == (total if i else None) and g.seen == i and g.n == i + 1
            total += r.x
            if r.x < 9:
                top = r.x if top is None else max(top, r.x)
            assert g.s == total and g.top == top


@pytest.mark.parametrize("limit", [10**6, 50])
def test_previous_row(rows, limit):
    got = grouped.previous(rows, ["u"], ORDER, {"px": "x"}, grouped.find_hot(rows, ["u"], limit)).collect()
    by_id = {r.id: r.px for r in got}
    for user in _by_user(rows).values():
        assert [by_id[r.id] for r in user] == [None] + [r.x for r in user[:-1]]


@pytest.mark.parametrize("limit,size", [(10**6, 32), (50, 1), (50, 4), (3, 32)])
def test_trailing_windows(rows, limit, size):
    got = grouped.trailing(rows, ["u"], ORDER, size, F.col("id"), "w", grouped.find_hot(rows, ["u"], limit)).collect()
    assert len(got) == 527
    by_id = {r.id: r.w for r in got}
    for user in _by_user(rows).values():
        ids = [r.id for r in user]
        for i, r in enumerate(user):
            assert by_id[r.id] == ids[max(0, i - size + 1):i + 1]


@pytest.mark.parametrize("limit,size,step", [(10**6, 4, 3), (10**6, 3, 5), (10**6, 500, 1), (20, 4, 3), (20, 5, None)])
def test_strided_windows(rows, limit, size, step):
    got = grouped.strided(rows, ["u"], ORDER, size, step, F.col("id"), grouped.find_hot(rows, ["u"], limit)).collect()
    step = step or size
    want = set()
    for u, user in _by_user(rows).items():
        ids = [r.id for r in user]
        n = (len(ids) - size) // step + 1 if len(ids) >= size else 0
        want |= {(u, k, tuple(ids[k * step:k * step + size])) for k in range(n)}
    assert {(r.u, r.window_no, tuple(r["items"])) for r in got} == want


@pytest.mark.parametrize("limit", [10**6, 20])
def test_whole_table_as_group(rows, limit):
    out = grouped.position(rows, [], ORDER, "n", grouped.find_hot(rows, [], limit)).collect()
    assert [r.id for r in sorted(out, key=lambda r: r.n)] == [r.id for r in sorted(out, key=lambda r: (r.t, r.id))]


def test_ordinary_groups_are_dealt_to_as_many_tasks_as_their_rows_need(spark, rows, monkeypatch):
    hot = grouped.find_hot(rows, ["u"], 450)
    assert hot.total == 527 and hot.rows == 0
    want = {(r.id, r.n) for r in grouped.position(rows, ["u"], ORDER, "n", hot).collect()}
    monkeypatch.setattr(grouped, "TASK_ROWS", 5)
    few = grouped.find_hot(rows, ["u"], 450)._replace(limit=20)
    once = grouped.position(rows, ["u"], ORDER, "n", few)
    again = grouped.position(once, ["u", "x"], ORDER, "m", few)
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(u") == 1
    assert once.rdd.getNumPartitions() == 106 and again.rdd.getNumPartitions() == 106
    assert {(r.id, r.n) for r in again.collect()} == want
