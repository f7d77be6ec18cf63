"""Labels, referrals and learning sets against plain Python on random users."""

import random

import pytest
from pyspark.sql import functions as F

from visitweave.operators import grouped, labels, sequences, transfers
from visitweave.sources import visits as V


def _make(seed, users=25):
    """Events and visits, with shared times, short page lists and unsorted timestamps."""
    rnd = random.Random(seed)
    events, visits = [], []
    for u in range(users):
        n = 60 if u == 0 else rnd.randrange(0, 25)
        for i in range(n):
            events.append((f"u{u}", u * 1000 + i, rnd.randrange(40), rnd.choice("abcd")))
        for k in range(rnd.randrange(0, 14)):
            ts = [rnd.randrange(40) for _ in range(rnd.randrange(1, 6))]
            if rnd.random() < 0.7:
                ts.sort()
            pages = [rnd.choice("abcd") for _ in range(len(ts) - rnd.randrange(0, 2))]
            visits.append((f"u{u}", f"s{k}*", ts, rnd.choice(["a", "b", "c", "", None]), pages[0] if pages else None, pages))
    return events, visits


@pytest.fixture(scope="module", params=[1, 2])
def data(spark, request):
    events, visits = _make(request.param)
    ev = spark.createDataFrame(events, "user_id string, event_id long, ts_ms long, request_url string")
    ev = ev.withColumn("timestamp", F.col("ts_ms") / 1000.0).cache()
    vs = spark.createDataFrame(visits, "user string, site string, timestamps array<long>, sendingpage string, "
                                       "landingpage string, pages array<string>")
    return events, visits, ev, V.visit_rows(vs)


def _ranked(visits):
    out = {}
    for v in sorted(visits, key=lambda v: (v[2][0], v[1])):
        out.setdefault(v[0], []).append(v)
    return out


def _labels(events, visits, url=False):
    got = {}
    for user, vs in _ranked(visits).items():
        for e in events:
            if e[0] != user:
                continue
            for rank, v in enumerate(vs[:8], 1):
                hit = (e[2], e[3]) in list(zip(v[2], v[5])) if url else e[2] in v[2]
                if hit:
                    got[e[1]] = rank
    return got


def _referrers(visits):
    got = {}
    for user, vs in _ranked(visits).items():
        for i, v in enumerate(vs):
            got[user, i + 1] = 0
            for j, o in enumerate(vs[:i]):
                if v[3] and any(p == v[3] and t < v[2][0] for t, p in zip(o[2], o[5])):
                    got[user, i + 1] = j + 1
    return got


@pytest.mark.parametrize("match", ["ms", "exact", "ts_url"])
def test_labels(data, match):
    events, visits, ev, vr = data
    got = {r.event_id: r.visit_rank for r in labels.visit_labels(ev, vr, match).collect()}
    assert got == _labels(events, visits, match == "ts_url")


@pytest.mark.parametrize("limit", [10**6, 5])
def test_referrals(data, limit):
    _, visits, _, vr = data
    hot = grouped.find_hot(vr, ["user_id"], limit)
    ranked = V.rank_visits(vr, hot)
    got = {(r.user_id, r.visit_rank): r.referrer_rank for r in transfers.referrals(ranked, hot).collect()}
    assert got == _referrers(visits)
    assert all(ref < rank for (_, rank), ref in got.items())


def _windows(events, lab, user_key, size):
    out, by_user = {}, {}
    for e in sorted((e for e in events if e[1] in lab), key=lambda e: (e[2], e[1])):
        past = by_user.setdefault(e[0], [])
        past.append((e[1], lab[e[1]]))
        out[e[1]] = [(-1, -1)] * (size - len(past)) + past[-size:]
    return out


@pytest.mark.parametrize("limit", [10**6, 10])
def test_multi_sets(data, limit):
    events, visits, ev, vr = data
    hot = grouped.find_hot(ev, ["user_id"], limit)
    lab, ref = _labels(events, visits), _referrers(visits)
    user = {e[1]: e[0] for e in events}
    start = {}
    for e in events:
        start[e[0]] = min(start.get(e[0], 10**9), e[2])
    want = _windows(events, lab, user, 32)
    ts = {e[1]: e[2] for e in events}
    got = sequences.multi_visit(ev, vr, hot=hot).collect()
    assert {r.event_id for r in got} == set(lab)
    for r in got:
        seq = [tuple(x) for x in r.sequence]
        assert len(seq) == 32 and seq[:-1] == want[r.event_id][:-1] and seq[-1] == (r.event_id, -1)
        assert r.label == lab[r.event_id] - 1 and r.one_hot == [int(i == r.label) for i in range(8)]
        assert r.rel_time == pytest.approx((ts[r.event_id] - start[r.user_id]) / 1000)
    got = sequences.multi_transfer(ev, vr, hot=hot).collect()
    assert {r.event_id for r in got} == set(lab)
    for r in got:
        assert [tuple(x) for x in r.sequence] == want[r.event_id]
        assert r.label == ref[r.user_id, lab[r.event_id]] and 0 <= r.label <= 7


@pytest.mark.parametrize("limit", [10**6, 10])
def test_single_visit_set(data, limit):
    events, visits, ev, vr = data
    hot = grouped.find_hot(ev, ["user_id"], limit)
    lab, ref, ranked = _labels(events, visits), _referrers(visits), _ranked(visits)
    kept = sorted((e for e in events if e[1] in lab), key=lambda e: (e[2], e[1]))
    want = {}
    for i, e in enumerate(kept):
        for rank in range(1, min(8, len(ranked[e[0]])) + 1):
            own = [o[1] for o in kept[:i] if o[0] == e[0] and lab[o[1]] == rank][-4:]
            seq = own + [e[1]]
            mine = lab[e[1]]
            label = 0 if mine == rank else 2 if ref[e[0], mine] == rank else 1
            want[rank, e[1]] = ([-1] * (5 - len(seq)) + seq, label)
    got = {(r.visit_rank, r.event_id): (r.sequence, r.label) for r in sequences.single_visit(ev, vr, hot=hot).collect()}
    assert got == want


def test_lists_keep_every_visit(data):
    _, visits, _, vr = data
    lists = V.user_visit_lists(vr, size=3).collect()
    ranked = _ranked(visits)
    assert max(len(r.visits) for r in lists) <= 3
    got = {}
    for r in sorted(lists, key=lambda r: r.part):
        got.setdefault(r.user_id, []).extend((v.site, v.visit_rank) for v in r.visits)
    assert got == {u: [(v[1], i + 1) for i, v in enumerate(vs)] for u, vs in ranked.items()}


def test_top_visits_are_cut_before_the_shuffle(data):
    plan = V.first_visits(data[3])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_unknown_mode_fails():
    with pytest.raises(KeyError):
        sequences.learning_set("other")
