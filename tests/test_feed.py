"""The dense feed, a trainer's batches, centroids of visits, saved models."""

import numpy as np
import pytest

from visitweave.operators import centroids, classifier, embeddings, grouped
from visitweave.sources import feed

SAMPLE = "user_id string, event_id long, ts_ms long, label int"
WINDOW = "user_id string, sample_id long, x array<array<float>>"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A feed of 40 users, 3 steps of 2 numbers, in files of 7 windows."""
    path = str(tmp_path_factory.mktemp("feed") / "f")
    samples = [(f"u{u}", e, 100 - e, (u + e) % 8) for u in range(40) for e in range(u % 6)]
    windows = [(u, e, [[float(u[1:]), float(e)], [0.5, -1.0], [float(e) / 3, 7.0]]) for u, e, _, _ in samples]
    feed.write(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(windows, WINDOW), path, 3, 2, shards=4, seed=3, file_rows=7)
    return path, {(u, e): label for u, e, _, label in samples}


def test_windows_come_back_where_the_keys_say(spark, written):
    path, labels = written
    rows = feed.read(spark, path).join(spark.read.parquet(f"{path}/keys"), ["shard", "place"]).collect()
    assert {(r.user_id, r.event_id): r.label for r in rows} == labels and len(rows) == len(labels)
    assert all(r.x == pytest.approx([float(r.user_id[1:]), r.event_id, 0.5, -1, r.event_id / 3, 7]) for r in rows)
    index = spark.read.parquet(f"{path}/index").collect()
    assert all(r.rows <= 7 and r.bytes == r.rows * (3 * 2 + 1) * 4 for r in index) and sum(r.rows for r in index) == len(labels)
    for u, own in {r.user_id: [x for x in rows if x.user_id == r.user_id] for r in rows}.items():
        own.sort(key=lambda r: r.place)
        assert [r.event_id for r in own] == sorted((r.event_id for r in own), reverse=True)   # time order
        assert len({r.shard for r in own}) == 1 and own[-1].place - own[0].place == len(own) - 1


@pytest.mark.parametrize("size", [1, 5, 7, 100])
def test_a_trainer_starts_at_any_batch(spark, written, size):
    path, labels = written
    open_ = feed.Feed(path)
    want = {(r.shard, r.place): (r.label, r.x) for r in feed.read(spark, path).collect()}
    seen = 0
    for shard in open_.shards:
        n = open_.rows(shard)
        for number in reversed(range(-(-n // size))):
            x, y = open_.batch(shard, number, size)
            assert x.shape[1:] == (3, 2) and len(x) == min(size, n - number * size)
            for i in range(len(x)):
                label, row = want[shard, number * size + i]
                assert (y[i], x[i].ravel().tolist()) == (label, row)
            seen += len(x)
        with pytest.raises(IndexError):
            open_.batch(shard, -(-n // size), size)
    assert seen == len(labels)


def test_the_same_seed_gives_the_same_order_and_hot_shards_too(spark, monkeypatch):
    samples = spark.createDataFrame([(f"u{u}", e, e, 0) for u in range(30) for e in range(5)], SAMPLE)
    one = {tuple(r) for r in feed.placed(samples, 2, 9).collect()}
    monkeypatch.setattr(grouped.find_hot, "__defaults__", (20,))
    assert {tuple(r) for r in feed.placed(samples, 2, 9).collect()} == one
    assert {tuple(r) for r in feed.placed(samples, 2, 8).collect()} != one


def test_an_empty_feed(spark, tmp_path):
    path = str(tmp_path / "none")
    feed.write(spark.createDataFrame([], SAMPLE), spark.createDataFrame([], WINDOW), path, 3, 2)
    assert feed.read(spark, path).count() == 0 and feed.Feed(path).shards == []


def test_a_saved_linear_model_scores_the_feed(spark, written, tmp_path):
    path, _ = written
    draw = np.random.default_rng(1)
    weights, bias = draw.normal(size=(8, 6)), draw.normal(size=8)
    classifier.save_linear(f"{tmp_path}/m/model.npz", weights, bias)
    for r in classifier.score_feed(feed.read(spark, path), f"{tmp_path}/m/model.npz", 6, 16).collect():
        want = weights @ np.array(r.x) + bias
        assert r.scores == pytest.approx(want.tolist()) and r.predicted == want.argmax()


@pytest.mark.parametrize("limit", [1_000_000, 9])
def test_centroids_of_visits_by_brute_force(spark, limit):
    draw = np.random.default_rng(4)
    rows = [(f"u{i % 3}", i, 1000 + i // 2, int(draw.integers(1, 9)), [float(x) for x in draw.integers(-2, 3, 3)]) for i in range(90)]
    events = spark.createDataFrame(rows, "user_id string, event_id long, ts_ms long, visit_rank int, vector array<float>")
    hot = grouped.find_hot(events, ["user_id"], limit)
    assert bool(hot.rows) == (limit == 9)
    found = centroids.running_centroids(events, 3, hot=hot)
    near = {(r.user_id, r.event_id): r.cosines for r in centroids.cosines(found, 3).collect()}
    got = {(r.user_id, r.event_id, r.of_visit): (r.n_before, r.centroid) for r in found.collect()}
    assert len(got) == 8 * len(rows)
    for user, event, ts, _, v in rows:
        for visit in range(1, 9):
            before = [x[4] for x in rows if x[0] == user and x[3] == visit and (x[2], x[1]) < (ts, event)]
            n, mean = got[user, event, visit]
            assert n == len(before) and (mean is None) == (n == 0)
            cosine = 0.0
            if n:
                want = np.mean(before, axis=0)
                assert mean == pytest.approx(want.tolist())
                norms = np.linalg.norm(want) * np.linalg.norm(v)
                cosine = float(np.dot(want, v) / norms) if norms else 0.0
            assert near[user, event][visit - 1] == pytest.approx(cosine)


def test_a_feed_meets_its_keys_without_a_broadcast(spark, written):
    path, labels = written
    rows = feed.with_keys(spark, path, feed.read(spark, path).select("shard", "place", "label", "x"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.user_id, r.event_id): r.label for r in rows.collect()} == labels


@pytest.mark.parametrize("twice", [1, 2])
def test_rows_take_their_cosine_from_the_list_of_the_event(spark, twice):
    rows = [("u", i, i, 1 + i % 3, [float(i % 4), 1.0 - i % 2]) for i in range(20)] * twice
    events = spark.createDataFrame(rows, "user_id string, event_id long, ts_ms long, visit_rank int, vector array<float>")
    found = centroids.running_centroids(events, 2)
    rows = centroids.with_cosines(found, 2)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    near = {r.event_id: r.cosines for r in centroids.cosines(found, 2).collect()}
    got = rows.collect()
    assert len(got) == 160 * twice and all(r.cosine == near[r.event_id][r.of_visit - 1] for r in got)
    assert sorted(r.n_before for r in got) == sorted(r.n_before for r in found.collect())


def _sliding(spark, n_users=6, n_events=40, steps=4):
    """Trailing windows of every event, the label of the newest hidden, and model rows of all but every ninth event."""
    own = {f"u{u}": [100 * u + e for e in range(n_events + u)] for u in range(n_users)}
    samples, rows = [], []
    for u, events in own.items():
        for i, e in enumerate(events):
            seen = events[max(0, i - steps + 1):i + 1]
            marks = [x % 8 for x in seen[:-1]] + [-1]
            samples.append((u, e, e, e % 8, [(-1, -1)] * (steps - len(seen)) + [*zip(seen, marks)]))
            rows += [] if e % 9 == 0 else [(u, e, [e / 3, float(u[1:]), -5.0])]
    rows.append(("u0", 100_000, [1.0, 2.0, 3.0]))
    return (spark.createDataFrame(samples, SAMPLE + ", sequence array<struct<event_id:long,label:int>>"),
            spark.createDataFrame(rows, "user_id string, event_id long, model_row array<double>"))


@pytest.mark.parametrize("file_rows, limit, batch", [(7, 1_000_000, 4 << 20), (300, 20, 100)])
def test_windows_laid_out_where_they_stay_are_the_same(spark, tmp_path, monkeypatch, file_rows, limit, batch):
    monkeypatch.setattr(grouped.find_hot, "__defaults__", (limit,))
    monkeypatch.setattr(embeddings, "DENSE_BATCH", batch)
    samples, rows = _sliding(spark)
    feed.write(samples, embeddings.dense(samples, rows, 4, 3), f"{tmp_path}/a", 4, 3, 2, 5, file_rows)
    feed.write(samples, lambda placed: embeddings.dense(placed, rows, 4, 3, feed.NEAR), f"{tmp_path}/b", 4, 3, 2, 5, file_rows)
    one, two = ({(r.user_id, r.event_id): (r.shard, r.place, r.label, r.x) for r in
                 feed.with_keys(spark, f"{tmp_path}/{p}", feed.read(spark, f"{tmp_path}/{p}")).collect()} for p in "ab")
    assert one == two and len(one) == samples.count() and any(-1 not in v[3][:-1] for v in two.values())
    kept = [{(r.shard, r.file): (r.first, r.rows, r.bytes, r.checksum) for r in spark.read.parquet(f"{tmp_path}/{p}/index").collect()} for p in "ab"]
    assert kept[0] == kept[1]


def test_no_window_is_shuffled_and_a_model_row_travels_once_to_a_group(spark):
    samples, rows = _sliding(spark)
    placed = feed._with_place(samples, 2, 5).selectExpr("*", "floor(place / 100) file")
    made = embeddings.dense(placed, rows, 4, 3, feed.NEAR)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "x#" in plan.splitlines()[0] and not any("x#" in line for line in plan.splitlines()[1:])
    assert "collect_list" not in plan and "Aggregate [shard" in plan


def test_neighbouring_windows_are_packed_into_less(spark, tmp_path):
    """Blocks of several windows that share all but one row; a trainer's batches begin and end inside them."""
    wide = 50
    numbers = np.random.default_rng(2).normal(size=(700 + 32, wide)).astype("f4").tolist()
    samples = spark.createDataFrame([("u", i, i, i % 8) for i in range(700)], SAMPLE)
    windows = spark.createDataFrame([("u", i, numbers[i:i + 32]) for i in range(700)], WINDOW)
    path = str(tmp_path / "f")
    feed.write(samples, windows, path, 32, wide, shards=1, seed=3)
    size = sum(f.stat().st_size for f in tmp_path.glob("f/blocks/*/*") if not f.name.startswith("."))
    assert size < 700 * 32 * wide * 4 / 10
    entry, = spark.read.parquet(f"{path}/index").collect()
    assert len(entry.ends) == 3 and entry.ends[-1] + 4 * 700 == size
    open_ = feed.Feed(path)
    for n in (100, 256, 699):
        for number in range(-(-700 // n)):
            x, y = open_.batch(0, number, n)
            assert y.tolist() == [i % 8 for i in range(number * n, min(700, (number + 1) * n))]
            assert all((x[i] == np.array(numbers[number * n + i:number * n + i + 32], "f4")).all() for i in range(len(x)))
