"""Daily tables, the growing dictionary and merged bitmaps."""

import uuid

import pytest
from pyspark.sql import functions as F

from visitweave.config import NO_DOMAIN
from visitweave.operators import domains, grouped, stats
from visitweave.sources import days

DAY_MS = 86_400_000


def events(spark, rows):
    return days.with_key(spark.createDataFrame(rows, "user_id string, ts_ms long, n int"))


@pytest.fixture()
def tables(spark, tmp_path):
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    ev = events(spark, [(f"u{i % 9}", (i % 4) * DAY_MS + i, i) for i in range(200)])
    vis = days.with_key(spark.createDataFrame([(f"u{u}", d * DAY_MS, f"{u}/{d}") for u in range(7) for d in range(4)],
                                              "user_id string, ts_ms long, visits string")).drop("ts_ms")
    for name, df in zip(names, (ev, vis)):
        days.create(df, name, str(tmp_path / name), 8)
        days.write(df, name, 8)
    yield names, ev, vis, tmp_path
    for name in names:
        spark.sql(f"drop table if exists {name}")


def test_day_is_utc(spark):
    got = events(spark, [("u", 0, 1), ("u", DAY_MS - 1, 2), ("u", DAY_MS, 3)]).orderBy("n").collect()
    assert [(r.day, r.user_day) for r in got] == [("1970-01-01", "u|1970-01-01")] * 2 + [("1970-01-02", "u|1970-01-02")]


def test_joins_without_an_exchange(spark, tables):
    names, ev, vis, _ = tables
    joined = days.records(spark, *names)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as for tables that are not small
    try:
        assert {(r.user_id, r.n, r.visits) for r in joined.collect()} == {
            (r.user_id, r.n, r.visits) for r in ev.join(vis.drop("day", "user_id"), days.KEY).collect()}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        one = joined.filter("day = '1970-01-02'")
        assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_day_is_replaced_alone(spark, tables):
    names, ev, _, _ = tables
    days.write(events(spark, [("new", DAY_MS, 1000)]), names[0], 8)
    got = {(r.user_id, r.n) for r in spark.table(names[0]).collect()}
    assert got == {(r.user_id, r.n) for r in ev.collect() if r.day != "1970-01-02"} | {("new", 1000)}


def test_another_session_finds_the_table(spark, tables):
    names, ev, _, folder = tables
    name = f"t_{uuid.uuid4().hex}"
    days.attach(spark, "user_id string, ts_ms long, n int, user_day string, day string", name, str(folder / names[0]), 8)
    assert spark.table(name).count() == ev.count()
    days.write(events(spark, [("new", 9 * DAY_MS, 1)]), name, 8)
    assert spark.table(name).count() == ev.count() + 1
    spark.sql(f"drop table {name}")


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_ids_stay_when_the_dictionary_grows(spark, monkeypatch, limit):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    monkeypatch.setattr(grouped.find_hot, "__defaults__", (limit,))
    one = {r.domain: r.domain_id for r in domains.dictionary(df("b.com", "d.com", "b.com")).collect()}
    old = spark.createDataFrame(list(one.items()), "domain string, domain_id long")
    two = {r.domain: r.domain_id for r in domains.grown(old, df("c.com", "b.com", "a.com", "e.com", "a.com", None)).collect()}
    assert one == {NO_DOMAIN: 0, "b.com": 1, "d.com": 2} and two == one | {"a.com": 3, "c.com": 4, "e.com": 5}
    assert domains.grown(old, df("d.com")).count() == 3
    assert {r.domain: r.domain_id for r in domains.grown(old.limit(0), df("x")).collect()} == {"x": 0}


def test_merged_bitmaps_count_what_a_set_counts(spark):
    rows = [("1970-01-01", "train", i * 37 % 90_000) for i in range(3000)] + [("1970-01-02", "test", i * 11 % 70_000) for i in range(4000)]
    rows += [("1970-01-02", "train", 5), ("1970-01-03", "test", None), ("1970-01-03", "test", 0)]
    df = spark.createDataFrame(rows, "day string, split string, id long")
    parts = [stats.daily_bitmaps(df.filter(F.col("day") == d), "user") for d in ("1970-01-01", "1970-01-02", "1970-01-03")]
    got = stats.merged_counts(parts[0].unionByName(parts[1]).unionByName(parts[2])).first()
    train, test = ({r[2] for r in rows if r[1] == s and r[2] is not None} for s in ("train", "test"))
    assert (got.train, got.test, got.overall, got.both) == (len(train), len(test), len(train | test), len(train & test))
    only = stats.merged_counts(parts[0]).first()
    assert (only.test, only.both) == (0, 0) and only.train == only.overall
