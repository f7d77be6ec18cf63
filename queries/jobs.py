"""The jobs from files to files, and what they show of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as X
from queries.catalog import query
from queries.labelling import _SPLIT, payloads
from visitweave.plans import prepare, train
from visitweave.sources import combined, events as E, models
from visitweave.storage import fresh_path

_KEPT = """
, kept as (select user_id, count(*) n_events, min(ts_ms) first_ms, max(ts_ms) last_ms from ev group by 1 having count(*) < 800)
"""


def _prepared(spark, sf):
    """Raw files of the whole fixture, and the folder that the preparation job makes of them."""
    root, hot = fresh_path(spark, "job"), X.hot_users(spark, sf)
    E.write_sequence_file(payloads(spark, sf, hot), f"{root}/raw_events")
    X.visits(spark, sf, hot).write.parquet(f"{root}/raw_visits")
    rules = ["// rules of the fixture", *X.RULES]
    spark.createDataFrame([(x,) for x in rules], "value string").write.text(f"{root}/suffixes")
    done = prepare.job(spark, f"{root}/raw_events", f"{root}/raw_visits", root, f"{root}/suffixes", keep="clean")
    return root, done


@query("s9_prepare_job", X.sql(_KEPT + f"""
, w as (select user_id, count(*) n_visits, sum(len(pages)) n_hits from vs group by 1)
select user_id, case when {_SPLIT} = 0 then 'test' else 'train' end split, n_events, first_ms, last_ms, 603 n_features,
       n_visits, n_hits::bigint n_hits, (select count(*) from ev) n_lines, 0 n_rejected
from kept join w using (user_id)""", "vs"))
def s9_prepare(spark, sf):
    """Every user's record after the preparation job, and the lines it read."""
    root, done = _prepared(spark, sf)
    size = lambda c: F.size(F.col("events")[0][c])
    users = done.groupBy("user_id", "split").agg(
        F.max(F.size("events")).cast("long").alias("n_events"), F.max(F.array_min("events.ts_ms")).alias("first_ms"),
        F.max(F.array_max("events.ts_ms")).alias("last_ms"),
        F.max(size("request_vec") + size("href_vec") + size("prev_vec")).alias("n_features"),
        F.sum(F.size("visits")).alias("n_visits"),
        F.sum(F.aggregate(F.transform("visits", lambda v: F.size(v["pages"])), F.lit(0), lambda a, b: a + b)).alias("n_hits"))
    counts = spark.read.parquet(f"{root}/line_counts").first()       # its only row
    return users.select("*", F.lit(counts.n_lines).alias("n_lines"), F.lit(counts.n_rejected).alias("n_rejected"))


@query("s9_train_and_evaluate_jobs", X.sql(_KEPT + f"""
, t as (select visit_rank - 1 actual from lab where {_SPLIT} = 0 and user_id in (select user_id from kept))
select a::int actual, (select count(*) from t where actual = a) n_samples, 8 n_cells, 'batch,epoch' logged
from unnest(range(8)) r(a)""", "lab"))
def s9_train(spark, sf):
    """The training job on prepared records, then the evaluation job with the model it saved."""
    root, _ = _prepared(spark, sf)
    place = (f"{root}/combined", "multi-visit", f"{root}/model", f"{root}/log")
    train.train_job(spark, *place, iterations=3)
    train.evaluate_job(spark, *place)
    cells = spark.read.schema("predicted int, actual int, n long").option("header", True).csv(f"{root}/log.confusion")
    kinds = models.read_metrics(spark, f"{root}/log").agg(F.array_join(F.sort_array(F.collect_set("type")), ",")).first()[0]
    return cells.groupBy("actual").agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).cast("int").alias("n_cells"),
                                       F.lit(kinds).alias("logged"))


@query("s7_schema_and_rows", X.sql("""
, bags as (select user_id, list({'ts_ms': ts_ms, 'event_id': event_id, 'request_url': request_url} order by ts_ms, event_id) events
        from ev group by 1 having count(*) < 800),
placed as (select *, row_number() over (order by user_id) - 1 place from bags)
select 'row' kind, place, to_json({'user_id': user_id, 'events': events})::varchar "text" from placed where place < 20
union all select 'schema', i - 1, ['user_id string', 'events array', 'events[].ts_ms bigint', 'events[].event_id bigint',
                                   'events[].request_url string'][i] from unnest(range(1, 6)) t(i)""", "ev"))
def s7_shown(spark, sf):
    """Schema of the event lists and the first twenty of them."""
    hot = X.hot_users(spark, sf)
    bags = E.event_bags(X.page_views(spark, sf), ["ts_ms", "event_id", "request_url"], hot=hot)
    return combined.shown(bags.select("user_id", "events"), ["user_id"])
