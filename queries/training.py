"""The dense feed, inputs from URL vectors, saved models, and what grows from day to day."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from queries import fixture as X
from queries.catalog import query
from queries.domains_model import (
    _DOM, _EVENT_FEAT, _HREF, DIM, _event_features, _page_lookup, _samples, _trained, _with_domain)
from queries.labelling import _SPLIT
from visitweave.config import MAX_T, MAX_VISITS, NO_DOMAIN
from visitweave.operators import centroids, classifier, domains, embeddings, labels, sequences, split, stats
from visitweave.sources import days, feed, visits as V
from visitweave.sources.events import URL_COLUMNS
from visitweave.storage import durable, fresh_path

WIDTH = 2 * (2 * DIM + 1) + 2
SHARDS, SEED = 4, 11

_WINDOWS = _EVENT_FEAT + f"""
, st as (select user_id, min(ts_ms) start_ms from ev group by 1),
mr as (select l.user_id, l.event_id, l.ts_ms, l.visit_rank, r.domain_id domain_id, {_HREF} href_id,
              ((l.ts_ms-start_ms)/1000.0::double)::float rel_time
       from lab l join st using (user_id) join feat r on r.url = l.request_url left join feat h on h.url = l.referrer_url),
o as (select user_id, event_id, ts_ms, visit_rank, list(domain_id) over w doms, list(href_id) over w hrefs,
             list(rel_time) over w times, list(visit_rank) over w ranks
      from mr window w as (partition by user_id order by ts_ms, event_id rows between {MAX_T - 1} preceding and current row)),
p as (select *, ('0x'||substr(md5(user_id),1,8))::bigint % {SHARDS} shard,
             list_append(ranks[1:len(ranks)-1], -1) marks from o),
s as (select *, row_number() over (partition by shard order by md5('{SEED}|'||user_id), user_id, ts_ms, event_id)-1 place from p)
"""


def _write_feed(spark, sf):
    """The whole multi-visit learning set as a feed."""
    hot = X.hot_users(spark, sf)
    ranked = durable(V.first_visits(X.visit_rows(spark, sf, hot)))
    events = durable(X.events(spark, sf, hot))
    plain = events.select("user_id", "event_id", "ts_ms", *URL_COLUMNS)
    marked = labels.label_events(_event_features(spark, plain, sf), ranked, matched_only=False).drop(*URL_COLUMNS)
    rows = sequences.since_start(marked, hot).filter("visit_rank > 0").withColumnRenamed("visit_rank", "label")
    samples = durable(sequences.multi_visit(events, ranked, hot=hot))
    flat = durable(embeddings.model_rows(rows))
    path = fresh_path(spark, "feed")
    feed.write(samples, lambda placed: embeddings.dense(placed, flat, MAX_T, WIDTH, feed.NEAR), path, MAX_T, WIDTH, SHARDS, SEED, file_rows=500)
    return path


def _slots(at, kind="bigint"):
    """One number of every step, joined."""
    steps = F.sequence(F.lit(0), F.lit(MAX_T - 1))
    value = lambda t: F.element_at("x", t * WIDTH + at + 1)
    return F.array_join(F.transform(steps, lambda t: value(t).cast(kind).cast("string")), ",")


def _padded(column, kind="bigint"):
    return (f"repeat('-1,',{MAX_T}-len({column}))||array_to_string(list_transform({column}, lambda v: v::{kind}),',')")


@query("g3_dense_feed", _WINDOWS + f"""
select user_id, event_id, shard, place::bigint place, (visit_rank-1)::int "label", {MAX_T * WIDTH} n, {_padded('doms')} domains,
       {_padded('hrefs')} hrefs, {_padded('marks')} labels,
       repeat('-1,',{MAX_T}-len(times))||array_to_string(list_transform(times, lambda v: floor(v)::bigint),',') whole_seconds
from s""")
def g3_dense(spark, sf):
    """Every window, written to the feed and read back."""
    path = _write_feed(spark, sf)
    at = 2 * DIM + 1
    steps = F.sequence(F.lit(0), F.lit(MAX_T - 1))
    seconds = F.transform(steps, lambda t: F.floor(F.element_at("x", t * WIDTH + WIDTH - 1)).cast("string"))
    # Only what is shown of a window meets the keys.
    rows = feed.read(spark, path).select(
        "shard", "place", "label", F.size("x").alias("n"), _slots(at - 1).alias("domains"), _slots(2 * at - 1).alias("hrefs"),
        _slots(WIDTH - 1).alias("labels"), F.array_join(seconds, ",").alias("whole_seconds"))
    return feed.with_keys(spark, path, rows).select(
        "user_id", "event_id", "shard", "place", "label", "n", "domains", "hrefs", "labels", "whole_seconds")


@query("m6_saved_model_over_feed", _WINDOWS + f"""
, full_ as (select user_id, event_id, visit_rank-1 "label",
              list_concat(list_transform(range({MAX_T}-len(marks)), lambda i: -1), marks) m,
              list_concat(list_transform(range({MAX_T}-len(doms)), lambda i: -1), doms) d from s),
z as (select user_id, event_id, "label", c, list_sum(list_transform(range({MAX_T}), lambda t: ((t + c) % 5) * m[t+1] + ((t * c) % 3) * d[t+1]))
             + c * 0.5 score from full_, unnest(range({MAX_VISITS})) r(c))
select user_id, event_id, "label"::int "label", array_to_string(list(round(score*2)::bigint order by c),',') scores,
       arg_max(c, (score, -c))::int predicted from z group by all""")
def m6_saved(spark, sf):
    """A linear model from a file, over all windows of the feed."""
    path, model = _write_feed(spark, sf), fresh_path(spark, "model") + "/linear.npz"
    weights = np.zeros((MAX_VISITS, MAX_T, WIDTH))
    t, c = np.arange(MAX_T), np.arange(MAX_VISITS)[:, None]
    weights[:, :, WIDTH - 1] = (t + c) % 5
    weights[:, :, 2 * DIM] = (t * c) % 3
    classifier.save_linear(model, weights.reshape(MAX_VISITS, -1), 0.5 * np.arange(MAX_VISITS))
    scored = classifier.score_feed(feed.read(spark, path), model, MAX_T * WIDTH)
    doubled = F.transform("scores", lambda x: F.round(x * 2).cast("long").cast("string"))
    shown = scored.select("shard", "place", "label", F.array_join(doubled, ",").alias("scores"),
                          F.col("predicted").cast("int").alias("predicted"))
    return feed.with_keys(spark, path, shown).select("user_id", "event_id", "label", "scores", "predicted")


# -- inputs from URL vectors -------------------------------------------------------------

_CENTROIDS = _EVENT_FEAT + f"""
, lv as (select l.user_id, l.event_id, l.ts_ms, l.visit_rank, f.url_vec vec from lab l join feat f on f.url = l.request_url),
pv as (select lv.*, v of_visit, (visit_rank = v)::int mine from lv, unnest(range(1,{MAX_VISITS + 1})) r(v)),
cv as (select *, coalesce(sum(mine) over w, 0) n_before,
              {', '.join(f"sum(case when mine = 1 then vec[{i + 1}]::double end) over w s{i}" for i in range(DIM))}
       from pv window w as (partition by user_id, of_visit order by ts_ms, event_id rows between unbounded preceding and 1 preceding)),
cs as (select *, sqrt({' + '.join(f'vec[{i + 1}]::double*vec[{i + 1}]::double' for i in range(DIM))})
                 * sqrt({' + '.join(f'(s{i}/n_before)*(s{i}/n_before)' for i in range(DIM))}) norms,
              {' + '.join(f'vec[{i + 1}]::double*(s{i}/n_before)' for i in range(DIM))} dot from cv),
"""


def _centroids(spark, sf):
    hot = X.hot_users(spark, sf)
    dim, tokens, _, _ = _page_lookup(spark, sf)
    means = embeddings.url_means(dim.select("url", "vector_tokens"), tokens, DIM).select(
        F.col("url").alias("request_url"), F.col("url_vec").alias("vector"))
    seen = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf, hot))
    events = durable(seen.select("user_id", "event_id", "ts_ms", "visit_rank", "request_url").join(means, "request_url"))
    return centroids.running_centroids(events.drop("request_url"), DIM, hot=hot)


@query("m4_visit_centroids", _CENTROIDS.rstrip().rstrip(",") + f"""
select user_id, event_id, of_visit::int of_visit, n_before::bigint n_before,
       case when n_before > 0 then array_to_string([{', '.join(f'round(s{i}/n_before*1000000)::bigint' for i in range(DIM))}], ',') end centroid,
       coalesce(case when n_before > 0 and norms > 0 then round(dot/norms, 6) end, 0.0::double) cosine
from cs""")
def m4_centroids(spark, sf):
    """The running centroid of every visit at every event, and the event's cosine to it."""
    whole = F.array_join(F.transform("centroid", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return centroids.with_cosines(_centroids(spark, sf), DIM).select(
        "user_id", "event_id", "of_visit", "n_before", whole.alias("centroid"), F.round("cosine", 6).alias("cosine"))


def samples_with_vectors(spark, sf):
    """The multi-visit learning set with cosines among its inputs."""
    hot = X.hot_users(spark, sf)
    made = sequences.multi_visit(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot)
    near = centroids.cosines(_centroids(spark, sf), DIM)
    return classifier.window_summary(sequences.non_empty(made), near)


_SHARES = ", ".join(f"len(list_filter(prev, lambda v: v = {c})) / {MAX_T}.0::double" for c in range(1, MAX_VISITS + 1))
_LAST = ", ".join(f"coalesce(prev[len(prev)] = {c}, false)::int::double" for c in range(1, MAX_VISITS + 1))


@query("m4_window_inputs", _CENTROIDS + f"""
st as (select user_id, min(ts_ms) start_ms from ev group by 1),
near as (select user_id, event_id, list(coalesce(case when n_before > 0 and norms > 0 then round(dot/norms*10000) end, 0)::bigint
                order by of_visit) c from cs group by all),
o as (select l.user_id, event_id, visit_rank, (ts_ms - start_ms)/1000.0::double rel_time, list(visit_rank) over w ranks
      from lab l join st using (user_id) window w as (partition by l.user_id order by ts_ms, event_id
            rows between {MAX_T - 1} preceding and current row)),
q as (select *, ranks[1:len(ranks)-1] prev from o)
select user_id, event_id, visit_rank-1 "label", array_to_string(list_concat(list_transform(
         [{_SHARES}, {_LAST}, -1/8.0::double, len(ranks)/{MAX_T}.0::double, ln(1 + rel_time)/10],
         lambda v: round(v*10000)::bigint), c), ',') inputs
from q join near using (user_id, event_id)""")
def m4_inputs(spark, sf):
    """What the classifier sees of every window."""
    whole = F.transform("inputs", lambda x: F.round(x * 10_000).cast("long").cast("string"))
    return samples_with_vectors(spark, sf).select("user_id", "event_id", "label", F.array_join(whole, ",").alias("inputs"))


@query("m5_training_log", X.sql(f"""
select e epoch, 'epoch' type, n n_samples, true loss_in_bounds, true accuracy_in_bounds
from (select count(*) n from lab where {_SPLIT} = 0), (select unnest([1, 2]) e)"""))
def m5_log(spark, sf):
    """Two epochs of training, the second going on from the saved first: the samples tested and what is fixed of their scores.

    An untrained net that knows nothing has a loss of ln 8; training may only lower it.
    """
    samples, first = _trained(spark, sf, "multi-visit", 10)
    second = classifier.fit(samples.filter("split = 'train'"), "multi-visit", 1, 10, resume=first)
    rows = []
    for epoch, model in enumerate((first, second), 1):
        scored = durable(classifier.score(samples.filter("split = 'test'"), model))
        rows.append(classifier.losses(scored).select(
            F.lit(epoch).alias("epoch"), F.lit("epoch").alias("type"), F.lit(scored.count()).cast("long").alias("n_samples"),
            F.col("loss").between(0, float(np.log(MAX_VISITS))).alias("loss_in_bounds"),
            F.col("accuracy").between(1 / MAX_VISITS, 1).alias("accuracy_in_bounds")))
    return rows[0].unionByName(rows[1])


# -- records by day ----------------------------------------------------------------------

_DAY = "strftime(epoch_ms({}::bigint), '%Y-%m-%d')"


@query("l3_daily_records", X.sql(f"""
, dv as (select user_id, {_DAY.format('first_ts')} "day", list(visit_rank order by visit_rank) ranks from vs
         where visit_rank <= {MAX_VISITS} group by all)
select e.user_id, e.event_id, {_DAY.format('e.ts_ms')} "day", array_to_string(ranks, ',') visits
from ev e join dv on dv.user_id = e.user_id and dv."day" = {_DAY.format('e.ts_ms')}"""))
def l3_daily(spark, sf):
    """Events and visits in daily tables, one day replaced, joined without a shuffle."""
    hot = X.hot_users(spark, sf)
    events = days.with_key(X.page_views(spark, sf).select("user_id", "event_id", "ts_ms"))
    first = V.first_visits(X.visit_rows(spark, sf, hot)).select("user_id", "visit_rank", F.col("first_ts").alias("ts_ms"))
    # At most eight entries per user.
    visits = days.with_key(first).groupBy("user_id", "day", days.KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("visit_rank")), lambda x: x.cast("string")), ",").alias("visits"))
    names = []
    for df in (durable(events), durable(visits)):
        names.append("records_" + uuid4().hex)
        days.create(df, names[-1], fresh_path(spark, "days"), 8)
        last = df.agg(F.max("day")).first()[0]
        days.write(df.withColumn("user_id", F.when(F.col("day") == last, "wrong").otherwise(F.col("user_id"))), names[-1], 8)
        days.write(df.filter(F.col("day") == last), names[-1], 8)
    return days.records(spark, *names).select("user_id", "event_id", "day", "visits")


# -- what grows from day to day ----------------------------------------------------------

_CUT = "(select median(ts_ms) from ev)"


def _halves(spark, sf):
    """Events with domain, split and day, those before and after the middle of the time."""
    events = durable(split.with_split(days.with_key(_with_domain(spark, sf).select("user_id", "ts_ms", "domain"))))
    middle = events.agg(F.median("ts_ms")).first()[0]
    return events, events.filter(F.col("ts_ms") < middle), events.filter(F.col("ts_ms") >= middle)


@query("a3_grown_dictionary", X.sql(_DOM + f"""
, before as (select distinct dom from d where ts_ms < {_CUT} union select '{NO_DOMAIN}'),
one as (select dom, row_number() over (order by dom) - 1 domain_id from before),
two as (select dom, row_number() over (order by dom) - 1 + (select count(*) from one) domain_id
        from (select distinct dom from d where dom not in (select dom from before)))
select dom "domain", domain_id from one union all select * from two"""))
def a3_grown(spark, sf):
    """A dictionary of the first half of the time, grown by the second."""
    _, first, second = _halves(spark, sf)
    return domains.grown(durable(domains.dictionary(first)), second)


@query("a11_a12_daily_bitmaps", X.sql(_DOM + f"""
, e as (select user_id, dom, case when {_SPLIT}=0 then 'test' else 'train' end split from d),
k as (select 'domain' kind, dom x, split from e union all select 'user', user_id, split from e),
n as (select kind, x, bool_or(split='train') tr, bool_or(split='test') te from k group by all)
select kind, count(*) filter (where tr) train, count(*) filter (where te) test, count(*) overall,
       count(*) filter (where tr and te) "both" from n group by 1"""))
def a11_bitmaps(spark, sf):
    """Distinct domains and users: each half of the days adds its bitmaps without reading the other."""
    path, known = fresh_path(spark, "bitmaps"), None
    _, first, second = _halves(spark, sf)
    for part in (first, second):
        renamed = part.select(F.col("user_id").alias("domain"))
        ids = {"domain": part.select("domain"), "user": renamed}
        if known is None:
            known = {k: durable(domains.dictionary(v)) for k, v in ids.items()}
        else:
            known = {k: durable(domains.grown(known[k], v)) for k, v in ids.items()}
        for kind, column in (("domain", "domain"), ("user", "user_id")):
            side = known[kind].select(F.col("domain").alias(column), F.col("domain_id").alias("id"))
            stats.daily_bitmaps(part.join(side, column).select("day", "split", "id"), kind).write.mode("append").parquet(path)
    return stats.merged_counts(spark.read.parquet(path))
