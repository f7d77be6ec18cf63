"""Events, visits, labels, referrals and learning sets."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from queries import fixture as X
from queries.catalog import query
from visitweave.config import MAX_T, MAX_VISITS, VISIT_MAX_T
from visitweave.functions.arrays import one_hot
from visitweave.operators import grouped, labels, sequences, split, transfers
from visitweave.plans.prepare import prepare_events, prepare_visits
from visitweave.sources import combined, events as E, visits as V
from visitweave.storage import durable, fresh_path


def _joined(col, field=None):
    arr = F.col(f"{col}.{field}") if field else F.col(col)
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


# -- sources and projections -------------------------------------------------------------

def payloads(spark, sf, hot=None):
    """Events as tab-separated text, at most 500 lines to a record."""
    return _records(grouped.position(X.events(spark, sf, hot), ["user_id"], X.ORDER, "_pos", hot))


def _records(ev):
    empty = [F.lit("")] * 9
    line = F.concat_ws("\t", F.col("timestamp").cast("decimal(18,3)").cast("string"), *empty,
                       F.coalesce("referrer_url", F.lit("")), F.coalesce("prev_url", F.lit("")), "request_url")
    return (ev.select("user_id", F.floor((F.col("_pos") - 1) / 500).alias("part"), F.struct("_pos", line.alias("line")).alias("r"))
            .groupBy("user_id", "part").agg(F.array_join(F.array_sort(F.collect_list("r"))["line"], "\n").alias("payload"))
            .select("user_id", "payload"))


@query("p1_parse_event_lines", X.sql("""
select user_id, ts_ms, "timestamp", request_url, coalesce(referrer_url,'') referrer_url,
       coalesce(prev_url,'') prev_url from ev"""))
def p1(spark, sf):
    return E.parse_events(payloads(spark, sf, X.hot_users(spark, sf))).drop("event_id")


_REPEATED = """
, c as (select e.*, k, row_number() over (partition by user_id order by ts_ms, event_id, k) - 1 p
        from ev e, unnest(range(8)) r(k)),
n as (select *, row_number() over (partition by user_id order by ts_ms, p % 500, request_url,
             coalesce(referrer_url,''), coalesce(prev_url,'')) - 1 numbered from c)"""


def repeated_payloads(spark, sf):
    """Every event eight times over, so that users have several records."""
    hot = X.hot_users(spark, sf, grouped.HOT_ROWS // 8)
    ev = X.events(spark, sf, hot).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return _records(grouped.position(ev, ["user_id"], [*X.ORDER, "k"], "_pos", hot))


@query("p1_event_numbers", X.sql(_REPEATED + """
select user_id, numbered event_id, ts_ms, request_url, coalesce(referrer_url,'') referrer_url,
       coalesce(prev_url,'') prev_url from n"""))
def p1_numbers(spark, sf):
    return E.numbered(E.parse_events(repeated_payloads(spark, sf))).drop("timestamp")


@query("l1_prepare_repeated_events", X.sql(_REPEATED + """
select user_id, count(*) n_events, count(distinct numbered) n_keys, 201 n_features from n
group by user_id having count(*) < 800"""))
def l1_repeated(spark, sf):
    root = fresh_path(spark, "prepared")
    bags = prepare_events(spark, repeated_payloads(spark, sf), X.rules(spark), root, keep="clean")
    return bags.select("user_id", F.size("events").cast("long").alias("n_events"),
                       F.size(F.array_distinct("events.event_id")).cast("long").alias("n_keys"),
                       F.size(F.col("events")[0]["request_vec"]).alias("n_features"))


@query("p1_reject_count", X.sql("""
select count(*) n_lines, count(*) filter (where event_type = 'error') n_rejected from ev"""))
def p1_rejects(spark, sf):
    bad = F.when(F.col("event_type") == "error", F.lit("not-a-time")).otherwise(F.col("timestamp").cast("string"))
    line = F.concat_ws("\t", bad, *[F.lit("")] * 9, F.coalesce("referrer_url", F.lit("")), F.lit(""), "request_url")
    return E.reject_count(X.events(spark, sf).select("user_id", line.alias("payload")))


@query("p1_line_counts_in_flight", X.sql("""
select count(*) n_lines, count(*) filter (where event_type = 'error') n_rejected,
       count(*) filter (where event_type <> 'error') n_written from ev"""))
def p1_in_flight(spark, sf):
    bad = F.when(F.col("event_type") == "error", F.lit("not-a-time")).otherwise(F.col("timestamp").cast("string"))
    line = F.concat_ws("\t", bad, *[F.lit("")] * 9, F.coalesce("referrer_url", F.lit("")), F.lit(""), "request_url")
    counts = Observation("lines")
    written = durable(E.parse_events(X.events(spark, sf).select("user_id", line.alias("payload")), counts=counts))
    seen = [F.lit(counts.get[c]).cast("long").alias(c) for c in ("n_lines", "n_rejected")]
    return written.agg(F.count(F.lit(1)).alias("n_written")).select(*seen, "n_written")


@query("s1_sequence_file", X.sql("""
select user_id, ts_ms, "timestamp", request_url, coalesce(referrer_url,'') referrer_url,
       coalesce(prev_url,'') prev_url from ev"""))
def s1(spark, sf):
    path = fresh_path(spark, "events-seq")
    E.write_sequence_file(payloads(spark, sf, X.hot_users(spark, sf)), path)
    return E.parse_events(E.read_sequence_file(spark, path, 1 << 20)).drop("event_id")


@query("s2_visit_parquet", X.sql("""
select user_id "user", site, array_to_string(timestamps,',') timestamps, sending_page sendingpage,
       landing_page landingpage, array_to_string(pages,' ') pages from vs"""))
def s2(spark, sf):
    path = fresh_path(spark, "visits")
    X.visits(spark, sf).write.parquet(path)
    return V.read_visits(spark, path).select(
        "user", "site", _joined("timestamps").alias("timestamps"), "sendingpage", "landingpage",
        F.array_join("pages", " ").alias("pages"))


@query("p2_standardise_event_urls", X.sql(r"""
, c as (select user_id, event_id, request_url, referrer_url, prev_url from ev)
select user_id, event_id,
  rtrim(regexp_replace(request_url,'^https?://(www\.)*',''),'/#?&') request_url,
  coalesce(rtrim(regexp_replace(referrer_url,'^https?://(www\.)*',''),'/#?&'),'') referrer_url,
  coalesce(rtrim(regexp_replace(prev_url,'^https?://(www\.)*',''),'/#?&'),'') prev_url from c"""))
def p2(spark, sf):
    ev = X.events(spark, sf).select("user_id", "event_id", *E.URL_COLUMNS)
    return E.standardised(ev, X.rules(spark))


@query("p3_flatten_user_bags", X.sql("""
select user_id, event_id, ts_ms, request_url from ev"""))
def p3(spark, sf):
    bags = E.event_parts(X.page_views(spark, sf), ["ts_ms", "event_id", "request_url"], 50, X.hot_users(spark, sf))
    return E.flatten(bags).select("user_id", "event_id", "ts_ms", "request_url")


@query("p4_unpivot_urls", X.sql("""
select user_id, event_id, 'request_url' url_kind, request_url url from ev
union all select user_id, event_id, 'referrer_url', referrer_url from ev
union all select user_id, event_id, 'prev_url', prev_url from ev"""))
def p4(spark, sf):
    return E.url_rows(X.events(spark, sf))


@query("p5_visit_columns", X.sql("""
select user_id "user", site, len(timestamps) n, sending_page sendingpage, landing_page landingpage from vs"""))
def p5(spark, sf):
    return X.visits(spark, sf).select("user", "site", F.size("timestamps").alias("n"), "sendingpage", "landingpage")


@query("p6_p7_visit_struct_seconds", X.sql("""
select user_id, site, sending_page, landing_page, len(pages) n_pages,
       round(list_sum(list_transform(timestamps, lambda x: x/1000.0::double)),3) sum_seconds,
       timestamps[1]/1000.0::double first_second from vs"""))
def p6(spark, sf):
    v = V.visit_structs(X.visits(spark, sf))
    total = F.aggregate("visit.timestamps", F.lit(0.0), lambda a, x: a + x)
    return v.select("user_id", "site", "visit.sending_page", "visit.landing_page",
                    F.size("visit.pages").alias("n_pages"), F.round(total, 3).alias("sum_seconds"),
                    F.col("visit.timestamps")[0].alias("first_second"))


@query("p16_site_keys", X.sql("""
select distinct "domain" dom, 'm.'||"domain" sub, "domain"||'*' first_key, 'm.'||"domain"||'#' second_key,
       "domain" first_back, 'm.'||"domain" second_back from ev"""))
def p16(spark, sf):
    doms = X.page_views(spark, sf).select(F.col("domain").alias("dom")).distinct()
    return V.site_keys(doms.withColumn("sub", F.concat(F.lit("m."), "dom")), "dom", "sub")


@query("s7_json_preview", X.sql("""
select to_json({'user_id': user_id, 'event_id': event_id, 'ts_ms': ts_ms}) "json" from ev
order by ts_ms, event_id limit 1"""))
def s7(spark, sf):
    return combined.preview(X.page_views(spark, sf).select("user_id", "event_id", "ts_ms").orderBy(*X.ORDER))


@query("w7_first_event", X.sql("select user_id, event_id, ts_ms from ev order by ts_ms, event_id limit 1"))
def w7(spark, sf):
    return X.page_views(spark, sf).select("user_id", "event_id", "ts_ms").orderBy(*X.ORDER).limit(1)


# -- filters -----------------------------------------------------------------------------

def _with_bad(spark, sf):
    bad = F.when(F.col("event_type") == "error", F.lit("-")).otherwise(F.col("request_url"))
    return X.page_views(spark, sf).withColumn("request_url", bad)


_BAD = """, r as (select *, case when event_type='error' then '-' else request_url end u from ev)
select user_id, event_id from r where {0} in (select user_id from r where length(u) < 3)"""


@query("f1_users_with_short_request", X.sql(_BAD.format("user_id"), "ev"))
def f1(spark, sf):
    return E.keep_users(_with_bad(spark, sf)).select("user_id", "event_id")


@query("f1_users_clean", X.sql(_BAD.format("user_id not"), "ev"))
def f1_clean(spark, sf):
    return E.keep_users(_with_bad(spark, sf), "clean").select("user_id", "event_id")


@query("f2_users_under_event_limit", X.sql("""
select user_id, event_id from ev where user_id in (select user_id from ev group by 1 having count(*) < 15)"""))
def f2(spark, sf):
    return E.limit_users(X.page_views(spark, sf), 15).select("user_id", "event_id")


@query("f3_first_level_sites", X.sql("select user_id \"user\", site, landing_page landingpage from vs"))
def f3(spark, sf):
    v = X.visits(spark, sf)
    both = v.unionByName(v.withColumn("site", F.rtrim("site", F.lit("*"))))
    return V.first_level_sites(both).select("user", "site", "landingpage")


@query("f6_w8_first_eight_visits", X.sql("""
select user_id, visit_rank, site, first_ts from vs where visit_rank <= 8"""))
def f6(spark, sf):
    return V.first_visits(X.visit_rows(spark, sf)).select("user_id", "visit_rank", "site", "first_ts")


@query("f9_visits_with_sender", X.sql("""
select user_id, site, first_ts, sending_page from vs where coalesce(sending_page,'') <> ''"""))
def f9(spark, sf):
    return V.with_sender(X.visit_rows(spark, sf)).select("user_id", "site", "first_ts", "sending_page")


# -- order and windows -------------------------------------------------------------------

@query("w1_event_order", X.sql("""
select user_id, event_id, row_number() over (partition by user_id order by ts_ms, event_id) event_no from ev"""))
def w1(spark, sf):
    return sequences.ordered(X.page_views(spark, sf), X.hot_users(spark, sf)).select("user_id", "event_id", "event_no")


@query("w2_visit_rank", X.sql("select user_id, site, first_ts, visit_rank from vs"))
def w2(spark, sf):
    hot = X.hot_users(spark, sf)
    return V.rank_visits(X.visit_rows(spark, sf, hot), hot).select("user_id", "site", "first_ts", "visit_rank")


def _window_sql(size, mask):
    last = "-1" if mask else "v"
    return X.sql(f"""
, o as (select user_id, event_id, visit_rank, list(event_id) over w ids, list(visit_rank) over w ranks, visit_rank v
        from lab window w as (partition by user_id order by ts_ms, event_id
                              rows between {size - 1} preceding and current row))
select user_id, event_id, {size} n,
  repeat('-1,', {size}-len(ids))||array_to_string(ids,',') ids,
  repeat('-1,', {size}-len(ids))||array_to_string(list_append(ranks[1:len(ranks)-1], {last}),',') labels from o""")


def _windows(spark, sf, size, mask):
    hot = X.hot_users(spark, sf)
    kept = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf, hot))
    out = sequences.event_windows(kept, size, F.col("visit_rank"), mask, hot)
    return out.select("user_id", "event_id", F.size("sequence").cast("long").alias("n"),
                      _joined("sequence", "event_id").alias("ids"), _joined("sequence", "label").alias("labels"))


@query("w3_trailing_window_32", _window_sql(MAX_T, False))
def w3(spark, sf):
    return _windows(spark, sf, MAX_T, False)


@query("w4_masked_window_32", _window_sql(MAX_T, True))
def w4(spark, sf):
    return _windows(spark, sf, MAX_T, True)


@query("w6_short_window_5", _window_sql(VISIT_MAX_T, False))
def w6(spark, sf):
    return _windows(spark, sf, VISIT_MAX_T, False)


def _strided_sql(size, step):
    return X.sql(f"""
, o as (select user_id, event_id, row_number() over (partition by user_id order by ts_ms, event_id)-1 i,
               count(*) over (partition by user_id) n,
               list(event_id) over (partition by user_id order by ts_ms, event_id
                                    rows between current row and {size - 1} following) ids from ev)
select user_id, i//{step} window_no, array_to_string(ids,',') items from o where i%{step}=0 and i+{size}<=n""")


def _strided(spark, sf, size, step):
    out = grouped.strided(X.page_views(spark, sf), ["user_id"], X.ORDER, size, step, F.col("event_id"),
                          X.hot_users(spark, sf))
    return out.select("user_id", "window_no", _joined("items").alias("items"))


@query("w5_sliding_window_4_by_3", _strided_sql(4, 3))
def w5(spark, sf):
    return _strided(spark, sf, 4, 3)


@query("w5_tumbling_window_5", _strided_sql(5, 5))
def w5_tumbling(spark, sf):
    return _strided(spark, sf, 5, None)


@query("a4_first_event_time", X.sql("select user_id, min(ts_ms) start_ms from ev group by 1"))
def a4(spark, sf):
    return sequences.first_times(X.page_views(spark, sf))


@query("p10_seconds_since_start", X.sql("""
select user_id, event_id, round((ts_ms - min(ts_ms) over (partition by user_id))/1000.0::double,3) rel_time from ev"""))
def p10(spark, sf):
    out = sequences.since_start(X.page_views(spark, sf), X.hot_users(spark, sf))
    return out.select("user_id", "event_id", F.round("rel_time", 3).alias("rel_time"))


# -- joins -------------------------------------------------------------------------------

@query("j1_p8_users_with_visits", X.sql("""
, e as (select user_id, count(*) n_events from ev group by 1 having count(*) < 800),
w as (select user_id, count(*) n_visits from vs group by 1)
select user_id, n_events, n_visits from e join w using (user_id)"""))
def j1(spark, sf):
    hot = X.hot_users(spark, sf)
    bags = E.event_bags(X.page_views(spark, sf), ["ts_ms", "event_id", "request_url"], hot=hot)
    both = combined.combine(bags, V.user_visit_lists(X.visit_rows(spark, sf, hot), hot=hot))
    return both.groupBy("user_id").agg(F.max(F.size("events")).cast("long").alias("n_events"),
                                       F.sum(F.size("visits")).alias("n_visits"))


@query("j2_f5_visit_labels", X.sql("select user_id, event_id, visit_rank from lab", "lab"))
def j2(spark, sf):
    hot = X.hot_users(spark, sf)
    out = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf, hot))
    return out.select("user_id", "event_id", "visit_rank")


@query("j2_exact_seconds", X.sql("""
select e.user_id, e.event_id, max(h.visit_rank) visit_rank from ev e
join hit h on h.user_id = e.user_id and h.ts_ms/1000.0::double = e."timestamp" and h.visit_rank <= 8 group by all"""))
def j2_exact(spark, sf):
    out = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf), "exact")
    return out.select("user_id", "event_id", "visit_rank")


@query("j9_match_time_and_url", X.sql("""
select e.user_id, e.event_id, max(h.visit_rank) visit_rank from ev e
join hit h on h.user_id = e.user_id and h.ts_ms = e.ts_ms and h.page = e.request_url and h.visit_rank <= 8
group by all"""))
def j9(spark, sf):
    out = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf), "ts_url")
    return out.select("user_id", "event_id", "visit_rank")


@query("j3_referring_visit", X.sql("select user_id, visit_rank, referrer_rank from refs"))
def j3(spark, sf):
    hot = X.hot_users(spark, sf)
    ranked = V.rank_visits(X.visit_rows(spark, sf, hot), hot)
    return transfers.referrals(ranked, hot).select("user_id", "visit_rank", "referrer_rank")


@query("j3_transfer_edges", X.sql("""
select user_id, visit_rank, referrer_rank, sending_page from refs where referrer_rank > 0"""))
def j3_edges(spark, sf):
    hot = X.hot_users(spark, sf)
    ranked = V.rank_visits(X.visit_rows(spark, sf, hot), hot)
    return transfers.transfers(ranked, hot).select("user_id", "visit_rank", "referrer_rank", "sending_page")


@query("a1_visit_lists", X.sql("""
select user_id, (visit_rank-1)//1000 part, count(*) n_visits,
       string_agg(site, ',' order by visit_rank) sites from vs group by all"""))
def a1(spark, sf):
    hot = X.hot_users(spark, sf)
    lists = V.user_visit_lists(X.visit_rows(spark, sf, hot), hot=hot)
    return lists.select("user_id", "part", F.size("visits").cast("long").alias("n_visits"),
                        F.array_join("visits.site", ",").alias("sites"))


# -- learning sets -----------------------------------------------------------------------

_MULTI = """
, st as (select user_id, min(ts_ms) start_ms from ev group by 1),
o as (select user_id, event_id, ts_ms, visit_rank, list(event_id) over w ids, list(visit_rank) over w ranks
      from lab window w as (partition by user_id order by ts_ms, event_id
                            rows between 31 preceding and current row)),
s as (select o.*, {label} lbl, round((ts_ms-start_ms)/1000.0::double,3) rel_time,
             list_append(ranks[1:len(ranks)-1], {last}) marks from o join st using (user_id) {join})
select user_id, event_id, rel_time, lbl "label", repeat('-1,',32-len(ids))||array_to_string(ids,',') ids,
       repeat('-1,',32-len(ids))||array_to_string(marks,',') labels,
       array_to_string(list_transform(range(8), lambda i: case when i=lbl then 1 else 0 end),',') one_hot from s"""


def _flat(df):
    return df.select("user_id", "event_id", F.round("rel_time", 3).alias("rel_time"), "label",
                     _joined("sequence", "event_id").alias("ids"), _joined("sequence", "label").alias("labels"),
                     _joined("one_hot").alias("one_hot"))


@query("l4_multi_visit_set", X.sql(_MULTI.format(label="visit_rank-1", last="-1", join="")))
def l4(spark, sf):
    hot = X.hot_users(spark, sf)
    return _flat(sequences.multi_visit(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot))


@query("l5_multi_transfer_set", X.sql(_MULTI.format(
    label="referrer_rank", last="o.visit_rank", join="join refs using (user_id, visit_rank)")))
def l5(spark, sf):
    hot = X.hot_users(spark, sf)
    return _flat(sequences.multi_transfer(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot))


@query("l6_single_visit_set", X.sql("""
, p as (select l.user_id, v.visit_rank, l.event_id, l.ts_ms, l.visit_rank ev_visit, r.referrer_rank sender
        from lab l join vs v on v.user_id = l.user_id and v.visit_rank <= 8
        join refs r on r.user_id = l.user_id and r.visit_rank = l.visit_rank)
select p.user_id, p.visit_rank, p.event_id,
       case when ev_visit = visit_rank then 0 when sender = visit_rank then 2 else 1 end "label",
       repeat('-1,', 4-len(c.ids))||array_to_string(list_append(c.ids, p.event_id),',') ids
from p, lateral (select coalesce(list(x.event_id order by x.ts_ms, x.event_id),[]) ids from (
    select q.event_id, q.ts_ms from lab q where q.user_id = p.user_id and q.visit_rank = p.visit_rank
       and (q.ts_ms, q.event_id) < (p.ts_ms, p.event_id) order by q.ts_ms desc, q.event_id desc limit 4) x) c"""))
def l6(spark, sf):
    hot = X.hot_users(spark, sf)
    out = sequences.single_visit(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot)
    return out.select("user_id", "visit_rank", "event_id", "label", _joined("sequence").alias("ids"))


@query("p14_one_hot", X.sql("""
select user_id, event_id, array_to_string(list_transform(range(8),
       lambda i: case when i = visit_rank-1 then 1 else 0 end),',') one_hot from lab""", "lab"))
def p14(spark, sf):
    out = labels.visit_labels(X.page_views(spark, sf), X.visit_rows(spark, sf))
    hot = out.select("user_id", "event_id", one_hot(F.col("visit_rank") - 1, MAX_VISITS).alias("h"))
    return hot.select("user_id", "event_id", _joined("h").alias("one_hot"))


@query("f8_non_empty_samples", X.sql("select user_id, count(*) n_samples from lab group by 1"))
def f8(spark, sf):
    hot = X.hot_users(spark, sf)
    out = sequences.multi_visit(X.page_views(spark, sf), X.visit_rows(spark, sf, hot), hot=hot)
    return sequences.non_empty(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"))


@query("l1_prepare_events", X.sql("select user_id, count(*) n_events, 201 n_features from ev group by 1"))
def l1(spark, sf):
    source = payloads(spark, sf, X.hot_users(spark, sf))
    bags = prepare_events(spark, source, X.rules(spark), fresh_path(spark, "prepared"), keep="clean")
    return bags.select("user_id", F.size("events").cast("long").alias("n_events"),
                       F.size(F.col("events")[0]["request_vec"]).alias("n_features"))


@query("l2_prepare_visits", X.sql("""
select user_id, visit_rank, site, sending_page, landing_page, round(first_ts/1000.0::double,3) first_second,
       len(pages) n_pages from vs"""))
def l2(spark, sf):
    v = prepare_visits(X.visits(spark, sf)).select("user_id", F.explode("visits").alias("v"))
    return v.select("user_id", "v.visit_rank", "v.site", "v.sending_page", "v.landing_page",
                    F.round(F.col("v.timestamps")[0], 3).alias("first_second"),
                    F.size("v.pages").cast("long").alias("n_pages"))


_SPLIT = "(('0x'||substr(md5(user_id),1,8))::bigint % 10)"


@query("p9_md5_bucket", X.sql(f"select distinct user_id, {_SPLIT} bucket from ev"))
def p9(spark, sf):
    users = X._base(spark, sf).select("user_id").distinct()
    return users.withColumn("bucket", split.md5_bucket(F.col("user_id"), 10))


@query("f4_l7_train_test_split", X.sql(f"""
select case when {_SPLIT} = 0 then 'test' else 'train' end split, count(distinct user_id) n_users,
       count(*) n_events from ev group by 1"""))
def l7(spark, sf):
    per_user = X._base(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return split.with_split(per_user).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_events"))


@query("l3_s3_s4_combined_write_read", X.sql(f"""
, e as (select user_id, count(*) n from ev group by 1 having count(*) < 800),
w as (select user_id, count(*) m from vs group by 1)
select case when {_SPLIT} = 0 then 'test' else 'train' end split, count(*) n_users,
       sum(n)::bigint n_events, sum(m)::bigint n_visits from e join w using (user_id) group by 1"""))
def l3(spark, sf):
    hot = X.hot_users(spark, sf)
    path = fresh_path(spark, "combined")
    bags = E.event_bags(X.events(spark, sf, hot), hot=hot)
    both = combined.combine(bags, V.user_visit_lists(X.visit_rows(spark, sf, hot), hot=hot))
    combined.write_combined(split.with_split(both), path)
    back = combined.read_combined(spark, path)
    first = F.when(F.col("part") == 0, 1).otherwise(0)
    return back.groupBy("split").agg(F.sum(first).alias("n_users"), F.sum(first * F.size("events")).alias("n_events"),
                                     F.sum(F.size("visits")).alias("n_visits"))
