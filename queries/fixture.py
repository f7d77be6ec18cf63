"""Browsing history derived from the given tables, in Spark and as SQL.

Every event visits one page: a user roams a block of twelve neighbouring pages, and the
blocks together cover the whole page table.  A "user" is a user and epoch week; visits are
runs of events on one domain without a gap over two days, cut at 500 page views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.operators import grouped
from visitweave.operators.grouped import Running
from visitweave.sources import suffixes, visits as V

RULES = ["com", "net", "org", "example.com", "example.net", "example.org"]
BLOCK = 12
WEEK_MS = 604_800_000
GAP_MS = 172_800_000
VISIT_PAGES = 500
ORDER = ["ts_ms", "event_id"]


SCHEMAS = {"events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
           "pages": "page_id bigint, url string, html string"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is stated, so no job has to look it up."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def rules(spark: SparkSession) -> suffixes.SuffixRules:
    return suffixes.suffixes(spark, RULES)


def _base(spark, sf):
    # Taken apart by fields, the same in every session time zone.
    ms = ("unix_date(cast(ts as date)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L"
          " + cast(floor(extract(second from ts) * 1000) as bigint)")
    return table(spark, sf, "events").selectExpr(
        "event_id", "event_type", "user_id as _user", f"{ms} as ts_ms").selectExpr(
        "*", f"concat(_user, '-', ts_ms div {WEEK_MS}) as user_id")


def hot_users(spark: SparkSession, sf: str, limit: int = grouped.HOT_ROWS) -> grouped.HotGroups:
    """Users with too many events for one task (normally none)."""
    return grouped.find_hot(_base(spark, sf).select("user_id"), ["user_id"], limit)


def page_views(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the page they request: no order is needed yet."""
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("request_url"))
    n_pages = table(spark, sf, "pages").agg(F.count(F.lit(1))).scalar()
    base = _base(spark, sf)
    place = F.pmod(F.col("_user") * BLOCK + F.col("event_id") % BLOCK, n_pages)
    host = F.regexp_extract("request_url", "^https?://([^/?#]+)", 1)
    return base.withColumn("page_id", place).join(pages, "page_id").select(
        "user_id", "event_id", "ts_ms", (F.col("ts_ms") / F.lit(1000.0)).alias("timestamp"), "event_type",
        "request_url", F.regexp_extract(host, r"([^.]+\.example\.(?:com|net|org))$", 1).alias("domain"))


def events(spark: SparkSession, sf: str, hot: grouped.HotGroups | None = None) -> DataFrame:
    """Events with previous URL and domain, and the referrer of click, view and purchase."""
    hot = hot or hot_users(spark, sf)
    seen = grouped.previous(page_views(spark, sf), ["user_id"], ORDER,
                            {"prev_url": "request_url", "prev_domain": "domain"}, hot)
    return seen.withColumn("referrer_url", F.when(
        F.col("event_type").isin("click", "view", "purchase"), F.col("prev_url")))


def visits(spark: SparkSession, sf: str, hot: grouped.HotGroups | None = None) -> DataFrame:
    """Visits in source layout: ``user, site, timestamps, sendingpage, landingpage, pages``."""
    hot = hot or hot_users(spark, sf)
    keys = ["user_id", "domain"]
    ev = events(spark, sf, hot)
    gap = grouped.previous(ev, keys, ORDER, {"_before": "ts_ms"}, hot)
    starts = F.when(F.col("ts_ms") - F.col("_before") <= GAP_MS, 0).otherwise(1)
    run = grouped.running(gap, keys, ORDER, {"k": Running("sum", starts)}, hot)
    placed = grouped.position(run, [*keys, "k"], ORDER, "_pos", hot)
    sending = F.when(F.col("prev_domain") != F.col("domain"), F.col("referrer_url"))
    hit = F.struct("ts_ms", "event_id", "request_url", sending.alias("sending"))
    return (placed.groupBy(*keys, "k", F.floor((F.col("_pos") - 1) / VISIT_PAGES).alias("part"))
            .agg(F.array_sort(F.collect_list(hit)).alias("h"))
            .select(F.col("user_id").alias("user"), F.concat("domain", F.lit("*")).alias("site"),
                    F.col("h.ts_ms").alias("timestamps"), F.col("h")[0]["sending"].alias("sendingpage"),
                    F.col("h")[0]["request_url"].alias("landingpage"), F.col("h.request_url").alias("pages")))


def visit_rows(spark: SparkSession, sf: str, hot=None) -> DataFrame:
    return V.visit_rows(visits(spark, sf, hot))


SQL = rf"""
with b as (
  select e.event_id, e.event_type, e.user_id||'-'||((epoch_us(e.ts)//1000)//{WEEK_MS}) user_id,
         epoch_us(e.ts)//1000 ts_ms, p.url request_url,
         regexp_extract(regexp_extract(p.url,'^https?://([^/?#]+)',1),
                        '([^.]+\.example\.(?:com|net|org))$',1) "domain"
  from events e join pages p
    on p.page_id = (e.user_id*{BLOCK} + e.event_id%{BLOCK}) % (select count(*) from pages)),
f as (select *, lag(request_url) over w prev_url, lag("domain") over w prev_domain
      from b window w as (partition by user_id order by ts_ms, event_id)),
ev as materialized (select *, ts_ms/1000.0::double "timestamp",
              case when event_type in ('click','view','purchase') then prev_url end referrer_url from f),
g as (select *, case when ts_ms - lag(ts_ms) over w <= {GAP_MS} then 0 else 1 end s
      from ev window w as (partition by user_id, "domain" order by ts_ms, event_id)),
h as (select *, sum(s) over (partition by user_id, "domain" order by ts_ms, event_id
                             rows between unbounded preceding and current row) k from g),
i as (select *, (row_number() over (partition by user_id, "domain", k order by ts_ms, event_id)-1)//{VISIT_PAGES} part
      from h),
v as (select user_id, "domain", k, part, list(ts_ms order by ts_ms, event_id) timestamps,
             list(request_url order by ts_ms, event_id) pages,
             first(case when prev_domain <> "domain" then referrer_url end order by ts_ms, event_id) sending_page,
             first(request_url order by ts_ms, event_id) landing_page
      from i group by all),
vs as materialized (select *, "domain"||'*' site, timestamps[1] first_ts,
              row_number() over (partition by user_id order by timestamps[1], "domain") visit_rank from v),
hit as materialized (select user_id, visit_rank, site, first_ts, unnest(timestamps) ts_ms, unnest(pages) page,
               generate_subscripts(timestamps,1)-1 pos from vs),
lab as (select e.*, m.visit_rank from ev e join (
          select user_id, ts_ms, max(visit_rank) visit_rank from hit where visit_rank <= 8 group by all) m
        using (user_id, ts_ms)),
refs as (select a.user_id, a.visit_rank, a.sending_page, coalesce(max(o.visit_rank),0) referrer_rank
         from vs a left join hit o on o.user_id = a.user_id and o.page = a.sending_page
              and o.visit_rank < a.visit_rank and o.ts_ms < a.first_ts
         group by all)
"""


def sql(body: str, upto: str | None = None) -> str:
    """The fixture's steps (only those up to ``upto``, if named) and a query."""
    if upto is None:
        return SQL + body
    following = re.search(rf"(?m)^{upto} as .*?(?=,\n\w+ as |\Z)", SQL, re.S)
    return SQL[:following.end()].rstrip() + "\n" + body
