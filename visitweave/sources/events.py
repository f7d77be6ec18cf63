"""Browsing events: reading, parsing and user-level filters.

Flat layout used everywhere: ``user_id, event_id, timestamp`` (double seconds), ``ts_ms,
request_url, referrer_url, prev_url``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from visitweave.config import LIST_ROWS, MAX_USER_EVENTS
from visitweave.operators import grouped, urls
from visitweave.sources import sequence_file
from visitweave.sources.suffixes import SuffixRules

# Tab-separated positions in an event line.
FIELD = {"timestamp": 0, "referrer_url": 10, "prev_url": 11, "request_url": 12}
URL_COLUMNS = ["request_url", "referrer_url", "prev_url"]


def read_sequence_file(spark: SparkSession, path: str, split_bytes: int = sequence_file.SPLIT_BYTES) -> DataFrame:
    """``(user_id, payload)`` from SequenceFiles of text pairs."""
    sequence_file.register(spark)
    pairs = spark.read.format(sequence_file.FORMAT).option("splitBytes", split_bytes).load(path)
    return pairs.select(F.col("key").alias("user_id"), F.col("value").alias("payload"))


def write_sequence_file(payloads: DataFrame, path: str) -> None:
    """``(user_id, payload)`` as SequenceFiles in a new folder."""
    sequence_file.register(payloads.sparkSession)
    payloads.selectExpr("cast(user_id as string) as key", "payload as value").write.format(
        sequence_file.FORMAT).mode("append").save(path)


def event_lines(payloads: DataFrame) -> DataFrame:
    """One row per line of a user's payload, with its place in it."""
    lines = F.split(F.rtrim(F.col("payload"), F.lit("\n")), "\n")
    return payloads.select("user_id", F.posexplode(lines).alias("event_id", "line"))


def _fields(lines: DataFrame) -> DataFrame:
    parts = F.split("line", "\t")
    return lines.select("*", *[F.try_element_at(parts, F.lit(i + 1)).alias(c) for c, i in FIELD.items()])


def _well_formed() -> Column:
    # A line needs a number first and a non-empty tail at or after the request URL.
    tail = F.rtrim(F.element_at(F.split("line", "\t", FIELD["request_url"] + 1), -1), F.lit("\t"))
    return (F.col("timestamp").try_cast("double").isNotNull() & F.col("request_url").isNotNull()
            & (tail != ""))


def line_counts() -> list[Column]:
    """Lines read and lines that ``mode='drop'`` leaves out."""
    good = F.coalesce(_well_formed(), F.lit(False))
    return [F.count(F.lit(1)).alias("n_lines"), F.count_if(~good).alias("n_rejected")]


def parse_events(payloads: DataFrame, mode: str = "drop", counts: Observation | None = None) -> DataFrame:
    """Events with URLs as logged.  ``mode='failfast'`` stops at a malformed line.

    ``event_id`` is the place in the record; ``numbered`` makes it unique per user.  ``counts``
    observes the ``line_counts`` in flight and has them after the first action on the result.
    """
    rows = _fields(event_lines(payloads))
    if counts is not None:
        rows = rows.observe(counts, *line_counts())
    if mode == "drop":
        rows = rows.filter(_well_formed())
    elif mode == "failfast":
        rows = rows.filter(F.when(_well_formed(), True).otherwise(
            F.raise_error(F.concat(F.lit("malformed event line: "), "line")).cast("boolean")))
    else:
        raise ValueError("mode is 'drop' or 'failfast'")
    ts = F.col("timestamp").cast("double")
    return rows.select("user_id", F.col("event_id").cast("long").alias("event_id"), ts.alias("timestamp"),
                       F.round(ts * 1000).cast("long").alias("ts_ms"), *URL_COLUMNS)


def numbered(events: DataFrame, hot: grouped.HotGroups | None = None) -> DataFrame:
    """``event_id`` as the place, from 0, among all events of the user, whatever records they came in.

    The order is that of time, then of the place in the record; rows that are alike throughout
    get different numbers too.
    """
    order = ["ts_ms", "event_id", *URL_COLUMNS, "timestamp"]
    placed = grouped.position(events, ["user_id"], order, "_place", hot)
    return placed.withColumn("event_id", F.col("_place") - 1).drop("_place")


def reject_count(payloads: DataFrame) -> DataFrame:
    """Lines read and lines that ``mode='drop'`` leaves out."""
    return _fields(event_lines(payloads)).agg(*line_counts())


def standardised(events: DataFrame, rules: SuffixRules) -> DataFrame:
    return urls.standardise(events, URL_COLUMNS, rules)


def flatten(bags: DataFrame) -> DataFrame:
    """Event rows from ``(user_id, events array<struct>)``."""
    return bags.select("user_id", F.inline("events"))


def url_rows(events: DataFrame) -> DataFrame:
    """Three rows per event, one per URL column: ``(user_id, event_id, url_kind, url)``."""
    return events.unpivot(["user_id", "event_id"], URL_COLUMNS, "url_kind", "url")


def _with_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    return rows.join(users, "user_id", "left_semi")


def keep_users(events: DataFrame, keep: str = "flagged") -> DataFrame:
    """Users with an event whose request URL is shorter than three characters.

    That is the published rule; ``keep='clean'`` gives all other users.
    """
    short = F.length("request_url") < 3
    if keep == "flagged":
        return _with_users(events, events.filter(short).select("user_id").distinct())
    if keep == "clean":
        users = events.groupBy("user_id").agg(F.bool_or(short).alias("bad")).filter("not bad")
        return _with_users(events, users)
    raise ValueError("keep is 'flagged' or 'clean'")


def limit_users(events: DataFrame, below: int = MAX_USER_EVENTS,
                hot: grouped.HotGroups | None = None) -> DataFrame:
    """Users with fewer than ``below`` events (counted map-side first).

    Users known to be ``hot`` are over the limit, so they leave before anything is shuffled.
    """
    if hot is not None and hot.rows and hot.limit >= below:
        events = grouped.split_hot(events, hot)[0]
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < below)
    return _with_users(events, users)


def event_parts(events: DataFrame, columns: list[str], size: int = LIST_ROWS,
                hot: grouped.HotGroups | None = None) -> DataFrame:
    """``(user_id, part, events)`` of every user in time order, ``size`` events to a part."""
    placed = grouped.position(events, ["user_id"], ["ts_ms", "event_id"], "_place", hot)
    return placed.groupBy("user_id", F.floor((F.col("_place") - 1) / size).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("events"))


def event_bags(events: DataFrame, columns: list[str] | None = None, below: int = MAX_USER_EVENTS,
               hot: grouped.HotGroups | None = None) -> DataFrame:
    """``(user_id, events)`` in time order for users under the event limit.

    The limit is applied before grouping, so an array never exceeds it.
    """
    columns = columns or ["ts_ms", "event_id", "timestamp", *URL_COLUMNS]
    hot = hot or grouped.find_hot(events, ["user_id"])
    return limit_users(events, below, hot).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("events"))
