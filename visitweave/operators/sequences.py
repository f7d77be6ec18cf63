"""Per-user event sequences and the three learning sets.

A window is kept as an array of ``(event_id, label)``; vectors are joined and laid out only
at export, since 32 dense rows per event would repeat every event 32 times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitweave.config import MAX_T, MAX_VISITS, VISIT_MAX_T
from visitweave.functions.arrays import one_hot, pad_left
from visitweave.operators import grouped, labels, transfers
from visitweave.operators.grouped import HotGroups, Running
from visitweave.sources import visits as V
from visitweave.storage import durable

ORDER = ["ts_ms", "event_id"]


def ordered(events: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Add ``event_no``, the 1-based place of an event in the user's history."""
    return grouped.position(events, ["user_id"], ORDER, "event_no", hot)


def first_times(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts_ms").alias("start_ms"))


def since_start(events: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Add ``rel_time``: seconds since the user's first event.

    Events run in time order, so the smallest time so far is the first one.
    """
    out = grouped.running(events, ["user_id"], ORDER, {"_neg": Running("max", -F.col("ts_ms"))}, hot)
    return out.withColumn("rel_time", (F.col("ts_ms") + F.col("_neg")) / F.lit(1000.0)).drop("_neg")


def event_windows(events: DataFrame, size: int = MAX_T, label: Column | None = None,
                  mask_last: bool = False, hot: HotGroups | None = None) -> DataFrame:
    """Add ``sequence``: the last ``size`` events of the user as ``(event_id, label)``.

    Padded on the left with -1; ``mask_last`` hides the label of the newest event.
    """
    item = F.struct("event_id", (F.lit(-1) if label is None else label).cast("int").alias("label"))
    out = grouped.trailing(events, ["user_id"], ORDER, size, item, "sequence", hot)
    pad = F.struct(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).alias("label"))
    seq = pad_left(F.col("sequence"), size, pad)
    if mask_last:
        newest = F.element_at(seq, -1)
        seq = F.concat(F.slice(seq, 1, size - 1), F.array(
            F.struct(newest["event_id"].alias("event_id"), F.lit(-1).alias("label"))))
    return out.withColumn("sequence", seq)


def non_empty(samples: DataFrame) -> DataFrame:
    return samples.filter(F.size("sequence") > 0)


def _labelled(events, ranked, match, hot, carry=()):
    marked = labels.label_events(events, ranked, match, matched_only=False, carry=carry)
    return since_start(marked, hot).filter("visit_rank > 0")


def multi_visit(events: DataFrame, visit_rows: DataFrame, max_t: int = MAX_T, match: str = "ms",
                hot: HotGroups | None = None) -> DataFrame:
    """Event -> visit 0..7, with the window before it and its own label hidden."""
    hot = hot or grouped.find_hot(events, ["user_id"])
    kept = _labelled(events, V.first_visits(visit_rows), match, hot)
    out = event_windows(kept, max_t, F.col("visit_rank"), mask_last=True, hot=hot)
    label = F.col("visit_rank") - 1
    return out.select("user_id", "event_id", "ts_ms", "rel_time", "sequence", label.alias("label"),
                      one_hot(label, MAX_VISITS).alias("one_hot"))


def multi_transfer(events: DataFrame, visit_rows: DataFrame, max_t: int = MAX_T, match: str = "ms",
                   hot: HotGroups | None = None) -> DataFrame:
    """Event -> referring visit of its visit, 0 = direct; labels stay visible.

    ``hot`` users are found by their events; their visits are about the same events.
    """
    hot = hot or grouped.find_hot(events, ["user_id"])
    ranked = durable(V.first_visits(visit_rows))   # read twice
    # The referrer is joined to the few visits of a user and reaches the events with the rank.
    sent = transfers.referrals(ranked, hot).select("user_id", "visit_rank", "referrer_rank")
    kept = _labelled(events, ranked.join(sent, ["user_id", "visit_rank"]), match, hot, ("referrer_rank",))
    out = event_windows(kept, max_t, F.col("visit_rank"), hot=hot)
    label = F.col("referrer_rank")
    return out.select("user_id", "event_id", "ts_ms", "rel_time", "sequence", label.alias("label"),
                      one_hot(label, MAX_VISITS).alias("one_hot"))


def single_visit(events: DataFrame, visit_rows: DataFrame, max_t: int = VISIT_MAX_T, match: str = "ms",
                 hot: HotGroups | None = None) -> DataFrame:
    """(visit, event) -> 0 this visit, 1 another visit, 2 another visit that this one referred.

    An event meets the user's first eight visits, so the output is at most eight rows per
    event.  ``sequence`` holds the visit's latest events before the candidate, then the
    candidate.
    """
    hot = hot or grouped.find_hot(events, ["user_id"])
    ranked = durable(V.first_visits(visit_rows))   # read twice
    # At most eight entries per user, in rank order.
    menu = (transfers.referrals(ranked, hot).groupBy("user_id")
            .agg(F.array_sort(F.collect_list(F.struct("visit_rank", "referrer_rank")))["referrer_rank"].alias("_menu")))
    kept = labels.label_events(events, ranked.join(menu, "user_id"), match, carry=("_menu",))
    cold, large = grouped.split_hot(kept, hot)
    # Ordinary users are moved once, by user; all windows below are within a user.
    parts = [_visit_pairs(cold.repartition("user_id"), max_t, hot._replace(frame=None, groups=0, rows=0))]
    if large is not None:
        parts.append(_visit_pairs(large, max_t, hot))
    return reduce(DataFrame.unionByName, parts)


def _visit_pairs(kept, max_t, hot):
    own = grouped.trailing(kept, ["user_id", "visit_rank"], ORDER, max_t - 1, F.col("event_id"), "_own", hot)
    # An event is sorted once and gets the latest state of all eight visits; only then it is repeated.
    last = {f"_v{r}": Running("max", F.when(F.col("visit_rank") == r, F.struct("ts_ms", "event_id", "_own")), inclusive=False)
            for r in range(1, MAX_VISITS + 1)}
    seen = grouped.running(own, ["user_id"], ORDER, last, hot)
    states = F.slice(F.array(*[F.col(f"{v}._own") for v in last]), 1, F.size("_menu"))
    pairs = seen.select("user_id", "event_id", "ts_ms", F.col("visit_rank").alias("event_visit"), "_menu",
                        F.posexplode(states).alias("_place", "_before"))
    before = F.coalesce("_before", F.array().cast("array<bigint>"))
    rank = F.col("_place") + 1
    label = F.when(F.col("event_visit") == rank, 0).when(F.element_at("_menu", F.col("event_visit")) == rank, 2).otherwise(1)
    return pairs.select("user_id", rank.alias("visit_rank"), "event_id", "ts_ms",
                        pad_left(F.concat(before, F.array("event_id")), max_t, F.lit(-1).cast("long")).alias("sequence"),
                        label.alias("label"))


def learning_set(mode: str):
    """The learning set of a mode: ``visit``, ``multi-visit`` or ``multi-transfer``."""
    return {"visit": single_visit, "multi-visit": multi_visit, "multi-transfer": multi_transfer}[mode]
