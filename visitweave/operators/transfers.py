"""Which earlier visit referred a visit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.operators import grouped
from visitweave.operators.grouped import Running


def referrals(ranked: DataFrame, hot: grouped.HotGroups | None = None) -> DataFrame:
    """``(user_id, visit_rank, sending_page, referrer_rank)`` for every visit.

    The referrer is the last earlier visit of the user that showed the sending page before
    this visit landed; 0 when there is none.

    A visit and its candidates compare with one time only, the landing time.  So instead of
    pairing visits, every page of a visit becomes one row at the moment from which it may
    refer others, every visit one row at its landing, and a running maximum of the rank
    over (user, page) in that order answers all visits at once.
    """
    first = F.col("first_ts")
    seen = F.filter(F.arrays_zip("timestamps", "pages"), lambda h: h["timestamps"].isNotNull() & (
        F.coalesce(h["pages"], F.lit("")) != ""))
    # A page seen after its own visit's start needs a strictly later landing (phase 1); one
    # seen before that only needs a later rank.
    offers = F.transform(seen, lambda h, i: F.struct(
        h["pages"].alias("page"), F.greatest(h["timestamps"], first).alias("at"),
        F.when(h["timestamps"] >= first, 1).otherwise(0).alias("phase"), F.lit(1).alias("is_offer"),
        i.alias("pos")))
    ask = F.struct(F.coalesce("sending_page", F.lit("")).alias("page"), first.alias("at"),
                   F.lit(0).alias("phase"), F.lit(0).alias("is_offer"), F.lit(-1).alias("pos"))
    rows = ranked.select("user_id", "visit_rank", F.inline(F.concat(offers, F.array(ask))))
    found = grouped.running(
        rows, ["user_id", "page"], ["at", "phase", "visit_rank", "is_offer", "pos"],
        {"referrer_rank": Running("max", F.when(F.col("is_offer") == 1, F.col("visit_rank")))}, hot)
    return found.filter("is_offer = 0").select(
        "user_id", "visit_rank", F.col("page").alias("sending_page"),
        F.coalesce("referrer_rank", F.lit(0)).cast("int").alias("referrer_rank"))


def transfers(ranked: DataFrame, hot: grouped.HotGroups | None = None) -> DataFrame:
    """Referral edges only: visits with a referring visit."""
    return referrals(ranked, hot).filter("referrer_rank > 0")
