"""Data preparation: raw events and visits to combined train and test records."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from visitweave.operators import domains, embeddings, grouped, split, urls
from visitweave.sources import combined, events as E, models, suffixes, visits as V
from visitweave.storage import scratch


def embed(events: DataFrame, rules: suffixes.SuffixRules, root: str, seed: int = 0, literal: bool = False) -> dict[str, str]:
    """Train and save both embeddings of ``events`` (with their ``domain``); returns where they are."""
    paths = {"url": f"{root}/url_embedding", "domain": f"{root}/domain_embedding"}
    models.save_embedding(embeddings.fit(
        embeddings.counted_sentences(events, rules, literal), seed=seed, times="times"), paths["url"])
    chains = domains.chains(domains.replace_rare(events))
    models.save_embedding(embeddings.fit(chains, "chain", seed=seed), paths["domain"])
    return paths


def prepare_events(spark: SparkSession, payloads: DataFrame, rules: suffixes.SuffixRules, root: str, seed: int = 0,
                   keep: str = "flagged", mode: str = "drop", literal: bool = False) -> DataFrame:
    """Parse, filter, embed and featurise: ``(user_id, events)`` per user under the limit.

    Events with their domain, URL features and vectors are written once and read back by the later steps.  The
    payloads are read once: the numbers of lines read and left out, written to ``line_counts``, are
    counted while they are parsed.
    """
    counts = Observation("lines")
    parsed = E.standardised(E.parse_events(payloads, mode, counts), rules)
    parsed.write.mode("overwrite").parquet(f"{root}/parsed_events")
    spark.range(1).select(*[F.lit(counts.get[c]).cast("long").alias(c) for c in ("n_lines", "n_rejected")]).write.mode(
        "overwrite").parquet(f"{root}/line_counts")
    users = E.keep_users(spark.read.parquet(f"{root}/parsed_events"), keep)
    kept = urls.domains(E.numbered(users), "request_url", rules)
    kept.write.mode("overwrite").parquet(f"{root}/events")
    events = spark.read.parquet(f"{root}/events")
    paths = embed(events, rules, root, seed, literal)
    ids = domains.dictionary(events)
    dim = urls.url_dimension(events, E.URL_COLUMNS, rules).select("url", "domain_or_default", "vector_tokens")
    dim.write.mode("overwrite").parquet(f"{root}/url_dimension")
    features = embeddings.url_features(
        spark.read.parquet(f"{root}/url_dimension"), models.load_vectors(spark, paths["url"]),
        models.load_vectors(spark, paths["domain"]), ids)
    features.write.mode("overwrite").parquet(f"{root}/url_features")
    hot = grouped.find_hot(events, ["user_id"])
    rows = embeddings.event_features(E.limit_users(events.drop("domain"), hot=hot), spark.read.parquet(f"{root}/url_features"),
                                     "user_id")
    columns = ["ts_ms", "event_id", "timestamp", *E.URL_COLUMNS, "request_vec", "href_vec", "prev_vec"]
    # limit_users has bounded every list already.
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("events"))


def prepare_visits(visits: DataFrame) -> DataFrame:
    """Visit lists per user, first-level sites only."""
    return V.user_visit_lists(V.visit_rows(V.first_level_sites(visits)))


def prepare(spark: SparkSession, payloads: DataFrame, visits: DataFrame, rules: suffixes.SuffixRules, root: str,
            seed: int = 0, keep: str = "flagged", mode: str = "drop") -> DataFrame:
    """Write the combined records, partitioned by split, and read them back."""
    bags = prepare_events(spark, payloads, rules, root, seed, keep, mode)
    whole = split.with_split(combined.combine(bags, prepare_visits(visits)))
    combined.write_combined(whole, f"{root}/combined")
    return combined.read_combined(spark, f"{root}/combined")


def job(spark: SparkSession, events: str, visits: str, out: str, suffix_file: str, keep: str = "flagged",
        mode: str = "drop", seed: int = 0) -> DataFrame:
    """The whole preparation from files to files; schema and first rows of the records lie in ``preview``.

    Intermediate results outside ``out`` are removed.
    """
    with scratch(spark):
        rules = suffixes.read_suffixes(spark, suffix_file)
        done = prepare(spark, E.read_sequence_file(spark, events), V.read_visits(spark, visits), rules, out, seed, keep, mode)
        first = combined.shown(done.select("user_id", "part", "split", "visits"), ["user_id", "part"])
        first.write.mode("overwrite").parquet(f"{out}/preview")
    return done


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="prepare train and test records")
    args.add_argument("events")
    args.add_argument("visits")
    args.add_argument("out")
    args.add_argument("--suffixes", required=True, help="public suffix list file")
    args.add_argument("--keep", choices=["flagged", "clean"], default="flagged")
    args.add_argument("--mode", choices=["drop", "failfast"], default="drop")
    args.add_argument("--seed", type=int, default=0)
    opt = args.parse_args(argv)
    spark = SparkSession.builder.appName("prepare-visits").getOrCreate()
    done = job(spark, opt.events, opt.visits, opt.out, opt.suffixes, opt.keep, opt.mode, opt.seed)
    spark.read.parquet(f"{opt.out}/line_counts").show()
    done.printSchema()
    combined.preview(done.select("user_id", "part", "visits")).show(truncate=False)


if __name__ == "__main__":
    main()
