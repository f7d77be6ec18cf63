"""Training and evaluation of a window classifier."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.config import TRAIN_FRACTION
from visitweave.operators import classifier, evaluate, sequences, split
from visitweave.sources import combined, models
from visitweave.storage import scratch


def samples_of(records: DataFrame, mode: str) -> DataFrame:
    """Summarised learning set of combined records."""
    make = sequences.learning_set(mode)
    events = combined.events_of(records, ["event_id", "ts_ms", "timestamp", "request_url"])
    return classifier.window_summary(sequences.non_empty(make(events, combined.visits_of(records))))


def train(spark: SparkSession, train_records: DataFrame, test_records: DataFrame, mode: str, model_path: str,
          log_path: str, n_epochs: int = 1, fraction: float = TRAIN_FRACTION, seed: int = 0, iterations: int = 50):
    """Fit epoch by epoch on fresh samples, saving the model and its test metrics each time.

    A model already saved at ``model_path`` is trained further.
    """
    work = f"{model_path}.samples"
    keep = ["user_id", "event_id", "inputs", "label"]
    samples_of(train_records, mode).select(*keep).write.mode("overwrite").parquet(f"{work}/train")
    samples_of(test_records, mode).select(*keep).write.mode("overwrite").parquet(f"{work}/test")
    learn, check = spark.read.parquet(f"{work}/train"), spark.read.parquet(f"{work}/test")
    model = models.load_classifier(spark, model_path)
    for epoch in range(n_epochs):
        part = split.sample(learn, fraction, seed + epoch, ["user_id", "event_id", "inputs"])
        model = classifier.fit(part, mode, seed, iterations, resume=model)
        models.save_classifier(model, model_path)
        metrics = [classifier.losses(classifier.score(d, model)).withColumn("type", F.lit(t))
                   for t, d in (("batch", part), ("epoch", check))]
        models.write_metrics(metrics[0].unionByName(metrics[1]), log_path)
    return model


def evaluate_model(records: DataFrame, mode: str, model) -> tuple[DataFrame, DataFrame]:
    """Confusion cells and (accuracy, samples) of a model on combined records."""
    scored = classifier.score(samples_of(records, mode), model)
    pairs = scored.select("predicted", F.col("label").cast("int").alias("actual"))
    return evaluate.confusion(pairs), evaluate.accuracy(pairs)


def train_job(spark: SparkSession, records: str, mode: str, model_path: str, log_path: str, n_epochs: int = 1,
              seed: int = 0, iterations: int = 50):
    """Train on the folder of combined records; intermediate results are removed."""
    with scratch(spark):
        learn, test = (combined.read_combined(spark, records, s) for s in ("train", "test"))
        return train(spark, learn, test, mode, model_path, log_path, n_epochs, seed=seed, iterations=iterations)


def evaluate_job(spark: SparkSession, records: str, mode: str, model_path: str, log_path: str) -> DataFrame:
    """Test a saved model on the folder's test records: writes the confusion cells and (accuracy, samples), returns the latter."""
    with scratch(spark):
        model = models.load_classifier(spark, model_path)
        cells, total = evaluate_model(combined.read_combined(spark, records, "test"), mode, model)
        cells.write.mode("overwrite").option("header", True).csv(f"{log_path}.confusion")
        total.write.mode("overwrite").parquet(f"{log_path}.accuracy")
    return spark.read.parquet(f"{log_path}.accuracy")


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description="train or evaluate a window classifier")
    args.add_argument("job", choices=["train", "evaluate"])
    args.add_argument("--mode", choices=["visit", "multi-visit", "multi-transfer"], default="multi-transfer")
    args.add_argument("--records", required=True, help="folder of combined records")
    args.add_argument("--model-path", required=True)
    args.add_argument("--log-path", required=True)
    args.add_argument("--epochs", type=int, default=1)
    args.add_argument("--seed", type=int, default=0)
    opt = args.parse_args(argv)
    spark = SparkSession.builder.appName("visit-model").getOrCreate()
    if opt.job == "train":
        train_job(spark, opt.records, opt.mode, opt.model_path, opt.log_path, opt.epochs, opt.seed)
    else:
        evaluate_job(spark, opt.records, opt.mode, opt.model_path, opt.log_path).show()


if __name__ == "__main__":
    main()
