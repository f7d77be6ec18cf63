"""Saving and loading embeddings, classifiers and metric logs."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession

from visitweave.operators.embeddings import vector_table


def save_embedding(model: Word2VecModel | DataFrame, path: str) -> None:
    """The vectors as a table and, if there is one, the model itself; a model saved there before is removed."""
    if isinstance(model, DataFrame):
        system, place = _located(model.sparkSession, f"{path}/model")
        system.delete(place, True)
    else:
        model.write().overwrite().save(f"{path}/model")
    vector_table(model).write.mode("overwrite").parquet(f"{path}/vectors")


def load_embedding(path: str) -> Word2VecModel | DataFrame:
    """What ``embeddings.fit`` gave: the model, or the table of an embedding that has none."""
    spark = SparkSession.active()
    return Word2VecModel.load(f"{path}/model") if exists(spark, f"{path}/model") else load_vectors(spark, path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def _located(spark: SparkSession, path: str):
    """Hadoop's file system and path object."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def save_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(spark: SparkSession, path: str):
    """The saved classifier, or ``None``."""
    return MultilayerPerceptronClassificationModel.load(path) if exists(spark, path) else None


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``type, loss, accuracy`` rows as CSV with a header."""
    metrics.select("type", "loss", "accuracy").write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("type string, loss double, accuracy double").csv(path)
