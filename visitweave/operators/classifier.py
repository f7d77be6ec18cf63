"""Classifier of event windows on Spark ML."""

from __future__ import annotations

import io

import numpy as np
from pyspark.ml.classification import (MultilayerPerceptronClassificationModel,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitweave.config import MAX_VISITS
from visitweave.functions.arrays import arg_max
from visitweave.sources.sequence_file import locate

HIDDEN = {"visit": [24], "multi-visit": [32], "multi-transfer": [32]}


def window_summary(samples: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Fixed-length ``inputs`` of a window.

    Share of each label among its earlier events, the label just before the candidate, how
    full it is, and the time since the user's first event where known.  ``near(user_id, event_id, cosines)``
    adds how near the candidate's URL is to each visit so far (``centroids.cosines``).
    """
    size = F.size("sequence")
    if dict(samples.dtypes)["sequence"] == "array<bigint>":
        real = F.size(F.filter("sequence", lambda e: e >= 0))
        extra = [F.col("visit_rank").cast("double") / MAX_VISITS]
        marks = []
    else:
        real = F.size(F.filter("sequence", lambda e: e["event_id"] >= 0))
        before = F.slice("sequence", 1, size - 1)
        share = lambda c: F.size(F.filter(before, lambda e: e["label"] == c)) / size
        last = F.element_at("sequence", -2)["label"]
        marks = [share(c) for c in range(1, MAX_VISITS + 1)]
        marks += [(last == c).cast("double") for c in range(1, MAX_VISITS + 1)]
        marks.append(F.element_at("sequence", -1)["label"].cast("double") / MAX_VISITS)
        extra = [F.log1p("rel_time") / 10]
    inputs = F.array(*[m.cast("double") for m in [*marks, real / size, *extra]])
    if near is None:
        return samples.withColumn("inputs", inputs)
    return samples.withColumn("inputs", inputs).join(near, ["user_id", "event_id"]).withColumn(
        "inputs", F.concat("inputs", "cosines")).drop("cosines")


def fit(samples: DataFrame, mode: str = "multi-visit", seed: int = 0, iterations: int = 50,
        resume: MultilayerPerceptronClassificationModel | None = None):
    """Train on summarised samples (``inputs``, ``label``), from given weights when resuming."""
    ready = samples.select(array_to_vector("inputs").alias("features"), F.col("label").cast("double").alias("label"))
    n_inputs = ready.select(F.size(vector_to_array("features"))).first()[0]
    net = MultilayerPerceptronClassifier(layers=[n_inputs, *HIDDEN[mode], MAX_VISITS], seed=seed,
                                         maxIter=iterations, blockSize=256)
    if resume is not None:
        net = net.setInitialWeights(resume.weights)
    return net.fit(ready)


def score(samples: DataFrame, model) -> DataFrame:
    """Add ``scores`` (one per class) and ``predicted``."""
    ready = samples.withColumn("features", array_to_vector("inputs"))
    out = model.transform(ready).withColumn("scores", vector_to_array("probability"))
    return out.select(*samples.columns, "scores", arg_max(F.col("scores")).alias("predicted"))


def score_external(samples: DataFrame, make_predict, batch_size: int = 1024) -> DataFrame:
    """Score with a model from elsewhere, loaded once per Python worker.

    ``make_predict()`` gives a function from a batch of ``inputs`` to one score row each.
    """
    width = samples.select(F.size("inputs")).first()[0]
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                                input_tensor_shapes=[[width]])
    scored = samples.withColumn("scores", predict("inputs"))
    return scored.withColumn("predicted", arg_max(F.col("scores")))


def predictor(path: str):
    """What loads a saved model from the shared folder, once per worker, and scores batches of ``x``.

    ``.npz`` files hold a linear model, ``weights`` (classes x inputs) and ``bias``; ``.onnx`` files any
    network with one input and one output.
    """
    def load():
        system, place = locate(path)
        with system.open_input_file(place) as file:
            body = file.read()
        if path.endswith(".onnx"):
            import onnxruntime
            session = onnxruntime.InferenceSession(body, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            return lambda x: session.run(None, {name: x.astype(np.float32)})[0].astype(float)
        held = np.load(io.BytesIO(body))
        weights, bias = held["weights"].astype(float), held["bias"].astype(float)
        return lambda x: x.astype(float) @ weights.T + bias
    return load


def save_linear(path: str, weights: np.ndarray, bias: np.ndarray) -> None:
    """A linear model as ``predictor`` reads it."""
    body = io.BytesIO()
    np.savez(body, weights=weights, bias=bias)
    system, place = locate(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(body.getvalue())


def score_feed(rows: DataFrame, path: str, inputs: int, batch_size: int = 1024) -> DataFrame:
    """Rows of the dense feed with the ``scores`` of a saved model and the ``predicted`` class."""
    predict = predict_batch_udf(predictor(path), return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                                input_tensor_shapes=[[inputs]])
    return rows.withColumn("scores", predict("x")).withColumn("predicted", arg_max(F.col("scores")))


def losses(scored: DataFrame) -> DataFrame:
    """``(loss, accuracy)``: mean cross-entropy and share of hits."""
    p = F.greatest(F.element_at("scores", F.col("label").cast("int") + 1), F.lit(1e-15))
    return scored.agg(F.avg(-F.log(p)).alias("loss"),
                      F.avg((F.col("predicted") == F.col("label")).cast("int")).alias("accuracy"))
