"""Durable intermediate results and the folder they live in."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folder of the innermost ``scratch``; threads started inside one store in the shared folder itself.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then uses a folder of its warehouse.
    """
    sc = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
             or sc.getCheckpointDir())
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/visitweave-{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder, one per call: inside the innermost ``scratch``, or else inside the shared folder."""
    return f"{(_SCRATCH.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Unlike a cached or recomputed plan it survives lost executors unchanged, and Spark
    knows its size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Whatever is stored inside is removed at the end, also after an error.

    For jobs whose output is written to a place of its own.  A DataFrame made inside may still read
    stored results, so only what was written there may be used afterwards.
    """
    folder = fresh_path(spark, "scratch")
    outer = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
