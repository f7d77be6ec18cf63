"""The dense training feed: windows laid out in sorted shard files, with an index.

A file holds the windows of one shard in feed order as 32-bit floats, ``rows x steps x width``, in packed blocks of
``READ_ROWS`` windows, then their labels as 32-bit integers.  Neighbouring windows share most of their rows, which
packing finds.  Since every block has the same number of windows, a trainer finds any batch by arithmetic
(``Feed.batch``), and Spark reads the files block by block (``read``).

    <path>/blocks/<shard>/<name>      the files
    <path>/index                      one row per file; a file that is not listed does not exist; ``ends`` says where its
                                      packed blocks end, ``bytes`` and ``checksum`` are those of its content unpacked
    <path>/keys                       which sample stands where
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitweave.operators import grouped
from visitweave.operators.split import md5_bucket
from visitweave.sources.sequence_file import locate
from visitweave.storage import durable

#: Windows of one file.
FILE_ROWS = 16_384
#: Windows of one block, which are packed and read at once.
READ_ROWS = 256
PACKED = "zstd"
INDEX = "shard long, file long, first long, rows long, steps long, width long, name string, bytes long, checksum long, ends array<long>"
#: What ``windows`` are dealt and ordered by, for ``embeddings.dense``.
NEAR = ("shard", "file", "place")
ROW = "shard long, place long, label int, x array<float>"


def placed(samples: DataFrame, shards: int, seed: int) -> DataFrame:
    """``user_id, event_id, shard, place`` (from 0): users in the order of a hash, their samples in time order.

    ``samples`` have a unique ``(user_id, event_id)`` and ``ts_ms``.
    """
    return _with_place(samples.select("user_id", "event_id", "ts_ms"), shards, seed).select("user_id", "event_id", "shard", "place")


def _with_place(samples: DataFrame, shards: int, seed: int) -> DataFrame:
    """``samples`` with ``shard`` and ``place``: those of earlier users in the shard, then earlier ones of the user.

    Only one row per user is ordered over a whole shard; the samples are moved once, by user.
    """
    users = samples.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    keyed = users.select("user_id", "_n", md5_bucket(F.col("user_id"), shards).alias("shard"),
                         F.md5(F.concat(F.lit(f"{seed}|"), "user_id")).alias("_key"))
    before = grouped.running(durable(keyed), ["shard"], ["_key", "user_id"],
                             {"_start": grouped.Running("sum", F.col("_n"), inclusive=False)})
    own = grouped.position(samples, ["user_id"], ["ts_ms", "event_id"], "_own")
    place = F.coalesce("_start", F.lit(0)) + F.col("_own") - 1
    return own.join(before.select("user_id", "shard", "_start"), "user_id").select(
        *samples.columns, "shard", place.cast("long").alias("place"))


def write(samples: DataFrame, windows: DataFrame | Callable[[DataFrame], DataFrame], path: str, steps: int, width: int,
          shards: int = 64, seed: int = 0, file_rows: int = FILE_ROWS) -> None:
    """Write ``windows(user_id, sample_id, x)`` of ``samples(user_id, event_id, ts_ms, label)`` to a new folder.

    ``windows`` may be a function of the samples with their ``shard, file, place`` that gives these, ``label`` and ``x``,
    dealt by ``shard, file`` and ordered by ``place`` (``embeddings.dense`` with ``NEAR``): then no window is shuffled.
    """
    spark = samples.sparkSession
    file = F.floor(F.col("place") / file_rows).alias("file")
    if callable(windows):
        stored = durable(_with_place(samples.withColumn("label", F.col("label").cast("int")), shards, seed).select("*", file))
        stored.select("user_id", "event_id", "shard", "place").write.parquet(f"{path}/keys")
        dealt = windows(stored)
    else:
        placed(samples, shards, seed).write.parquet(f"{path}/keys")
        keys = spark.read.parquet(f"{path}/keys").join(samples.select("user_id", "event_id", "label"), ["user_id", "event_id"])
        rows = windows.withColumnRenamed("sample_id", "event_id").join(keys, ["user_id", "event_id"]).select("*", file)
        dealt = rows.repartition("shard", "file").sortWithinPartitions("shard", "file", "place")
    dealt = dealt.select("shard", "file", "place", F.col("label").cast("int").alias("label"),
                         F.flatten("x").cast("array<float>").alias("x"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = locate(path)
        now, out, labels, held = None, None, [], []

        def pack(x):
            body = x.tobytes()
            packed = pa.compress(body, codec=PACKED, asbytes=True)
            out["stream"].write(packed)
            out["ends"].append((out["ends"] or [0])[-1] + len(packed))
            out["bytes"] += len(body)
            out["sum"] = crc32(body, out["sum"])

        def fill(x):
            """Packs whole blocks; what is left of ``x`` waits in ``held``."""
            waiting = sum(map(len, held))
            while waiting + len(x) >= READ_ROWS:
                some, x = x[:READ_ROWS - waiting], x[READ_ROWS - waiting:]
                pack(np.concatenate([*held, some]))
                held.clear()
                waiting = 0
            if len(x):
                held.append(x)

        def close():
            if held:
                pack(np.concatenate(held))
                held.clear()
            tail = np.array(labels, "<i4").tobytes()
            out["stream"].write(tail)
            out["stream"].close()
            entry = [*now, out["first"], len(labels), steps, width, out["name"], out["bytes"] + len(tail), crc32(tail, out["sum"]),
                     out["ends"]]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in entry], [f.split()[0] for f in INDEX.split(", ")])
        for batch in batches:
            x = batch.column(4).flatten().to_numpy().astype("<f4").reshape(-1, steps * width)
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(key[lo].tolist()) != now:
                    if now is not None:
                        yield close()
                    now, labels = tuple(key[lo].tolist()), []
                    name = f"blocks/{now[0]}/{now[1]}-{uuid.uuid4().hex}"
                    system.create_dir(f"{folder}/blocks/{now[0]}", recursive=True)
                    out = {"stream": system.open_output_stream(f"{folder}/{name}"), "name": name, "bytes": 0, "sum": 0, "ends": [],
                           "first": batch.column(2)[lo].as_py()}
                fill(x[lo:hi])
                labels += batch.column(3).slice(lo, hi - lo).to_pylist()
        if now is not None:
            yield close()
    dealt.mapInArrow(store, INDEX).write.parquet(f"{path}/index")


def unpacked(file, entry: dict, block: int) -> np.ndarray:
    """The windows of a block of an open file, ``rows x (steps * width)``, by the file's row of the index."""
    ends, size = entry["ends"], entry["steps"] * entry["width"]
    start, n = ends[block - 1] if block else 0, min(READ_ROWS, entry["rows"] - block * READ_ROWS)
    packed = file.read_at(ends[block] - start, start)
    return np.frombuffer(pa.decompress(packed, decompressed_size=4 * n * size, codec=PACKED, asbytes=True), "<f4").reshape(n, size)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``shard, place, label, x`` of all windows, ``x`` as one row of ``steps * width`` numbers."""
    index = spark.read.parquet(f"{path}/index").select("name", "shard", "first", "rows", "steps", "width", "ends")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = locate(path)
        for batch in batches:
            for entry in batch.to_pylist():
                with system.open_input_file(f"{folder}/{entry['name']}") as file:
                    labels = np.frombuffer(file.read_at(4 * entry["rows"], entry["ends"][-1]), "<i4")
                    for block in range(len(entry["ends"])):
                        x, at = unpacked(file, entry, block), block * READ_ROWS
                        n, size = x.shape
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.array(x.ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, entry["shard"])), pa.array(np.arange(entry["first"] + at, entry["first"] + at + n)),
                             pa.array(labels[at:at + n]), lists], ["shard", "place", "label", "x"])
    return index.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(load, ROW)


def with_keys(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` of the feed (``shard, place`` and what was made of ``x``) with the sample that stands there.

    Spark takes what is read from the files for as small as their index and would broadcast all windows; the hint
    keeps both sides in the shuffle.
    """
    return rows.hint("merge").join(spark.read.parquet(f"{path}/keys"), ["shard", "place"])


class Feed:
    """The feed for a trainer, without Spark."""

    def __init__(self, path: str):
        self.system, self.folder = locate(path)
        rows = pq.read_table(f"{self.folder}/index", filesystem=self.system).to_pylist()
        self.files: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["shard"], r["first"])):
            self.files.setdefault(r["shard"], []).append(r)
        self.shards = sorted(self.files)

    def rows(self, shard: int) -> int:
        return sum(r["rows"] for r in self.files[shard])

    def batch(self, shard: int, number: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows ``[n, steps, width]`` and labels of a batch, which may lie in several files."""
        start, end = number * size, min((number + 1) * size, self.rows(shard))
        xs, labels = [], []
        for r in self.files[shard]:
            lo, hi = max(start, r["first"]) - r["first"], min(end, r["first"] + r["rows"]) - r["first"]
            if lo < hi:
                block, last = lo // READ_ROWS, (hi - 1) // READ_ROWS
                with self.system.open_input_file(f"{self.folder}/{r['name']}") as file:
                    x = np.concatenate([unpacked(file, r, b) for b in range(block, last + 1)])
                    labels.append(np.frombuffer(file.read_at(4 * (hi - lo), r["ends"][-1] + 4 * lo), "<i4"))
                xs.append(x[lo - block * READ_ROWS:hi - block * READ_ROWS].reshape(-1, r["steps"], r["width"]))
        if not xs:
            raise IndexError(f"shard {shard} has no batch {number}")
        return np.concatenate(xs), np.concatenate(labels)
