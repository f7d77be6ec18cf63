"""SequenceFiles: splits, compression, odd texts, what the job reads."""

import io

import pytest
from pyspark.sql import functions as F

from queries.labelling import payloads
from visitweave.sources import events as E, sequence_file as S

TEXT = "org.apache.hadoop.io.Text"


def rows_of(n):
    return [(f"user {i}", f"line {i}\t" + "é😀x" * (i % 70) + "\n" * (i % 3)) for i in range(n)] + [("", ""), ("long", "y" * 400_000)]


def write(spark, rows, path, codec=None, blocks=False, parts=3):
    """Written by Spark's own Hadoop output."""
    conf = {"mapreduce.output.fileoutputformat.compress": str(codec is not None).lower()}
    if codec:
        conf |= {"mapreduce.output.fileoutputformat.compress.codec": codec,
                 "mapreduce.output.fileoutputformat.compress.type": "BLOCK" if blocks else "RECORD"}
    spark.sparkContext.parallelize(rows, parts).saveAsNewAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", TEXT, TEXT, conf=conf)


@pytest.mark.parametrize("codec, blocks", [(None, False), ("org.apache.hadoop.io.compress.DefaultCodec", False),
                                           ("org.apache.hadoop.io.compress.DefaultCodec", True),
                                           ("org.apache.hadoop.io.compress.GzipCodec", True)])
@pytest.mark.parametrize("split", [700, 5_000, 1 << 26])
def test_every_record_once_whatever_the_splits(spark, tmp_path, codec, blocks, split):
    rows = rows_of(900)
    write(spark, rows, str(tmp_path / "in"), codec, blocks)
    got = E.read_sequence_file(spark, str(tmp_path / "in"), split)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_a_large_file_has_many_splits_and_no_pickled_rows(spark, tmp_path):
    rows = [(f"u{i}", f"{i} " * 900) for i in range(2000)]
    write(spark, rows, str(tmp_path / "in"), parts=1)
    got = E.read_sequence_file(spark, str(tmp_path / "in"), 1 << 20)
    assert got.rdd.getNumPartitions() > 5 and sorted(map(tuple, got.collect())) == sorted(rows)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "BatchScan" in plan


def test_sink_is_read_by_hadoop_and_by_the_source(spark, tmp_path):
    rows = rows_of(700) + [(None, None)]
    E.write_sequence_file(spark.createDataFrame(rows, "user_id string, payload string").repartition(3), str(tmp_path / "out"))
    want = sorted((a or "", b or "") for a, b in rows)
    assert sorted(spark.sparkContext.sequenceFile(f"file:{tmp_path}/out", TEXT, TEXT).collect()) == want
    assert sorted(map(tuple, E.read_sequence_file(spark, str(tmp_path / "out"), 3_000).collect())) == want


def test_an_empty_folder_hidden_files_and_a_single_file(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert E.read_sequence_file(spark, str(tmp_path / "none")).count() == 0
    write(spark, rows_of(5), str(tmp_path / "in"), parts=1)
    (tmp_path / "in" / "_hidden").write_bytes(b"no SequenceFile")
    assert E.read_sequence_file(spark, str(tmp_path / "in")).count() == 7
    one = next(tmp_path.glob("in/part-*"))
    assert E.read_sequence_file(spark, str(one)).count() == 7


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"text, not pairs")
    with pytest.raises(Exception, match="not a SequenceFile"):
        E.read_sequence_file(spark, str(tmp_path / "x")).count()
    spark.sparkContext.parallelize([(1, "a")]).saveAsSequenceFile(str(tmp_path / "ints"))
    with pytest.raises(Exception, match="must be texts"):
        E.read_sequence_file(spark, str(tmp_path / "ints")).count()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 255, 256, 70_000, 1 << 30])
def test_lengths(n):
    assert S.read_vint(io.BytesIO(S.write_vint(n))) == n


def test_events_come_back(spark, sf, tmp_path):
    source = payloads(spark, sf)
    E.write_sequence_file(source, str(tmp_path / "events"))
    back = E.read_sequence_file(spark, str(tmp_path / "events"), 10_000)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, source.collect()))
