"""Intermediate results and how long they live."""

import os

import pytest

from visitweave.storage import durable, fresh_path, scratch, shared_dir


def shared_names(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_results_stored_inside_are_removed(spark):
    outside = durable(spark.range(3))
    before = shared_names(spark)
    kept = fresh_path(spark, "kept")
    with scratch(spark):
        inside = durable(spark.range(5))
        with scratch(spark):
            assert durable(inside.filter("id > 1")).count() == 3
        assert inside.count() == 5       # the inner one took only its own results
        inside.write.parquet(kept)
    assert shared_names(spark) - before == {os.path.basename(kept)}
    assert outside.count() == 3 and spark.read.parquet(kept).count() == 5


def test_removed_after_an_error(spark):
    durable(spark.range(1))
    before = shared_names(spark)
    with pytest.raises(ValueError), scratch(spark):
        durable(spark.range(5))
        raise ValueError
    assert shared_names(spark) == before
    assert durable(spark.range(2)).count() == 2 and len(shared_names(spark) - before) == 1


def test_a_scratch_without_results(spark):
    durable(spark.range(1))
    before = shared_names(spark)
    with scratch(spark):
        pass
    assert shared_names(spark) == before
