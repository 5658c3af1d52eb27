"""Bloom filters: nothing lost, few let through, at any number of passes and of tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.scratch import cut


@pytest.mark.parametrize("pass_bits", [bloom.PASS_BITS, 1 << 18, 1 << 16])
def test_repeats_are_all_marked_and_few_others(spark, pass_bits):
    """The budget of one pass reduced: the filter is as large as before, probed in up to 32 passes."""
    rows = 100_000
    ids = spark.range(0, rows, 1, 7).withColumn("h", F.when(F.col("id") % 50 == 0, F.xxhash64(F.col("id") % 1000)).when(F.col("id") % 97 == 1, None).otherwise(F.xxhash64("id")))
    table = cut(ids.sortWithinPartitions("h"), "hashes")
    marked = bloom.marked_repeats(table, "h", rows, pass_bits=pass_bits)
    assert bloom.Shape(bloom.bits_for(rows), pass_bits).passes == max(1, (1 << 21) // pass_bits)
    got = {r.id: r.maybe for r in marked.collect()}
    held = {r.id: r.h for r in table.collect()}
    values, n = np.unique([h for h in held.values() if h is not None], return_counts=True)
    again = set(values[n > 1].tolist())
    assert len(got) == rows
    assert all(got[k] for k, h in held.items() if h in again)
    assert not any(got[k] for k, h in held.items() if h is None)
    singles = [k for k, h in held.items() if h is not None and h not in again]
    assert sum(got[k] for k in singles) < 0.01 * len(singles)


def test_places_do_not_depend_on_how_they_are_sent(spark):
    """A dense task sends bitmaps, a sparse one its values: the filter answers alike."""
    for partitions in (1, 40):
        ids = spark.range(0, 30_000, 1, partitions)
        test = bloom.members(ids.select(F.xxhash64("id").alias("h")), 1 << 16)
        assert ids.where(test(F.xxhash64("id"))).count() == 30_000
    test = bloom.members(ids.select(F.xxhash64("id").alias("h")), bloom.bits_for(30_000))
    assert spark.range(10**6, 10**6 + 30_000).where(test(F.xxhash64("id"))).count() < 300


def test_semi_and_anti_joins(spark, monkeypatch):
    rows = spark.range(0, 1000).withColumn("id", F.when(F.col("id") > 4, F.col("id")))
    ids = spark.range(0, 1000, 3).withColumnRenamed("id", "x")
    for listed, most in ((bloom.LISTED, bloom.PASS_BITS), (-1, bloom.PASS_BITS), (-1, 1)):
        monkeypatch.setattr(bloom, "LISTED", listed)
        monkeypatch.setattr(bloom, "PASS_BITS", most)
        left = {r.id for r in bloom.without(rows, ids).collect()}
        assert left == {None, *(k for k in range(5, 1000) if k % 3)}
        assert {r.id for r in bloom.meeting(rows, ids).collect()} >= {k for k in range(5, 1000) if k % 3 == 0}
    assert bloom.without(rows, ids.where("false")).count() == 1000 and bloom.meeting(rows, ids.where("false")).count() == 0
