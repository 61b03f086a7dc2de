"""Tree digests: what differs is found, and little else is read."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.treedigest import RANGE, changes, differing, read_ranges, root, verified, write_tree
from ledgerlake.sources.checkpoints import CheckpointError
from ledgerlake.sources.sinks import shared_path


def test_one_change_is_found_by_reading_under_a_hundredth(spark):
    old = spark.range(20_000).select("id", (F.col("id") * 3).alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 12_345, -1).otherwise(F.col("v")))
    a, b = shared_path(spark, "a"), shared_path(spark, "b")
    assert write_tree(old, ["id"], a, 256) != write_tree(new, ["id"], b, 256)
    only = differing(spark, a, b, 256)
    assert len(only) == 1
    read = read_ranges(spark, a, old.schema, only)
    assert "PartitionFilters" in read._jdf.queryExecution().toString() and 0 < read.count() < 200
    at = list(Path(a.removeprefix("file:")).glob("rows/**/*.parquet"))
    assert sum(f.stat().st_size for f in at if f.parent.name == f"{RANGE}={only[0]}") < sum(f.stat().st_size for f in at) / 100
    assert list(map(tuple, changes(spark, a, b, ["id"], old.schema, 256).collect())) == [(12_345, "changed")]


def test_kinds_repeats_and_nulls(spark):
    schema = "k string, v int"
    old = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("gone", 4), ("same", None)], schema)
    new = spark.createDataFrame([("same", None), ("a", 1), ("b", 2), (None, 4), ("came", 4)], schema)
    a, b, c = (shared_path(spark, n) for n in "abc")
    write_tree(old, ["k"], a, 16)
    write_tree(new, ["k"], b, 16)
    assert set(map(tuple, changes(spark, a, b, ["k"], old.schema, 16).collect())) == {("a", "changed"), (None, "changed"), ("gone", "only_a"), ("came", "only_b")}
    assert write_tree(old.orderBy("v"), ["k"], c, 16) == root(spark, a)
    assert differing(spark, a, c, 16) == [] and changes(spark, a, c, ["k"], old.schema, 16).count() == 0


def test_refusals_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    a, b = shared_path(spark, "a"), shared_path(spark, "b")
    write_tree(df, ["k"], a, 16)
    assert verified(spark, a, df.schema).count() == 2
    assert write_tree(df.limit(0), ["k"], b, 16) == ""
    assert set(map(tuple, changes(spark, a, b, ["k"], df.schema, 16).collect())) == {(1, "only_a"), (2, "only_a")}
    with pytest.raises(CheckpointError):
        write_tree(df, ["k"], a, 16)
    df.withColumn(RANGE, F.lit(3)).write.mode("append").partitionBy(RANGE).parquet(f"{a}/rows")
    with pytest.raises(CheckpointError, match="ranges"):
        verified(spark, a, df.schema)
    for ranges in (15, 17, 65536):
        with pytest.raises(ValueError):
            write_tree(df, ["k"], shared_path(spark, "c"), ranges)
    with pytest.raises(ValueError):
        write_tree(df.withColumnRenamed("v", RANGE), ["k"], shared_path(spark, "d"), 16)
