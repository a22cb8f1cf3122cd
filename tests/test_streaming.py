"""Late rows by keyed state, and the keyed table that live counters are kept in."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from pairloom.session import fresh_path
from pairloom.streaming import incremental


def test_rows_after_the_first_batch_of_their_image_are_late_and_kept_whole(spark):
    base = fresh_path(spark, "t")
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [("i1", 2**60 + 1, 0.1, at, ["a"]), ("i2", None, None, None, None), (None, 3, 1e-300, at, []), ("i1", 4, 2.0, at, ["b", None])]
    schema = "image_id string, v long, x double, at timestamp, tags array<string>"
    df = spark.createDataFrame(rows, schema)
    run = lambda: incremental.incremental_facts(incremental.file_stream(spark, f"{base}/in", df.schema), lambda b: b, f"{base}/out", f"{base}/late", f"{base}/state")
    df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    spark.createDataFrame([("i1", 7, 1.0, at, []), ("i3", 8, 1.0, None, None), (None, 9, 0.0, at, None)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    run()
    out = [tuple(r)[:5] for r in spark.read.parquet(f"{base}/out").collect()]
    assert sorted(out, key=str) == sorted([*rows, ("i3", 8, 1.0, None, None)], key=str)
    assert sorted((tuple(r)[:5] for r in spark.read.parquet(f"{base}/late").collect()), key=str) == sorted([("i1", 7, 1.0, at, []), (None, 9, 0.0, at, None)], key=str)


@pytest.mark.parametrize("compact", [1, 3, 100])
def test_keyed_table_holds_the_newest_row_of_every_key(spark, compact):
    path = fresh_path(spark, "keyed")
    table = incremental.KeyedTable(spark, path, ["k"], compact)
    want = {}
    for n in range(8):
        batch = [(k, n * 10 + k) for k in range(4) if (n + k) % 3 != 1] + [(None, n)]
        table.put(spark.createDataFrame(batch, "k int, v long"), n)
        if n % 3 == 0:  # a batch that is run again
            table.put(spark.createDataFrame(batch, "k int, v long"), n)
        want.update(batch)
        assert {r["k"]: r["v"] for r in table.rows().collect()} == want
        folder = path.removeprefix("file:")
        held = len(os.listdir(f"{folder}/changes")) + len(os.listdir(f"{folder}/base") if os.path.isdir(f"{folder}/base") else [])
        assert held <= 2 * compact + 2


def test_an_unfinished_base_is_not_read(spark):
    path = fresh_path(spark, "keyed")
    table = incremental.KeyedTable(spark, path, ["k"], 2)
    for n in range(3):
        table.put(spark.range(2).select(F.col("id").alias("k"), F.lit(n).alias("v")), n)
    os.makedirs(f"{path.removeprefix('file:')}/base/99")
    assert {tuple(r) for r in table.rows().collect()} == {(0, 2), (1, 2)}


def test_no_python_call_for_a_key_of_the_stream(spark):
    """Keys are looked up in Spark's own state: the plan holds no grouped Python step, whose calls grow with the images."""
    path = fresh_path(spark, "t")
    spark.range(5).select(F.col("id").cast("string").alias("image_id")).write.parquet(path)
    stream = incremental.arrivals(incremental.file_stream(spark, path, spark.read.parquet(path).schema), "image_id")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "InPandas" not in plan
