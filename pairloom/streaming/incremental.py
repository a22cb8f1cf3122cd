"""Incremental jobs on file streams: facts of images not seen before, and live evaluation counters.

Both run with ``availableNow``: they take what has arrived, keep their place in a checkpoint and stop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources.sinks import missing_rows

#: Batches of changes that a keyed table holds before they are merged into its base.
COMPACT = 10
CONFUSION = ("n", "tp", "tn", "fp", "fn", "invalid")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def arrivals(stream: DataFrame, key: str) -> DataFrame:
    """The rows of a stream and, with ``_first`` true and nothing but the key, one mark for each key that no earlier micro-batch has had.

    The keys seen are Spark's own deduplication state: a batch looks up and adds its own keys, so its work does not depend on how many
    there were before, and no key is a call of its own.
    """
    marks = stream.select(key).dropDuplicates([key]).withColumn("_first", F.lit(True))
    return stream.withColumn("_first", F.lit(False)).unionByName(marks, allowMissingColumns=True)


def incremental_facts(stream: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, late: str, checkpoint: str, key: str = "image_id") -> None:
    """Build facts of new images only: ``out/epoch=N`` holds the facts of the images that batch N was the first to bring.

    Rows of an image that arrive after its first batch cannot change facts already given out. They are not lost: ``late/epoch=N`` holds
    them. A batch that is run again after a failure sees the same state and overwrites its own folders.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            marks = batch.filter("_first").select(F.col(key).alias("_key"))
            rows = batch.filter("NOT _first").drop("_first")
            known = F.col(key).eqNullSafe(F.col("_key"))
            build(rows.join(marks, known, "left_semi")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
            rows.join(marks, known, "left_anti").write.mode("overwrite").parquet(f"{late}/epoch={epoch}")
        finally:
            batch.unpersist()

    query = arrivals(stream, key).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def confusion_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running confusion counts (strict mode); the state is one row per key combination."""
    y, p = F.col("label"), F.coalesce("pred", F.lit("invalid"))
    return stream.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if((y == "yes") & (p == "yes")).alias("tp"), F.count_if((y == "no") & (p == "no")).alias("tn"),
        F.count_if((y == "no") & (p != "no")).alias("fp"), F.count_if((y == "yes") & (p != "yes")).alias("fn"), F.count_if(~p.isin("yes", "no")).alias("invalid"),
    )


class KeyedTable:
    """A folder that holds the newest row of every key: a base, and the changes of the batches after it.

    A batch writes the rows it changed as ``changes/N``. Every ``COMPACT`` batches the base and the changes become a new base
    ``base/N``; Spark writes its success mark last, and readers take the newest base that has one and only the changes after it, so the mark is the
    pointer. Changes and bases that no reader needs any more, those before the last base but one, are removed. A reader thus opens one base and a
    bounded number of changes, however many batches there were.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], compact: int = COMPACT):
        self.spark, self.path, self.keys, self.compact = spark, path.rstrip("/"), list(keys), compact

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _done(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        root = self._path(kind)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(root)]
        return sorted(n for n in numbers if fs.exists(self._path(f"{kind}/{n}/_SUCCESS")))

    def put(self, batch: DataFrame, number: int) -> None:
        """The rows that batch ``number`` changed; putting a number again replaces it, or changes nothing once it is in a base."""
        bases = self._done("base")
        if bases and number <= bases[-1]:
            return
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        if number - (bases[-1] if bases else -1) >= self.compact:
            self._newest(bases, self._done("changes")).write.mode("overwrite").parquet(f"{self.path}/base/{number}")
            self._forget(bases)

    def _newest(self, bases: list[int], changes: list[int]) -> DataFrame:
        since = bases[-1] if bases else -1
        paths = [f"{self.path}/base/{since}"] * bool(bases) + [f"{self.path}/changes/{n}" for n in changes if n > since]
        rows = self.spark.read.parquet(*paths)
        others = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_batch").alias("_newest"))
        return newest.select(*self.keys, *[F.col(f"_newest.{c}").alias(c) for c in others])

    def _forget(self, bases: list[int]) -> None:
        """Readers of the base before the new one may still be at work; what it replaced is not needed."""
        if not bases:
            return
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in self._done("changes"):
            if n <= bases[-1]:
                fs.delete(self._path(f"changes/{n}"), True)
        for n in bases[:-1]:
            fs.delete(self._path(f"base/{n}"), True)

    def rows(self) -> DataFrame:
        """The newest row of every key. A table without any batch is an error, as it has no columns."""
        return self._newest(self._done("base"), self._done("changes")).drop("_batch")


def live_counters(stream: DataFrame, keys: list[str], out: str, checkpoint: str, compact: int = COMPACT) -> None:
    """Keep the latest counters in the :class:`KeyedTable` at ``out``: every batch writes the counters it changed."""

    def step(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, out, keys, compact).put(batch, epoch)

    query = confusion_stream(stream, keys).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_counters(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest counters with ratios computed at read time."""
    return KeyedTable(spark, out, keys).rows().select(*keys, *CONFUSION, ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"))


__all__ = ["COMPACT", "CONFUSION", "KeyedTable", "arrivals", "confusion_stream", "file_stream", "incremental_facts", "latest_counters", "live_counters", "missing_rows"]
