"""Writers, fingerprints and resumable appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.ordering import global_rank
from pairloom.session import pinned


def write_table(df: DataFrame, path: str, fmt: str = "json", partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """JSON lines, CSV (with header) or Parquet; refuses to touch existing output unless told to."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def row_signature(columns: Sequence[str]):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest) that does not depend on the order of rows."""
    h = F.xxhash64(F.to_json(F.struct(*columns)))
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def ordered_hash(df: DataFrame, columns: Sequence[str], order: Sequence[str], chunk: int = 10_000) -> DataFrame:
    """(rows, digest) of rows in order, as a tree of hashes.

    Signatures are hashed chunk by chunk, then chunks of chunk hashes, until one is left, so no task ever holds more
    than ``chunk`` of them. It differs from the hash of a file with the same rows.
    """
    base = pinned(df.select(*order, row_signature(columns).alias("_sig")))
    rows = base.count()
    level = global_rank(base, [], list(order), "_r").select((F.col("_r") - 1).alias("_i"), "_sig")
    size = rows
    while True:
        grouped = level.groupBy(F.floor(F.col("_i") / chunk).alias("_i"))
        items = F.array_sort(F.collect_list(F.struct((F.col("_i") % chunk).alias("p"), "_sig")))
        level = grouped.agg(F.sha2(F.array_join(F.transform(items, lambda x: x["_sig"]), "\n"), 256).alias("_sig"))
        size = -(-size // chunk)
        if size <= 1:
            return level.select(F.lit(rows).cast("long").alias("rows"), F.col("_sig").alias("digest"))
        level = pinned(level)


def first_rows_hash(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """Hash of the first n row signatures."""
    head = df.select(*order, row_signature(columns).alias("_sig")).orderBy(*order).limit(n)
    items = F.array_sort(F.collect_list(F.struct(*order, "_sig")))
    return head.agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(items, lambda x: x["_sig"]), "\n"), 256).alias("digest"))


def manifest(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Rows, distinct groups and order-free digest of a data set: the sum of 60 bits of each row's signature."""
    h = F.conv(F.substring(row_signature(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.countDistinct(group).alias("groups"), F.sum(h).cast("string").alias("digest")).withColumn("columns", F.lit(",".join(columns)))


def missing_rows(new: DataFrame, spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows whose key is not in the output yet; everything when there is no output."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return new
    return new.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def resume_append(new: DataFrame, path: str, key: str) -> None:
    """Append only what the output lacks. Running it twice changes nothing."""
    missing_rows(new, new.sparkSession, path, key).write.mode("append").parquet(path)
