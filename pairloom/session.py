"""Session helpers: shared scratch space and reliable lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, whose executors live in the driver's process, may
    leave it unset: then a fresh temporary folder is chosen, once per application, and deleted when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder on {master}")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="pairloom-")
            atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
        base = _LOCAL_DIRS[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where several branches read one expensive intermediate result: the written table survives
    the loss of executors and is scanned with column pruning, unlike a cached or re-run lineage.
    """
    path = fresh_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
