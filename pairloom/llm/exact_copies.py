"""Exact duplicates by skew-safe combining: locally, then salted, then globally, each time by the full content.

Equal texts meet in three steps. The partial aggregate of the first grouping drops copies inside a task before anything is sent.
What is left of a digest is dealt to ``SALTS`` parts, so that a text that fills a third of the table sends a row a task to each
part at most, not to one task. The winners of the parts, ``SALTS`` rows a text at most, meet by digest alone. The full text is a grouping key in
every step: two texts that share a digest stay two classes.

Membership goes back to the rows by digest (and by the text where a digest has several). Classes with more than a
``1 / LARGE`` share of the rows, at most ``LARGE`` by arithmetic, are looked up by broadcast; the others by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import pinned

#: Parts of a digest in the second step.
SALTS = 16
#: Classes above this share (1 / LARGE) of all rows are looked up by broadcast. There are at most LARGE of them.
LARGE = 4096


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(rows: DataFrame) -> DataFrame:
    """(doc_id, text, digest) -> (digest, text, keep_id, group_size), one row a different text."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    sums = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    met = sums.repartition("digest").groupBy("digest", "text")
    return met.agg(F.max("doc_id").alias("keep_id"), F.sum("n").cast("long").alias("group_size"))


def _texts(docs: DataFrame, normalise: Callable[[Column], Column] | None, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def classes(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, digest), one row a document, dropped ones too.

    Of equal texts (after ``normalise``, if given) the row with the largest doc_id stays; a null id is less than any other, and of
    rows that repeat both id and text one stays. A null text counts as empty. Other columns are not read, whatever their names; an
    empty table gives an empty one.
    """
    rows = _texts(docs, normalise, digest)
    ids = pinned(rows.select("doc_id", "digest").withColumn("row", F.monotonically_increasing_id()))
    return _members(rows, ids).drop("row")


def _members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, digest, row: a different number in each row) with the class and fate of every row."""
    best = winners(rows).withColumn("texts", F.count("*").over(Window.partitionBy("digest")))
    # Only texts whose digest is not theirs alone are written; of the others the digest says it all.
    best = pinned(best.withColumn("text", F.when(F.col("texts") > 1, F.col("text"))))
    shared = best.filter("texts > 1").drop("texts")
    own = best.filter("texts = 1").select("digest", "keep_id", "group_size")
    found = _looked_up(ids, own).withColumn("variant", F.lit(None).cast("string"))
    if not shared.isEmpty():
        clashing = rows.join(shared.select("digest").distinct(), "digest", "left_semi")
        if "row" not in rows.columns:
            clashing = pinned(clashing.withColumn("row", -1 - F.monotonically_increasing_id()))
        by_text = clashing.join(shared, ["digest", "text"])
        found = found.unionByName(by_text.select("doc_id", "digest", "row", "keep_id", "group_size", F.col("text").alias("variant")))
    found = pinned(found)
    staying = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "variant").agg(F.min("row").alias("row"))
    out = found.join(staying.select("row", F.lit(True).alias("stays")), "row", "left")
    return out.select("row", "doc_id", "keep_id", "group_size", F.coalesce("stays", F.lit(False)).alias("kept"), "digest")


def _looked_up(ids: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of ``ids`` with the class of their digest; rows without one are left out."""
    total = own.agg(F.sum("group_size")).first()[0] or 0
    is_large = F.col("group_size") * LARGE > total
    large = own.filter(is_large)
    tried = ids.join(F.broadcast(large), "digest", "left")
    rest = tried.filter("group_size IS NULL").select(*ids.columns).join(own.filter(~is_large), "digest")
    return tried.filter("group_size IS NOT NULL").unionByName(rest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    numbered = pinned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.monotonically_increasing_id().alias("row")))
    rows = numbered.select(F.col("all.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("all.text"), F.lit("")).alias("text"), "row").withColumn("digest", sha256(F.col("text")))
    staying = _members(rows, rows.drop("text")).filter("kept").select("row")
    return numbered.join(staying, "row", "left_semi").select("all.*")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS copy FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
