"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions drawn by a seed.

DataFrame and SQL functions only. Documents are read once; what follows works on (doc_id, source, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import word_count
from pairloom.operators.ordering import seeded_key
from pairloom.session import pinned

MAX_EPOCHS = 3
_WIDE = "decimal(38,0)"
#: Two passes over so many hash cells (three hexadecimal digits each) cut a source into 2 ** 24 slices; a slice holds a document or two.
CELLS = 4096


def weighted(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight 1, 2, 3, repeating by code point, null last. One row a source passes one task."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))


def water_fill(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> with target (double): shares of ``budget`` by weight, none above ``max_epochs`` x source_size.

    Each round clamps every source whose share exceeds its cap and shares what is left among the others by weight, until none
    exceeds. If all are clamped, targets stay at the caps. A source of size 0 is clamped to 0.
    """
    cap = F.col("source_size") * max_epochs
    state = pinned(sources.withColumn("clamped", F.lit(False)))
    while True:
        left = state.agg(
            F.coalesce(F.sum(F.when(F.col("clamped"), cap)), F.lit(0)).alias("used"), F.sum(F.when(~F.col("clamped"), F.col("weight"))).alias("weights")
        ).first()
        if not left["weights"]:
            break
        free, weights = int(budget) - int(left["used"]), int(left["weights"])
        over = ~F.col("clamped") & (F.col("weight").cast(_WIDE) * F.lit(free).cast(_WIDE) > cap.cast(_WIDE) * F.lit(weights).cast(_WIDE))
        if not state.filter(over).limit(1).count():
            share = (F.col("weight") * F.lit(free)).cast("double") / F.lit(float(weights))
            return state.withColumn("target", F.when(F.col("clamped"), cap.cast("double")).otherwise(share)).drop("clamped")
        state = pinned(state.withColumn("clamped", F.col("clamped") | over))
    return state.withColumn("target", cap.cast("double")).drop("clamped")


def _crossing(cells: DataFrame, cell: str) -> DataFrame:
    """(source, cell, words, want) -> (source, at, words, want): the cell in which the running words reach ``want``, and what it
    still has to give. At most CELLS rows a source."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(cell))
    crossing = cells.withColumn("upto", upto).filter((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("words") <= F.col("want")))
    return crossing.select("source", F.col(cell).alias("at"), "words", (F.col("want") - F.col("upto") + F.col("words")).alias("want"))


def _cells(seed: int, size: str) -> dict[str, Column]:
    h = seeded_key(seed, "doc_id", size)
    return {f"_c{i}": F.conv(F.substring(h, 3 * i - 2, 3), 16, 10).cast("int") for i in (1, 2)}


def stops(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, size) and (source, source_size, target) -> one row a source: _s, source_size, target, _whole, _stop1, _stop2.

    Every document is taken _whole = floor(target / source_size) times; for the fraction, documents of a source are taken once
    more in the order of a seeded hash until the words come nearest to the target. Where the hash stops is found by two
    histograms over hash cells, not by sorting the source; only the documents of one last cell (of 2 ** 24) stand or go together.
    """
    dealt = sized.withColumns(_cells(seed, "size"))
    goals = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = pinned(goals.select(F.col("source").alias("_s"), "source_size", "target", "_whole", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("want")))
    first = dealt.groupBy("source", "_c1").agg(F.sum("size").alias("words")).join(goals.select("_s", "want"), F.col("source").eqNullSafe(F.col("_s")))
    first = pinned(_crossing(first, "_c1").select(F.col("source").alias("_s1"), F.col("at").alias("_stop1"), "want"))
    second = dealt.join(first, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("_c1") == F.col("_stop1")))
    second = _crossing(second.groupBy("source", "_c2", "want").agg(F.sum("size").alias("words")), "_c2")
    second = second.select(F.col("source").alias("_s2"), (F.col("at") + F.when(F.col("want") * 2 >= F.col("words"), 1).otherwise(0)).alias("_stop2"))
    out = goals.join(first.drop("want"), F.col("_s").eqNullSafe(F.col("_s1")), "left").join(second, F.col("_s").eqNullSafe(F.col("_s2")), "left")
    return pinned(out.select("_s", "source_size", "target", "_whole", "_stop1", "_stop2"))


def _with_copies(rows: DataFrame, size: str, stop: DataFrame, seed: int) -> DataFrame:
    extra = (F.col("_c1") < F.col("_stop1")) | ((F.col("_c1") == F.col("_stop1")) & (F.col("_c2") < F.col("_stop2")))
    joined = rows.withColumns(_cells(seed, size)).join(stop, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def targets_of(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): all words of the table shared by the weights of :func:`weighted`."""
    sources = pinned(weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    return water_fill(sources, sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], max_epochs)


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, taken): what the mix takes of every document.

    Null or wordless texts have size 0 and take nothing; a null source is a source of its own, the last. An empty table gives an
    empty one. Rows that repeat an id and size go together. Reruns agree, as nothing but ids, sizes and the seed decides.
    """
    sized = pinned(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    out = _with_copies(sized, "size", stops(sized, targets_of(sized), seed), seed)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and others), each as often as the mix takes it: 0 to 3 times."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    counts = pinned(sized.select("doc_id", "source", F.col("_size").alias("size")))
    taken = _with_copies(sized, "_size", stops(counts, targets_of(counts), seed), seed).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(docs.columns)


#: The same in SQL: sources in the order of cap over weight are clamped until one holds its share.
SQL = r"""
WITH d AS (
  SELECT *, CAST('0x' || substr(h, 1, 3) AS INT) AS c1, CAST('0x' || substr(h, 4, 3) AS INT) AS c2
  FROM (SELECT *, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size) AS h
        FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents))),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
f AS (
  SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS caps_before, sum(weight) OVER w - weight AS weights_before, sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT *, bool_and(weight * (budget - caps_before) > 3 * source_size * (weights - weights_before))
    OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) AS clamped FROM f),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * (budget - coalesce(sum(3 * source_size) FILTER (WHERE clamped) OVER (), 0)) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT clamped) OVER () AS DOUBLE) END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x1 AS (
  SELECT source, c1 AS stop1, want - upto + words AS want
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY c1) AS upto
        FROM (SELECT d.source, c1, any_value(target - whole * source_size) AS want, sum(size) AS words FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, c1))
  WHERE upto > want AND upto - words <= want),
x2 AS (
  SELECT source, c2 + CASE WHEN (want - upto + words) * 2 >= words THEN 1 ELSE 0 END AS stop2
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY c2) AS upto
        FROM (SELECT d.source, c2, want, sum(size) AS words FROM d JOIN x1 ON d.source IS NOT DISTINCT FROM x1.source AND c1 = stop1 GROUP BY ALL))
  WHERE upto > want AND upto - words <= want)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN coalesce(c1 < stop1 OR c1 = stop1 AND c2 < stop2, false) THEN 1 ELSE 0 END) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN x1 ON d.source IS NOT DISTINCT FROM x1.source LEFT JOIN x2 ON d.source IS NOT DISTINCT FROM x2.source
"""
