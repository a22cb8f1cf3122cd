"""Ranks, running sums and samples that hold up when one group owns most of the rows.

A plain ``row_number().over(partitionBy(key))`` sends a whole group to one task. The operators here
keep the exact same results while no task has to take more than a share of the rows:

* ``first_per_group`` keeps one row per group and input partition before the shuffle.
* ``top_k`` lets every salt keep its own first ``k`` rows before the group is put together.
* ``running_sums`` / ``global_rank`` cut the total order (keys, order) into ranges; only the few
  groups that cross a range border need an offset, and their number is bounded by the ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import pinned

# Spark filters rows of a rank window before the shuffle up to this limit
# (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
GROUP_LIMIT = 1000


def seeded_key(seed: int | str, *cols: Column | str) -> Column:
    """Stable pseudo-random sort key of a row: the same under any partitioning and retry."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]))


def seeded_unit(seed: int | str, *cols: Column | str) -> Column:
    """Stable number in [0, 1) from the first 8 hex digits of :func:`seeded_key`."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every group by ascending ``order`` (use ``-col`` for descending numbers).

    A rank limit of one: every input partition sends at most one row per group, and columns nobody reads are pruned.
    """
    return top_k(df, keys, order, 1, "_first").drop("_first")


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """Rows with rank 1..k in their group, exactly.

    Up to :data:`GROUP_LIMIT` Spark itself keeps k rows per input partition before the shuffle. Above
    it each of ``salts`` parts of a group is cut to k rows first, so the last window sees at most
    ``k * salts`` rows of a group.
    """
    cols = _cols(order)
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*cols)
        df = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)).cast("long")).filter(F.col(rank) <= k)


#: Rows of a range: what one task sorts. The number of ranges follows from it, so a task's share does not grow with the data.
RANGE_ROWS = 2_000_000
#: Up to so many ranges their ends and offsets are broadcast.
FEW_RANGES = 20_000


#: Rows of a share when rows meet by a key: several sorts and aggregates of one task hold them at a time.
SHARE_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by its keys to one share for every SHARE_ROWS; as it is while shuffles have that many partitions anyway.

    Joins, aggregates and windows by these keys stay in the shares, so what a task holds does not grow with the data.
    """
    shares = -(-rows // SHARE_ROWS)
    return df.repartition(shares, *keys) if shares > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def range_count(rows: int, least: int) -> int:
    """Ranges for so many rows: one for each RANGE_ROWS, ``least`` at least."""
    return max(least, -(-rows // RANGE_ROWS))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    parts: int | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Add for each ``name: value`` the sum of value over the rows of the group up to and with this row, and with ``previous`` a column
    of that name: the value of ``order[0]`` in the row before, null in a group's first row.

    ``(keys, order)`` must be a total order of ``df`` (columns, ascending, not null). The rows are dealt to ranges of the
    total order once and written; sums run inside the ranges, and groups that continue in a later range get what the
    earlier ranges hold.
    """
    n = parts or range_count(df.count(), max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    values = {f"_v_{name}": value for name, value in sums.items()}
    # Ends and offsets have a few rows a range: broadcast while there are few ranges, left to Spark beyond.
    small = F.broadcast if n <= FEW_RANGES else (lambda side: side)
    ranged = pinned(df.withColumns(values).repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    crossed = ranged
    if keys:
        # The groups at the two ends of a range, two rows a range, are the only ones that can cross a border.
        ends = ranged.groupBy("_range").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
        crossing = ends.select(F.explode(F.array("low", "high")).alias("k")).select("k.*").distinct()
        crossed = ranged.join(small(crossing), list(keys), "left_semi")
    per_range = crossed.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{s}").alias(f"_o_{s}") for s in sums], F.max(order[0]).alias("_o_last"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        *[F.sum(f"_o_{s}").over(before).alias(f"_p_{s}") for s in sums],
        F.max("_o_last").over(before).alias("_p_last"),
    )
    on = F.col("_range") == F.col("_k_range")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({name: F.sum(f"_v_{name}").over(within) for name in sums})
    if previous is not None:
        local = local.withColumn(previous, F.lag(order[0]).over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    # At most three rows a range: the two groups at its ends, and one more for each group that spans it.
    joined = local.join(small(offsets), on, "left")
    out = joined.withColumns({s: F.col(s) + F.coalesce(F.col(f"_p_{s}"), F.lit(0)) for s in sums})
    if previous is not None:
        out = out.withColumn(previous, F.coalesce(previous, "_p_last"))
    return out.select(*df.columns, *sums, *([previous] if previous is not None else []))


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank", parts: int | None = None) -> DataFrame:
    """Exact 1-based rank in the group by ascending ``order`` without a one-task group."""
    return running_sums(df, keys, order, {rank: F.lit(1).cast("long")}, parts)


def seeded_sample(df: DataFrame, seed: int, n: int, *cols: str) -> DataFrame:
    """Exactly ``n`` rows (all if fewer) by hashed order of the key columns."""
    return df.withColumn("_s", seeded_key(seed, *cols)).orderBy("_s", *cols).limit(n).drop("_s")


def seeded_flip(seed: int, *cols: str) -> Column:
    """Stable even/odd coin per key."""
    return F.pmod(F.conv(F.substring(seeded_key(seed, *cols), 1, 4), 16, 10).cast("long"), F.lit(2)) == 1
