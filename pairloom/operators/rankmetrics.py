"""AUROC, average precision, best threshold and exact quantiles without one-task groups.

Every function first reduces rows to distinct scores with counts (combined before the shuffle) and then works
on distributed running sums over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.metrics import ratio
from pairloom.operators.ordering import running_sums
from pairloom.operators.resampling import bootstrap_interval as bootstrap_interval  # the interval of a mean, beside the metrics it goes with
from pairloom.session import pinned


def score_steps(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score: positives and negatives at it (``p``, ``m``), at or below it (``cp``, ``cm``) and in all (``tp``, ``tm``), and the
    next lower score (``previous``)."""
    y = F.col(label) == 1
    distinct = pinned(df.groupBy(*keys, score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("m")))
    if not keys:
        raise ValueError("keys must not be empty; use a constant column for one group")
    summed = running_sums(distinct, keys, [score], {"cp": F.col("p"), "cm": F.col("m")}, previous="previous")
    totals = distinct.groupBy(*keys).agg(F.sum("p").alias("tp"), F.sum("m").alias("tm"))
    return summed.join(totals, list(keys))


def auroc(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when one class is missing."""
    below = F.col("cm") - F.col("m")
    won = F.sum(F.col("p") * (below + F.col("m") / 2.0))
    p, m = F.first("tp"), F.first("tm")
    return steps.groupBy(*keys).agg(F.when((p > 0) & (m > 0), won / (p.cast("double") * m)).alias("auroc"))


def _harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, exact up to 20 and by the asymptotic series above."""
    table = [sum(1.0 / i for i in range(1, k + 1)) for k in range(21)]
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * F.pow(x, 2)) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return F.when(n <= 20, F.get(F.array(*map(F.lit, table)), n.cast("int"))).otherwise(series)


def average_precision(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean precision at the positives, best score first and positives first among equals.

    A run of p positives after h hits and r rows adds ``p - (r - h) * (H(r + p) - H(r))``, so a score shared by
    very many rows is one term.
    """
    above_p, above_m = F.col("tp") - F.col("cp"), F.col("tm") - F.col("cm")
    r = above_p + above_m
    term = F.col("p") - F.when(above_m > 0, above_m * (_harmonic(r + F.col("p")) - _harmonic(r))).otherwise(0.0)
    p = F.first("tp")
    return steps.groupBy(*keys).agg(F.when(p > 0, F.sum(term) / p).alias("average_precision"))


def best_threshold(steps: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Threshold with the highest balanced accuracy among the cuts between distinct scores, lowest on ties."""
    s = F.col(score)
    below_p, below_m = F.col("cp") - F.col("p"), F.col("cm") - F.col("m")

    def gain(lost_p: Column, lost_m: Column) -> Column:
        return (ratio(F.col("tp") - lost_p, F.col("tp")) + ratio(lost_m, F.col("tm"))) / 2.0

    middle = F.when(F.col("previous").isNull(), s - 1e-6).otherwise((F.col("previous") + s) / 2.0)
    best = gain(below_p, below_m)
    cuts = steps.groupBy(*keys).agg(
        F.max_by(F.struct(middle.alias("at"), best.alias("gain")), F.struct(best, -s)).alias("cut"), F.max(s).alias("top"),
        # Cutting above every score: no positive found, every negative right.
        F.first(gain(F.col("tp"), F.col("tm"))).alias("none"),
    )
    high = F.col("none") > F.col("cut.gain")
    return cuts.select(*keys, F.when(high, F.col("top") + 1e-6).otherwise(F.col("cut.at")).alias("threshold"), F.greatest("none", "cut.gain").alias("balanced_accuracy"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Interpolated quantiles per group, exact: columns ``q50`` for 0.5 and so on."""
    distinct = pinned(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")))
    summed = running_sums(distinct, keys, [value], {"c": F.col("n")})
    totals = distinct.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = summed.join(totals, list(keys))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("c") >= rank, F.col(value)))

    out = []
    for q in at:
        place = (F.col("total") - 1) * F.lit(float(q))
        low, high = at_rank(F.floor(place) + 1), at_rank(F.ceil(place) + 1)
        part = F.first(place - F.floor(place))
        out.append((low + (high - low) * part).alias(f"q{round(q * 100)}"))
    return joined.groupBy(*keys).agg(*out)


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, extremes, median, 90th percentile and population deviation."""
    v = F.col(value).cast("double")
    plain = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    return plain.join(exact_quantiles(df.withColumn("_q", v), keys, "_q", [0.5, 0.9]), list(keys), "left")
