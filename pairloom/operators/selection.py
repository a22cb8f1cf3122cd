"""Choosing runs: weighted averages, best-of, matches, sweep trends and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators import resampling


def weighted_average(df: DataFrame, keys: Sequence[str], weight: str, values: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Sample-weighted averages of ``values`` and plain sums of ``sums``."""
    w = F.sum(weight)
    means = [F.when(w != 0, F.sum(F.col(v) * F.col(weight)) / w).otherwise(0.0).alias(v) for v in values]
    return df.groupBy(*keys).agg(*means, *[F.sum(s).alias(s) for s in sums], w.alias(weight))


def best_of(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The best row of every group: ``by`` in descending order. Nulls lose. Combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def match_label(vector: Column, subset: Column) -> Column:
    """How a vector relates to the subset it was tried on."""
    out = F.when(vector.startswith("g_all"), "global")
    for kind in ("cat", "attr", "rel"):
        out = out.when(vector.startswith(f"g_{kind}") & subset.startswith(f"{kind}_"), "type_matched")
    out = out.when(vector.contains(F.concat(F.lit("d_"), subset, F.lit("_"))), "subtype_matched")
    for kind in ("cat", "attr", "rel"):
        out = out.when(subset.startswith(f"{kind}_") & vector.contains(f"_{kind}_"), "type_matched")
    return out.otherwise("mismatched")


def mask_match(mask: Column, subset: Column, kind: Column, given: Column) -> Column:
    """Match of a mask key, unless the row already says it."""
    own = F.concat(F.lit("mask_s_"), subset, F.lit("_energy_top64"))
    return (
        F.when(F.coalesce(given, F.lit("")) != "", given)
        .when(mask.startswith("random_mask") | mask.startswith("layer_matched_random"), "random_mask")
        .when(mask == "mask_g_all_norm_top64", "g_all_baseline")
        .when((kind != "") & (mask == F.concat(F.lit("mask_g_"), kind, F.lit("_norm_top64"))), "g_type_baseline")
        .when(mask == own, "matched_energy")
        .when(mask.startswith("mask_s_") & mask.endswith("_energy_top64"), "mismatched_energy")
        .otherwise("other")
    )


def suspicious_yes_rate(rate: Column) -> Column:
    return (rate > 0.65) | (rate < 0.35)


def score_matrix(best: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    """One line per ``row`` and one column per value of ``column`` (given, so the pivot needs no extra pass)."""
    return best.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def f1_matrix(rows: DataFrame, baseline: DataFrame, vector: str, subset: str) -> DataFrame:
    """(vector, subset, f1, f1_delta, suspicious): the weighted F1 of every vector on every subset, its change against ``baseline(subset, f1)``,
    and whether its yes rate is out of range. ``rows`` have n, f1 and yes_rate; subsets without a baseline are left out."""
    best = weighted_average(rows, [vector, subset], "n", ["f1", "yes_rate"])
    joined = best.join(baseline.select(subset, F.col("f1").alias("_base")), subset)
    return joined.select(vector, subset, "f1", (F.col("f1") - F.col("_base")).alias("f1_delta"), suspicious_yes_rate(F.col("yes_rate")).alias("suspicious"))


def sweep_trend(df: DataFrame, keys: Sequence[str], order: str, value: str, eps: float = 1e-9) -> DataFrame:
    """Is ``value`` monotone along the sweep? One row per sweep point goes in, a label per group comes out."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    shown = df.filter(F.col(order).isNotNull() & F.col(value).isNotNull()).select(*keys, step.alias("_step"))
    up, down = F.bool_or(F.col("_step") > eps), F.bool_or(F.col("_step") < -eps)
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return shown.groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.when(F.count("*") < 2, "insufficient").when(up & down, "mixed").when(down, "decreasing").when(up, "increasing").otherwise("flat").alias("trend"),
    )


def sweep_tags(df: DataFrame, keys: Sequence[str], alpha: str = "alpha") -> DataFrame:
    """Diagnostic tags of a vector's sweep.

    Needs per point: yes_rate, delta_f1, delta_acc, delta_fp, delta_fn, wrong_to_right, right_to_wrong, changed, n.
    """
    first, last = F.min_by("yes_rate", alpha), F.max_by("yes_rate", alpha)
    best = F.max_by(F.struct("delta_f1", "delta_fp", "delta_fn"), F.struct(F.col("delta_f1"), -F.col(alpha)))
    agg = df.groupBy(*keys).agg(
        (last - first).alias("shift"), best.alias("best"), F.sum("wrong_to_right").alias("fixed"), F.sum("right_to_wrong").alias("broken"),
        F.avg(F.col("changed") / F.greatest(F.col("n"), F.lit(1))).alias("changed_share"),
        F.count_if((F.col("delta_f1") > 0) | (F.col("delta_acc") > 0)).alias("gains"),
    )
    tags = F.array_compact(F.array(
        F.when((F.col("fixed") > F.col("broken")) & (F.col("changed_share") <= 0.1), "precise correction"),
        F.when((F.col("shift") > 0.05) | (F.col("best.delta_fp") > 3), "yes-shift risk"),
        F.when((F.col("shift") < -0.05) | (F.col("best.delta_fn") > 3), "no-shift risk"),
        F.when((F.col("gains") <= 1) & (F.col("best.delta_f1") > 0), "unstable single-point gain"),
    ))
    return agg.select(*keys, F.round("shift", 6).alias("shift"), "gains", F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise("weak/no stable effect").alias("tags"))


def direction_verdict(cosine: Column, delta_yes: Column, delta_no: Column) -> Column:
    """STRUCT of verdicts on alignment (cosine of present and absent) and on margin movement."""
    align = F.when(cosine > 0.3, "shared direction").when(cosine < -0.3, "opposed polarity").when(cosine.isNotNull(), "weakly aligned")
    move = (
        F.when((delta_yes > 0) & (delta_no < 0), "desired").when((delta_yes > 0) & (delta_no > 0), "yes direction")
        .when((F.abs(delta_yes) < 0.05) & (F.abs(delta_no) < 0.05), "barely moves").otherwise("mixed")
    )
    return F.struct(align.alias("alignment"), move.alias("movement"))


def shift_tags(yes_rate_delta: Column, delta_accuracy: Column, fixed: Column, broken: Column) -> Column:
    tags = F.array_compact(F.array(
        F.when(yes_rate_delta > 0.02, "yes-shift"), F.when(yes_rate_delta < -0.02, "no-shift"),
        F.when((delta_accuracy > 0) & (fixed > broken), "precise-correction"),
    ))
    return F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise("neutral/mixed")


def select_on_validation(scored: DataFrame, keys: Sequence[str], config: Sequence[str], split: str = "split") -> DataFrame:
    """Test rows of the configuration that is best on validation.

    Order: pairwise_acc, mean_margin (both descending), then |alpha|, k and sign ascending.
    """
    val = scored.filter(F.col(split) == "val")
    best = best_of(val, keys, [F.col("pairwise_acc"), F.col("mean_margin"), -F.abs("alpha"), -F.col("k"), -F.col("sign")])
    return scored.filter(F.col(split) == "test").join(best.select(*keys, *config), [*keys, *config], "left_semi")


def gate(rules: DataFrame) -> DataFrame:
    """(status, reasons) of rule rows ``(rule, severity, broken)``; severity 2 fails, 1 warns."""
    worst = F.coalesce(F.max(F.when(F.col("broken"), F.col("severity"))), F.lit(0))
    names = F.array_join(F.sort_array(F.collect_set(F.when(F.col("broken"), F.col("rule")))), ",")
    return rules.agg(F.when(worst >= 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS").alias("status"), names.alias("reasons"))


def coverage_rules(counts: DataFrame, targets: Mapping[str, int], must: Sequence[str], core: Sequence[str]) -> DataFrame:
    """Rule rows from ``counts(subtype, n, yes)``: empty subtypes, coverage, yes share."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(k, int(v), k in must, k in core) for k, v in targets.items()], "subtype string, target int, must boolean, core boolean")
    seen = wanted.join(counts, "subtype", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "yes": F.coalesce("yes", F.lit(0))})
    share, cover = F.col("yes") / F.greatest("n", F.lit(1)), F.col("n") / F.greatest("target", F.lit(1))

    def rule(name: str, severity: int, broken: Column) -> Column:
        return F.struct(F.concat_ws(":", F.lit(name), "subtype").alias("rule"), F.lit(severity).alias("severity"), broken.alias("broken"))

    return seen.select(F.inline(F.array(
        rule("empty", 2, F.col("must") & (F.col("n") == 0)), rule("coverage_below_70", 2, F.col("core") & (cover < 0.70)),
        rule("coverage_below_50", 1, (F.col("n") > 0) & (cover < 0.50)), rule("yes_share", 1, (F.col("n") > 0) & ~share.between(0.45, 0.55)),
    )))


def grid_summaries(
    rows: DataFrame, keys: Sequence[str], base: Column, effects: Column, ks: Sequence[int], alphas: Sequence[float], signs: Sequence[int], digits: int = 9
) -> DataFrame:
    """Every configuration (k, alpha, sign) of a steering grid from one pass over the rows.

    ``base`` is a row's margin without steering and ``effects`` an array with the margin's change for each k at alpha 1. The margins of all
    configurations are one array a row, their counters one array a group in the partial aggregate; rows are not copied. Returns
    (keys, k, alpha, sign, num_pairs, wins, ties, losses, pairwise_acc, mean_margin), and k 0 is the baseline.
    """
    steps = F.array(*[F.lit(float(a * s)) for a in alphas for s in signs])
    steered = F.flatten(F.transform(effects, lambda e: F.transform(steps, lambda step: base + step * e)))
    margins = rows.select(*keys, F.transform(F.concat(F.array(base), steered), lambda m: F.round(m.cast("double"), digits)).alias("_m"))
    one, none = F.lit(1.0), F.lit(0.0)
    sums = margins.groupBy(*keys).agg(
        F.count("*").alias("num_pairs"),
        resampling.array_total(F.transform("_m", lambda m: F.when(m > 0, one).otherwise(none))).alias("_wins"),
        resampling.array_total(F.transform("_m", lambda m: F.when(m == 0, one).otherwise(none))).alias("_ties"),
        resampling.array_sum(F.col("_m")).alias("_sums"),
    )
    configs = [(0, 0.0, 1), *[(k, a, s) for k in ks for a in alphas for s in signs]]
    named = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(float(a)).alias("alpha"), F.lit(int(s)).alias("sign")) for k, a, s in configs])
    each = sums.select(*keys, "num_pairs", F.explode(F.arrays_zip(named.alias("config"), "_wins", "_ties", "_sums")).alias("c"))
    wins, ties = F.col("c._wins").cast("long"), F.col("c._ties").cast("long")
    return each.select(
        *keys, "c.config.k", "c.config.alpha", "c.config.sign", "num_pairs", wins.alias("wins"), ties.alias("ties"), (F.col("num_pairs") - wins - ties).alias("losses"),
        (wins / F.col("num_pairs")).alias("pairwise_acc"), (F.col("c._sums") / F.col("num_pairs")).alias("mean_margin"),
    )


def tuned_and_tested(table: DataFrame, keys: Sequence[str], split: str = "split", tune: str = "val", test: str = "test") -> DataFrame:
    """The configuration that is best on ``tune``, reported on ``test`` beside the baseline there, for :func:`grid_summaries` by keys and split.

    Best is the highest pairwise accuracy, then mean margin, smaller alpha, smaller k, smaller sign. Groups without rows in either split are left out.
    """
    keys = list(keys)
    steered = table.filter("k > 0")
    by = [F.round("pairwise_acc", 9), F.round("mean_margin", 9), -F.abs(F.col("alpha")), -F.col("k"), -F.col("sign")]
    best = best_of(steered.filter(F.col(split) == tune).select(*keys, "k", "alpha", "sign", "pairwise_acc", "mean_margin"), keys, by)
    best = best.select(*keys, "k", "alpha", "sign", F.col("pairwise_acc").alias("tuned_pairwise_acc"), F.col("mean_margin").alias("tuned_mean_margin"))
    tested = table.filter(F.col(split) == test)
    base = tested.filter("k = 0").select(*keys, F.col("pairwise_acc").alias("base_pairwise_acc"), F.col("mean_margin").alias("base_mean_margin"))
    at = tested.select(*keys, "k", "alpha", "sign", "num_pairs", "wins", "ties", "losses", "pairwise_acc", "mean_margin")
    joined = best.join(at, [*keys, "k", "alpha", "sign"]).join(base, keys)
    return joined.withColumns({
        "delta_pairwise_acc": F.col("pairwise_acc") - F.col("base_pairwise_acc"), "delta_mean_margin": F.col("mean_margin") - F.col("base_mean_margin"),
    })
