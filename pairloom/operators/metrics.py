"""Yes/no metrics, flips and margins: one conditional aggregation per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def confusion(df: DataFrame, keys: Sequence[str], mode: str = "labeled", pred: str = "pred", label: str = "label", output: str | None = None) -> DataFrame:
    """Confusion counts per group.

    ``labeled``: unlabelled rows do not count; only a yes can be a false positive. ``strict``: every row
    counts in the denominator and an invalid prediction is an error of its label; ``strict_shard`` also calls
    rows without a label invalid. ``balanced``: labelled rows, any non-no is a false positive.
    """
    y, p = F.col(label), F.coalesce(F.col(pred), F.lit("invalid"))
    if mode.startswith("strict"):
        y, p = F.lower(F.trim(y)), F.lower(F.trim(p))
    y = F.coalesce(y, F.lit(""))
    yes, no, py, pn = y == "yes", y == "no", p == "yes", p == "no"
    invalid = ~((yes | no) & (py | pn)) if mode == "strict_shard" else ~(py | pn)
    aggs = {
        "n": F.count("*"), "labeled": F.count_if(yes | no), "label_yes": F.count_if(yes),
        "tp": F.count_if(yes & py), "tn": F.count_if(no & pn),
        "fp": F.count_if(no & (py if mode == "labeled" else ~pn)), "fn": F.count_if(yes & ~py),
        "invalid": F.count_if(invalid), "pred_yes": F.count_if(py), "labeled_pred_yes": F.count_if((yes | no) & py),
    }
    if output is not None:
        aggs["output_words"] = F.sum(text.word_count(F.coalesce(F.col(output), F.lit(""))))
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])


def yes_no_metrics(
    df: DataFrame, keys: Sequence[str], mode: str = "labeled", pred: str = "pred", label: str = "label", output: str | None = None, percent: bool = False
) -> DataFrame:
    """Accuracy, precision, recall, F1 and yes-rate per group; see :func:`confusion` for the modes.

    ``balanced`` adds specificity, balanced accuracy, MCC and the accuracies of always-yes and always-no.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    counts = confusion(df, keys, mode, pred, label, output)
    total = F.col("labeled") if mode in ("labeled", "balanced") else F.col("n")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    cols = {
        "accuracy": ratio(tp + tn, total, None if mode == "labeled" else 0.0),
        "precision": precision, "recall": recall, "f1": f1,
        "yes_rate": ratio(F.col("labeled_pred_yes"), total) if mode == "balanced" else ratio(F.col("pred_yes"), F.col("n")),
    }
    if output is not None:
        cols["avg_output_words"] = ratio(F.col("output_words"), F.col("n"))
    if mode == "balanced":
        specificity = ratio(tn, tn + fp)
        spread = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
        share = ratio(F.col("label_yes"), total)
        cols |= {
            "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2.0,
            "mcc": ratio(tp.cast("double") * tn - fp.cast("double") * fn, spread), "all_yes_accuracy": share, "all_no_accuracy": 1.0 - share,
        }
    if percent:
        cols = {k: c * 100.0 for k, c in cols.items()}
    kept = [*keys, "n", "labeled", "tp", "tn", "fp", "fn", "invalid"]
    return counts.select(*kept, *[c.alias(k) for k, c in cols.items()])


def group_accuracy(df: DataFrame, keys: Sequence[str], group: str, pred: str = "pred") -> DataFrame:
    """Accuracy per value of ``group``; null and empty become ``unknown``."""
    named = df.withColumn(group, F.coalesce(F.when(F.col(group) != "", F.col(group)), F.lit("unknown")))
    return yes_no_metrics(named, [*keys, group], "labeled", pred).select(*keys, group, "n", "accuracy", "yes_rate")


def change_type(pred: Column, base: Column, label: Column) -> Column:
    """What a changed prediction did; null when it did not change."""
    return (
        F.when(pred.eqNullSafe(base), F.lit(None).cast("string"))
        .when((pred == label) & (base != label), "wrong_to_right")
        .when((base == label) & (pred != label), "right_to_wrong")
        .otherwise("changed_wrong_to_wrong")
    )


def flips(df: DataFrame, keys: Sequence[str], pred: str = "pred", base: str = "base_pred", label: str = "label") -> DataFrame:
    """Counts of prediction changes against the baseline, overall and by label."""
    p, b, y = F.col(pred), F.col(base), F.col(label)
    kind = change_type(p, b, y)
    fixed, broken = (kind == "wrong_to_right"), (kind == "right_to_wrong")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(kind.isNotNull()).alias("changed"),
        F.count_if(fixed).alias("wrong_to_right"),
        F.count_if(broken).alias("right_to_wrong"),
        F.count_if(kind == "changed_wrong_to_wrong").alias("wrong_to_wrong"),
        F.count_if((b == "yes") & (p == "no")).alias("yes_to_no"),
        F.count_if((b == "no") & (p == "yes")).alias("no_to_yes"),
        F.count_if(fixed & (y == "yes")).alias("fixed_yes"),
        F.count_if(fixed & (y == "no")).alias("fixed_no"),
        F.count_if(broken & (y == "yes")).alias("broken_yes"),
        F.count_if(broken & (y == "no")).alias("broken_no"),
    )


def margin_summary(df: DataFrame, keys: Sequence[str], delta: Column, margin: Column, label: str = "label") -> DataFrame:
    """Mean margin change overall and by label (0 when empty), sign counts and accuracy of the margin's sign."""
    y = F.col(label)
    right = ((margin >= 0) & (y == "yes")) | ((margin < 0) & (y == "no"))
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(delta), F.lit(0.0)).alias("mean_delta"),
        F.coalesce(F.avg(F.when(y == "yes", delta)), F.lit(0.0)).alias("mean_delta_yes"),
        F.coalesce(F.avg(F.when(y == "no", delta)), F.lit(0.0)).alias("mean_delta_no"),
        F.count_if(delta > 0).alias("n_pos"), F.count_if(delta < 0).alias("n_neg"), F.count_if(delta == 0).alias("n_zero"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("margin_accuracy"),
    )


def candidate_summary(df: DataFrame, keys: Sequence[str], pos: str = "score_pos", neg: str = "score_neg") -> DataFrame:
    """Wins, ties and losses of the positive branch, pairwise accuracy and mean margin."""
    m = F.col(pos) - F.col(neg)
    return df.groupBy(*keys).agg(
        F.count("*").alias("num_pairs"), F.count_if(m > 0).alias("wins"), F.count_if(m == 0).alias("ties"), F.count_if(m < 0).alias("losses"),
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("pairwise_acc"), F.avg(m).alias("mean_margin"),
    )


def threshold_metrics(df: DataFrame, keys: Sequence[str], threshold: Column, label: str = "label", score: str = "score") -> DataFrame:
    """Binary metrics of ``score >= threshold``; ``threshold`` may be a column of the row or a literal."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(y & hit).alias("tp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn")
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    tpr, tnr, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return counts.select(
        *keys, "n", "tp", "tn", "fp", "fn", ratio(tp + tn, F.col("n")).alias("accuracy"), ((tpr + tnr) / 2.0).alias("balanced_accuracy"),
        precision.alias("precision"), tpr.alias("recall"), ratio(2 * precision * tpr, precision + tpr).alias("f1"),
    )


def swept_thresholds(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], label: str = "label", score: str = "score") -> DataFrame:
    """:func:`threshold_metrics` for several thresholds in one pass."""
    spread = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return threshold_metrics(spread, [*keys, "threshold"], F.col("threshold"), label, score)


def parser_comparison(df: DataFrame, keys: Sequence[str], output: str, label: str = "label") -> DataFrame:
    """Strict metrics of one text column under every answer parser."""
    o, y = F.col(output), F.col(label)
    variants = [
        F.struct(F.lit(m).alias("parser"), F.coalesce(text.parse_answer(o, m, y), F.lit("invalid")).alias("parsed")) for m in ("token", "earliest", "first_word", "contains")
    ]
    spread = df.select(*keys, label, F.inline(F.array(*variants)))
    return yes_no_metrics(spread, [*keys, "parser"], "strict", "parsed", label)
