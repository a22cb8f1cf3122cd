import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import metrics, rankmetrics, selection


def test_published_confusion_counts(spark):
    cells = [("yes", "yes", 1143), ("no", "no", 1469), ("no", "yes", 31), ("yes", "no", 357)]
    df = spark.createDataFrame([("r", y, p) for y, p, n in cells for _ in range(n)], "g string, label string, pred string")
    r = metrics.yes_no_metrics(df, ["g"], "strict", percent=True).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (1143, 1469, 31, 357)
    assert round(r["accuracy"], 2) == 87.07 and round(r["f1"], 2) == 85.49


def test_modes_differ_on_invalid_rows(spark):
    rows = [("yes", "yes"), ("no", "invalid"), ("yes", None), (None, "yes"), ("no", "no")]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, label string, pred string")
    read = lambda mode: metrics.yes_no_metrics(df, ["g"], mode).first()
    labeled, strict, shard, balanced = (read(m) for m in ("labeled", "strict", "strict_shard", "balanced"))
    assert (labeled["fp"], strict["fp"], balanced["fp"]) == (0, 1, 1)
    assert labeled["accuracy"] == 0.5 and strict["accuracy"] == 0.4
    assert (strict["invalid"], shard["invalid"]) == (2, 3)
    empty = metrics.yes_no_metrics(df.filter("label is null"), ["g"], "labeled").first()
    assert empty["accuracy"] is None and empty["f1"] == 0.0


def test_flips_with_a_missing_baseline(spark):
    df = spark.createDataFrame([("g", "yes", "yes", "no"), ("g", "no", "yes", "no"), ("g", "yes", "no", "invalid")], "g string, label string, pred string, base_pred string")
    r = metrics.flips(df, ["g"]).first()
    assert (r["wrong_to_right"], r["right_to_wrong"], r["wrong_to_wrong"], r["changed"]) == (1, 1, 1, 3)


def brute(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    hits = total = 0
    for rank, (s, y) in enumerate(sorted(zip(scores, labels), key=lambda x: (-x[0], -x[1])), 1):
        if y:
            hits += 1
            total += hits / rank
    values = sorted(set(scores))
    cuts = [values[0] - 1e-6, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1e-6]

    def balanced(t):
        return (sum(p >= t for p in pos) / len(pos) + sum(q < t for q in neg) / len(neg)) / 2

    best = cuts[0]
    for t in cuts[1:]:
        if balanced(t) > balanced(best):
            best = t
    return auc, total / len(pos), best, balanced(best)


@pytest.mark.parametrize("levels", [3, 40, 400])
def test_ranking_metrics_equal_brute_force(spark, levels):
    rng = random.Random(levels)
    labels = [rng.random() < 0.4 for _ in range(300)]
    scores = [round((rng.random() + 0.3 * y) * levels) / levels for y in labels]
    df = spark.createDataFrame([("g", int(y), float(s)) for y, s in zip(labels, scores)], "g string, label int, score double")
    steps = rankmetrics.score_steps(df, ["g"])
    auc, ap, threshold, gain = brute(labels, scores)
    assert rankmetrics.auroc(steps, ["g"]).first()["auroc"] == pytest.approx(auc)
    assert rankmetrics.average_precision(steps, ["g"]).first()["average_precision"] == pytest.approx(ap)
    got = rankmetrics.best_threshold(steps, ["g"]).first()
    assert got["threshold"] == pytest.approx(threshold) and got["balanced_accuracy"] == pytest.approx(gain)


def test_one_class_has_no_auroc_and_separable_scores_are_perfect(spark):
    df = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.4), ("two", 1, 0.9), ("two", 1, 0.8), ("two", 0, 0.2), ("two", 0, 0.1)], "g string, label int, score double")
    got = {r["g"]: r["auroc"] for r in rankmetrics.auroc(rankmetrics.score_steps(df, ["g"]), ["g"]).collect()}
    assert got == {"one": None, "two": 1.0}


def test_quantiles_interpolate(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(40)) for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = rankmetrics.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9]).first()
    s = sorted(values)
    assert (r["q0"], r["q25"], r["q50"], r["q90"]) == (s[0], s[25], s[50], s[90])


def test_bootstrap_is_ordered_and_repeatable(spark):
    df = spark.createDataFrame([("g", f"r{i}", float(i % 3 == 0)) for i in range(200)], "g string, k string, v double")
    read = lambda d: rankmetrics.bootstrap_interval(d, ["g"], F.col("v"), "k", 200).first()
    a, b = read(df), read(df.repartition(7))
    assert a == b and a["lower_95"] <= a["mean"] <= a["upper_95"]
    assert 0.05 < a["upper_95"] - a["lower_95"] < 0.25


def test_trend_and_best(spark):
    df = spark.createDataFrame([("u", 1.0, 0.1), ("u", 2.0, 0.2), ("d", 1.0, 0.3), ("d", 2.0, 0.1), ("f", 1.0, 0.2), ("f", 2.0, 0.2), ("m", 1.0, 0.1), ("m", 2.0, 0.3), ("m", 3.0, 0.2), ("s", 1.0, 0.1)], "g string, a double, v double")
    got = {r["g"]: r["trend"] for r in selection.sweep_trend(df, ["g"], "a", "v").collect()}
    assert got == {"u": "increasing", "d": "decreasing", "f": "flat", "m": "mixed", "s": "insufficient"}
    best = {r["g"]: r["a"] for r in selection.best_of(df, ["g"], [F.col("v"), -F.col("a")]).collect()}
    assert best["f"] == 1.0 and best["m"] == 2.0


def test_direction_verdict(spark):
    v = selection.direction_verdict(F.lit(0.5), F.lit(0.2), F.lit(-0.2))
    assert tuple(spark.range(1).select(v.alias("v")).first()["v"]) == ("shared direction", "desired")
