"""Intervals of paired metrics, prefix scores with a frozen test, and steering grids, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import resampling, selection
from pairloom.operators import vectors as vec

B = 60


def weight(key, b, seed=42):
    u = int(hashlib.md5(f"{seed}|{key}|{b}".encode()).hexdigest()[:8], 16) / 2**32
    k, total, term = 0, np.exp(-1.0), np.exp(-1.0)
    while u >= total and 1 - total > 2.0**-32:
        k += 1
        term /= k
        total += term
    return k


def metrics_of(pos, neg):
    accuracy = np.mean([p > n for p, n in zip(pos, neg)])
    auroc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    ranked = sorted([(-s, 0) for s in pos] + [(-s, 1) for s in neg])
    hits, total = 0, 0.0
    for place, (_, is_neg) in enumerate(ranked, 1):
        hits += not is_neg
        total += 0 if is_neg else hits / place
    return accuracy, auroc, total / len(pos)


@pytest.mark.parametrize("range_scores", [20_000, 3])
def test_pair_intervals(spark, monkeypatch, range_scores):
    monkeypatch.setattr(resampling, "RANGE_SCORES", range_scores)
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(8) / 4, rng.randrange(6) / 4) for g in "abc" for i in range({"a": 40, "b": 7, "c": 1}[g])]
    df = spark.createDataFrame([*rows, ("b", 99, 1.0, None)], "g string, i long, score_pos double, score_neg double").repartition(3)
    got = {r["g"]: r for r in resampling.pair_intervals(df, ["g"], "i", replicates=B).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        found = []
        for b in range(B):
            w = [weight(r[1], b) for r in own]
            if sum(w):
                found.append(metrics_of([r[2] for r, n in zip(own, w) for _ in range(n)], [r[3] for r, n in zip(own, w) for _ in range(n)]))
        for k, name in enumerate(("pairwise_acc", "auroc", "average_precision")):
            e = sorted(f[k] for f in found)
            assert got[g][f"{name}_lower_95"] == pytest.approx(e[int(0.025 * (len(e) - 1))])
            assert got[g][f"{name}_upper_95"] == pytest.approx(e[int(0.975 * (len(e) - 1))])


def test_intervals_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, i long, score_pos double, score_neg double, v double")
    assert resampling.pair_intervals(empty, ["g"], "i", replicates=B).count() == 0
    assert resampling.bootstrap_interval(empty, ["g"], F.col("v"), "i", B).count() == 0


def test_frozen_test_takes_k_and_threshold_from_the_tuning_split(spark):
    rng = np.random.default_rng(2)
    ks, rows = (1, 2, 4), []
    for split in ("val", "test"):
        for pair in range(30):
            base = rng.normal(size=3)
            rows += [(split, "s", pair, "pos", (base + [0.1, 0.9, 0.3]).tolist()), (split, "s", pair, "neg", (base - rng.random(3) * [1, 1, 0.2]).tolist())]
    scores = spark.createDataFrame(rows, "split string, subtype string, pair int, branch string, scores array<double>")
    row = vec.frozen_test(scores, ["subtype"], "pair", "split", ks).first()
    by = {(s, p, b): v for s, _, p, b, v in rows}
    accuracy = [np.mean([by["val", p, "pos"][j] > by["val", p, "neg"][j] for p in range(30)]) for j in range(3)]
    j = int(np.argmax(accuracy))
    assert row["k"] == ks[j] and row["tuned_acc"] == pytest.approx(accuracy[j])
    labeled = [(by["val", p, b][j], b == "pos") for p in range(30) for b in ("pos", "neg")]

    def balanced(t):
        return (np.mean([s >= t for s, y in labeled if y]) + np.mean([s < t for s, y in labeled if not y])) / 2

    at = sorted({s for s, _ in labeled})
    cuts = [at[0] - 1e-6, *[(a + b) / 2 for a, b in zip(at, at[1:])], at[-1] + 1e-6]
    threshold = max(cuts, key=lambda t: (round(balanced(t), 12), -t))
    assert row["threshold"] == pytest.approx(threshold, abs=1e-8)
    assert row["accuracy"] == pytest.approx(np.mean([(by["test", p, b][j] >= threshold) == (b == "pos") for p in range(30) for b in ("pos", "neg")]))


def test_prefix_scores_are_means_over_the_best_heads(spark):
    rng = np.random.default_rng(3)
    vecs = {(p, b, h): rng.normal(size=4) for p in range(3) for b in ("pos", "neg") for h in range(3)}
    axes = {h: (a := rng.normal(size=4)) / np.linalg.norm(a) for h in range(3)}
    acts = spark.createDataFrame([(p, "s", b, 0, h, v.tolist()) for (p, b, h), v in vecs.items()], "pair int, subtype string, branch string, layer int, head int, vec array<double>")
    protos = spark.createDataFrame([("s", 0, h, a.tolist()) for h, a in axes.items()], "subtype string, layer int, head int, axis array<double>")
    ranked = spark.createDataFrame([("s", 0, h, r) for h, r in ((2, 1), (0, 2), (1, 3))], "subtype string, layer int, head int, rank long")
    for r in vec.prefix_scores(acts, protos, ranked, ["pair"], (1, 2, 8)).collect():
        part = [vecs[r["pair"], r["branch"], h] @ axes[h] / np.linalg.norm(vecs[r["pair"], r["branch"], h]) for h in (2, 0, 1)]
        assert r["scores"] == pytest.approx([part[0], np.mean(part[:2]), np.mean(part)])


def test_grid_of_configurations(spark):
    rng = random.Random(4)
    rows = [(s, split, rng.randrange(-4, 5) / 4, [rng.randrange(-3, 4) / 2 for _ in range(2)]) for s in "xy" for split in ("val", "test") for _ in range(25)]
    df = spark.createDataFrame(rows, "subtype string, split string, base double, effects array<double>").repartition(4)
    ks, alphas, signs = (8, 16), (0.5, 1.0), (-1, 1)
    table = selection.grid_summaries(df, ["subtype", "split"], F.col("base"), F.col("effects"), ks, alphas, signs)
    got = {(r["subtype"], r["split"], r["k"], r["alpha"], r["sign"]): r for r in table.collect()}
    configs = [(0, 0.0, 1), *[(k, a, s) for k in ks for a in alphas for s in signs]]
    assert len(got) == 4 * len(configs)

    def margins(subtype, split, k, a, s):
        return [b + (a * s * e[ks.index(k)] if k else 0) for t, p, b, e in rows if (t, p) == (subtype, split)]

    for (subtype, split, *config), r in got.items():
        m = margins(subtype, split, *config)
        assert (r["num_pairs"], r["wins"], r["ties"], r["losses"]) == (25, sum(x > 0 for x in m), sum(x == 0 for x in m), sum(x < 0 for x in m))
        assert r["mean_margin"] == pytest.approx(np.mean(m))
    for r in selection.tuned_and_tested(table, ["subtype"]).collect():
        best = min(configs[1:], key=lambda c: (-np.mean([x > 0 for x in margins(r["subtype"], "val", *c)]), -round(np.mean(margins(r["subtype"], "val", *c)), 9), c[1], c[0], c[2]))
        assert (r["k"], r["alpha"], r["sign"]) == best
        assert r["delta_pairwise_acc"] == pytest.approx(r["pairwise_acc"] - np.mean([x > 0 for x in margins(r["subtype"], "test", 0, 0, 1)]))


def test_unit_weights_are_those_of_the_hash_for_keys_of_any_length():
    keys = ["a", "", None, "x" * 49, "y" * 60, "é1-2", "a"]
    got = resampling.unit_weights(keys, 12, 42)
    assert got.tolist() == [[weight(k or "", b) for b in range(12)] for k in keys]


def test_interval_of_a_mean_does_not_draw_weights_row_by_row_in_expressions(spark, monkeypatch):
    """Weights come from one call a batch of rows; groups with null keys and values, and more groups than a task holds, are whole."""
    monkeypatch.setattr(resampling, "HELD_GROUPS", 2)
    rng = random.Random(3)
    rows = [(g, f"{i}", None if i % 9 == 8 else rng.random() - 0.5) for g in ("a", "b", None, "c") for i in range(30)]
    df = spark.createDataFrame(rows, "g string, k string, v double").repartition(3)
    interval = resampling.bootstrap_interval(df, ["g"], F.col("v"), "k", B)
    plan = interval._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5" not in plan
    got = {r["g"]: r for r in interval.collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        own = [(k, v) for h, k, v in rows if h == g and v is not None]
        found = []
        for b in range(B):
            w = [weight(k, b) for k, _ in own]
            if sum(w):
                found.append(sum(n * v for n, (_, v) in zip(w, own)) / sum(w))
        e = sorted(found)
        assert got[g]["mean"] == pytest.approx(np.mean([v for _, v in own]))
        assert got[g]["lower_95"] == pytest.approx(e[int(0.025 * (len(e) - 1))])
        assert got[g]["upper_95"] == pytest.approx(e[int(0.975 * (len(e) - 1))])
