"""The penalty split against a plain sequential greedy, and its guarantees where strata take over."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators import splitting

RATIOS = {"train": 0.7, "val": 0.2, "test": 0.1}


def made(spark, groups, seed=1):
    rng = random.Random(seed)
    rows = [(f"i{g}", rng.choice("aaabbcd")) for g in range(groups) for _ in range(rng.choice([1, 1, 2, 3, 5, 8]))]
    return rows, spark.createDataFrame(rows, "image_id string, subtype string").repartition(5)


def greedy(rows, ratios):
    groups, totals = defaultdict(Counter), Counter()
    for g, s in rows:
        groups[g][s] += 1
        totals[s] += 1
    state = {s: (Counter(), [0]) for s in ratios}

    def penalty(s, own):
        r, (n, _) = ratios[s], state[s]
        size, t = sum(n.values()) + sum(own.values()), max(len(rows) * r, 1)
        out = abs(size - t) / t + 2 * max(size - t, 0) / t
        parts = [(n[x] + own[x], max(totals[x] * r, 1)) for x in totals]
        return out + sum(abs(c - t) / t + max(c - t, 0) / t for c, t in parts) / len(totals)

    out = {}
    for g in sorted(groups, key=lambda g: (-sum(groups[g].values()), hashlib.md5(f"42|{g}".encode()).hexdigest(), g)):
        chosen = min(ratios, key=lambda s: (sum(state[s][0].values()) + sum(groups[g].values()) > len(rows) * ratios[s], round(penalty(s, groups[g]), 9), state[s][1][0], sum(state[s][0].values()), s))
        state[chosen][0].update(groups[g])
        state[chosen][1][0] += 1
        out[g] = chosen
    return out


def test_a_head_of_all_groups_is_the_sequential_greedy(spark):
    rows, df = made(spark, 120)
    assert {r["image_id"]: r["split"] for r in splitting.penalty_split(df, RATIOS).collect()} == greedy(rows, RATIOS)


@pytest.mark.parametrize("head", [0, 10, 200])
def test_no_group_crosses_and_shares_hold(spark, head):
    rows, df = made(spark, 1500, seed=head)
    out = splitting.penalty_split(df, RATIOS, head=head)
    assert sorted(r["image_id"] for r in out.collect()) == sorted({g for g, _ in rows})
    assert out.filter("placed = 'penalty'").count() == head
    balance = {r["split"]: r for r in splitting.split_balance(df, out, RATIOS, tolerance=0.04).collect()}
    for split, ratio in RATIOS.items():
        assert abs(balance[split]["share"] - ratio) < 0.02 and balance[split]["share_ok"] and balance[split]["mix_ok"] and balance[split]["crossing"] == 0


def test_balance_sees_groups_that_cross_and_mixes_that_are_off(spark):
    df = spark.createDataFrame([("i", "a"), ("i", "a"), ("j", "b"), ("k", "b")], "image_id string, subtype string")
    assigned = spark.createDataFrame([("i", "train"), ("j", "train"), ("j", "test"), ("k", "test")], "image_id string, split string")
    rows = {r["split"]: r for r in splitting.split_balance(df, assigned, {"train": 0.5, "test": 0.5}).collect()}
    assert rows["train"]["crossing"] == rows["test"]["crossing"] == 1
    assert rows["test"]["mix_distance"] == pytest.approx(1 - 3 / 5) and not rows["test"]["mix_ok"]


def test_an_empty_table_has_no_splits(spark):
    empty = spark.createDataFrame([], "image_id string, subtype string")
    assert splitting.penalty_split(empty, RATIOS).count() == 0


def test_one_group_with_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("image_id"), (F.col("id") % 4).cast("string").alias("subtype"))
    out = splitting.penalty_split(df, RATIOS, head=5)
    balance = {r["split"]: r for r in splitting.split_balance(df, out, RATIOS).collect()}
    assert all(abs(balance[s]["share"] - r) < 0.01 for s, r in RATIOS.items())
