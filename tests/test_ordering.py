import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators.ordering import RANGE_ROWS, first_per_group, global_rank, range_count, running_sums, seeded_sample, top_k


def skewed(n=600, seed=1):
    """Half of the rows in one group."""
    rng = random.Random(seed)
    return [("hot" if i % 2 else rng.choice("abcdefgh"), rng.randrange(50), i) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 17])
def test_global_rank_equals_sorting(spark, partitions):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(partitions)
    want, seen = {}, defaultdict(int)
    for g, v, i in sorted(rows):
        seen[g] += 1
        want[i] = seen[g]
    got = {r["id"]: r["rank"] for r in global_rank(df, ["g"], ["v", "id"], parts=13).collect()}
    assert got == want


def test_global_rank_without_keys(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r["id"]: r["rank"] for r in global_rank(df, [], ["v", "id"], parts=9).collect()}
    assert got == {i: n for n, (v, i) in enumerate(sorted((v, i) for _, v, i in rows), 1)}


def test_running_sums(spark):
    rows = skewed(300)
    df = spark.createDataFrame(rows, "g string, v int, id int")
    total, want = defaultdict(int), {}
    for g, v, i in sorted(rows):
        total[g] += v
        want[i] = total[g]
    got = {r["id"]: r["s"] for r in running_sums(df, ["g"], ["v", "id"], {"s": F.col("v")}, parts=7).collect()}
    assert got == want


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_with_and_without_salt(spark, k):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 5003) for i in range(5003)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r["g"], r["v"]) for r in top_k(df, ["g"], ["v"], k, salts=5).collect()}
    want = set()
    for g in ("hot", "cold"):
        want |= {(g, v) for v in sorted(v for h, v in rows if h == g)[:k]}
    assert got == want


def test_first_per_group(spark):
    df = spark.createDataFrame(skewed(), "g string, v int, id int")
    got = {r["g"]: (r["v"], r["id"]) for r in first_per_group(df, ["g"], [-F.col("v"), F.col("id")]).collect()}
    want = {}
    for g, v, i in skewed():
        if g not in want or (-v, i) < (-want[g][0], want[g][1]):
            want[g] = (v, i)
    assert got == want


def test_seeded_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = {r[0] for r in seeded_sample(df.repartition(1), 5, 40, "id").collect()}
    b = {r[0] for r in seeded_sample(df.repartition(17), 5, 40, "id").collect()}
    assert a == b and len(a) == 40
    assert a != {r[0] for r in seeded_sample(df, 6, 40, "id").collect()}


def test_ranges_follow_the_rows():
    assert range_count(10, 8) == 8
    assert range_count(1000 * RANGE_ROWS, 8) == 1000
    assert range_count(10**10, 8) == 5000


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_previous_value_is_carried_across_ranges(spark, parts):
    rows = [("hot", k) for k in range(60)] + [("b", 5), ("c", 1), ("c", 4)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(4)
    got = {(r["g"], r["v"]): (r["n"], r["before"]) for r in running_sums(df, ["g"], ["v"], {"n": F.lit(1).cast("long")}, parts, "before").collect()}
    for g in ("hot", "b", "c"):
        own = sorted(v for x, v in rows if x == g)
        for i, v in enumerate(own):
            assert got[g, v] == (i + 1, own[i - 1] if i else None)
