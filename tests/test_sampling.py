import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators import sampling, sets, validate

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def test_group_split_keeps_groups_whole_and_shares_close(spark):
    rows = [(f"i{i}", f"p{i}_{j}", ["cat", "cnt", "col", "rel"][(i + j) % 4]) for i in range(400) for j in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "image_id string, pair_id string, subtype string")
    split = sampling.group_split(df, RATIOS, 42)
    assigned = df.join(split.select("image_id", "split"), "image_id")
    assert {r["check"]: r["n"] for r in sets.leakage(df, assigned).collect()} == {
        "overlap_test_train": 0, "overlap_test_val": 0, "overlap_train_val": 0, "missing_ids": 0, "duplicate_ids": 0,
    }
    counts = Counter(r["split"] for r in assigned.collect())
    for name, share in RATIOS.items():
        assert abs(counts[name] / len(rows) - share) < 0.05
    again = {tuple(r) for r in sampling.group_split(df.repartition(17), RATIOS, 42).select("image_id", "split").collect()}
    assert again == {tuple(r) for r in split.select("image_id", "split").collect()}
    assert again != {tuple(r) for r in sampling.group_split(df, RATIOS, 43).select("image_id", "split").collect()}


def test_bad_ratios_raise():
    with pytest.raises(ValueError, match="sum to 1"):
        sampling.check_ratios({"train": 0.5, "val": 0.1, "test": 0.1})
    with pytest.raises(ValueError, match="positive"):
        sampling.check_ratios({"train": 1.0, "val": 0.0})


def test_leakage_is_reported(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "image_id string, pair_id string")
    assigned = spark.createDataFrame([("1", "a", "train"), ("1", "a", "val"), ("2", "b", "test")], "image_id string, pair_id string, split string")
    got = {r["check"]: r["n"] for r in sets.leakage(rows, assigned).collect()}
    assert got == {"overlap_test_train": 0, "overlap_test_val": 0, "overlap_train_val": 1, "missing_ids": 1, "duplicate_ids": 1}


def test_bucket_quota_equals_the_round_robin_loop(spark):
    rng = random.Random(2)
    rows = [(f"i{rng.randrange(12)}", i, rng.choice(fixed.BUCKET_ORDER)) for i in range(200)]
    limit = 6
    df = spark.createDataFrame(rows, "image_id string, id int, bucket string")
    got = defaultdict(list)
    for r in sampling.bucket_quota(df, "image_id", "bucket", limit, ["id"]).orderBy("pick").collect():
        got[r["image_id"]].append(r["id"])
    quota = sampling.allocation(limit, fixed.BUCKET_RATIO)
    for image in {r[0] for r in rows}:
        queues = {b: [i for g, i, k in rows if g == image and k == b] for b in fixed.BUCKET_ORDER}
        chosen = []
        for b in fixed.BUCKET_ORDER:
            chosen += [queues[b].pop(0) for _ in range(min(quota[b], len(queues[b])))]
        chosen = chosen[:limit]
        while len(chosen) < limit and any(queues[b] for b in fixed.BUCKET_ORDER if b != "horizontal"):
            for b in fixed.BUCKET_ORDER:
                if b != "horizontal" and queues[b] and len(chosen) < limit:
                    chosen.append(queues[b].pop(0))
        assert got[image] == chosen


def test_every_cap_holds(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", "s", "hot" if i % 2 else f"o{rng.randrange(6)}", rng.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "pair_id string, subtype string, b_object string, b_value string")
    out = sampling.capped_selection(df, ["subtype"], {"b_object": 9, "b_value": 20}, 60, 1, ["pair_id"]).collect()
    assert 0 < len(out) <= 60
    assert max(Counter(r["b_object"] for r in out).values()) <= 9
    assert max(Counter(r["b_value"] for r in out if r["b_value"]).values()) <= 20


def test_largest_remainder(spark):
    shares = {"cat": 0.34, "attr": 0.33, "rel": 0.33}
    for n in (0, 1, 2, 10, 17):
        got = spark.range(1).select(sampling.largest_remainder(F.lit(n), shares).alias("m")).first()["m"]
        assert sum(got.values()) == n
        exact = {k: n * s for k, s in shares.items()}
        order = sorted(shares, key=lambda k: (exact[k] - int(exact[k]), k), reverse=True)
        want = {k: int(exact[k]) for k in shares}
        for k in order[: n - sum(want.values())]:
            want[k] += 1
        assert got == want
    assert sampling.allocation(4, fixed.BUCKET_RATIO) == {"horizontal": 2, "vertical": 0, "depth": 1, "contact": 1, "interaction": 0, "semantic": 0}


def test_hard_negative_is_the_most_cooccurring_absent_value(spark):
    df = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b"]), ("3", ["a", "c"]), ("4", ["a"])], "image_id string, present array<string>")
    images = df.withColumn("absent", F.array_except(F.array(*map(F.lit, "abcd")), "present"))
    got = {r["image_id"]: r for r in sampling.hard_negatives(images, spark.createDataFrame([("a", 4), ("b", 2), ("c", 1), ("d", 1)], "category string, n long"), 1).collect()}
    assert got["4"]["hard_negative"] == "b" and got["4"]["hard_strategy"] == "cooccurrence_hard_absent"
    assert got["4"]["popular_negative"] == "b" and got["1"]["hard_negative"] == "c"


def test_shards_are_disjoint_and_merge_back(spark):
    df = spark.createDataFrame([(i, f"p{i}", [0.0, 1.0]) for i in range(11)], "row_index bigint, pair_id string, vec array<double>")
    parts = [validate.shard(df, "row_index", 3, i) for i in range(3)]
    assert sorted(r["row_index"] for p in parts for r in p.collect()) == list(range(11))
    assert sets.merged_shards(parts).count() == 11
    with pytest.raises(validate.ValidationError, match="duplicate"):
        sets.merged_shards([parts[0], parts[0]])


def test_layers():
    assert validate.parse_layers("5-7, 9") == [5, 6, 7, 9]
    for bad in ("", "7-5"):
        with pytest.raises(ValueError):
            validate.parse_layers(bad)


def test_violations(spark):
    df = spark.createDataFrame([("1", "yes", "q"), ("2", "maybe", ""), ("2", "no", "q")], "id string, answer string, question string")
    got = Counter(tuple(r) for r in validate.violations(df, "id", ["question"], {"answer": ("yes", "no")}, ["id"]).collect())
    assert got == {("2", "missing:question"): 1, ("2", "enum:answer"): 1, ("2", "duplicate:id"): 1}
    with pytest.raises(validate.ValidationError):
        validate.require_none(validate.violations(df, "id", ["question"]), "rows")


def test_popular_negative_is_found_behind_a_thousand_others(spark):
    """An image that holds the 1200 most frequent values gets the next one."""
    names = [f"v{i:04d}" for i in range(1300)]
    df = spark.createDataFrame([("1", names[:1200]), ("2", names[:1])], "image_id string, present array<string>")
    images = df.withColumn("absent", F.array_except(F.array(*map(F.lit, names)), "present"))
    counts = spark.createDataFrame([(n, 2000 - i) for i, n in enumerate(names)], "category string, n long")
    got = {r["image_id"]: r for r in sampling.hard_negatives(images, counts, 1).collect()}
    assert got["1"]["popular_negative"] == "v1200" and got["1"]["popular_strategy"] == "popular_absent" and got["2"]["popular_negative"] == "v0001"


def test_capped_selection_ends_only_when_nothing_fits(spark):
    """A chain in which every round can add one row only."""
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(24)]
    df = spark.createDataFrame([(i, "t", a, b) for i, a, b in rows], "id int, type string, a string, b string")
    taken = {r["id"]: r for r in sampling.capped_selection(df, ["type"], {"a": 1, "b": 1}, 100, 3, ["id"]).collect()}
    a, b = [r["a"] for r in taken.values()], [r["b"] for r in taken.values()]
    assert len(set(a)) == len(a) and len(set(b)) == len(b)
    assert not [i for i, x, y in rows if i not in taken and x not in a and y not in b]


@pytest.mark.parametrize("target", [3, 25, 1000])
def test_capped_selection_is_one_pass_in_seeded_order(spark, monkeypatch, target):
    monkeypatch.setattr(sampling, "GROUP_LIMIT", 10)
    rng = random.Random(target)
    rows = [(i, rng.choice(["s", "t", None]), rng.choice(["hot", "hot", "x", "y", "", None]), f"b{rng.randrange(9)}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, subtype string, a string, b string, other double").repartition(5)
    caps = {"a": 7, "b": 4}
    want, used, n = set(), Counter(), Counter()
    for i, s, a, b, _ in sorted(rows, key=lambda r: (hashlib.md5(f"5|{r[0]}".encode()).hexdigest(), r[0])):
        if n[s] < target and all(not v or used[s, c, v] < caps[c] for c, v in (("a", a), ("b", b))):
            want.add(i)
            n[s] += 1
            used.update([(s, "a", a), (s, "b", b)])
    out = sampling.capped_selection(df, ["subtype"], caps, target, 5, ["id"])
    assert out.columns == df.columns and {r["id"] for r in out.collect()} == want and out.count() == len(want)
