"""Sampling, capping, balancing, splitting and deduplicating, all reproducible under any partitioning."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators.ordering import GROUP_LIMIT, first_per_group, global_rank, running_sums, seeded_key, top_k
from pairloom.session import pinned

SMALL_SAMPLE = 10_000


def hash_number(seed: int | str, *cols: Column | str) -> Column:
    """Non-negative 32-bit number from the seeded key."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("long")


def pick(items: Column, seed: int | str, *cols: Column | str) -> Column:
    """One item of an array by hash; null when it is empty."""
    n = F.size(items)
    return F.when(n > 0, F.get(items, F.pmod(hash_number(seed, *cols), F.greatest(n, F.lit(1))).cast("int")))


def sample(df: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """Exactly n rows by hashed key. A large n is cut by a distributed rank instead of a limit."""
    keyed = df.withColumn("_s", seeded_key(seed, *key))
    if n <= SMALL_SAMPLE:
        return keyed.orderBy("_s", *key).limit(n).drop("_s")
    return global_rank(keyed, [], ["_s", *key], "_r").filter(F.col("_r") <= n).drop("_s", "_r")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, seed: int, *key: str) -> DataFrame:
    """n rows of every stratum."""
    return top_k(df, strata, [seeded_key(seed, *key), *[F.col(k) for k in key]], n)


def ratio_split(keys: DataFrame, key: str, ratios: Mapping[str, float], seed: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Assign each key to a split by its place in the (seeded) order.

    Borders are ``n * ratio`` rounded half to even; the last split takes the rest. ``keys`` is read twice.
    """
    check_ratios(ratios)
    ordered = keys.withColumn("_s", seeded_key(seed, key) if seed is not None else F.lit(""))
    ranked = global_rank(ordered, list(within), ["_s", key], "_r")
    sizes = keys.groupBy(*within).agg(F.count("*").alias("_n"))
    joined = ranked.join(sizes, list(within)) if within else ranked.withColumn("_n", F.lit(keys.count()))
    names, border, out = list(ratios), F.lit(0.0), None
    for name in names[:-1]:
        border = border + F.bround(F.col("_n") * F.lit(float(ratios[name])), 0)
        hit = F.col("_r") <= border
        out = F.when(hit, name) if out is None else out.when(hit, name)
    split = out.otherwise(names[-1]) if out is not None else F.lit(names[-1])
    return joined.withColumn("split", split).drop("_s", "_r", "_n")


def check_ratios(ratios: Mapping[str, float]) -> None:
    if any(r <= 0 for r in ratios.values()):
        raise ValueError("split ratios must be positive")
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {dict(ratios)}")


def group_split(rows: DataFrame, ratios: Mapping[str, float], seed: int = 42, group: str = "image_id", subtype: str = "subtype") -> DataFrame:
    """Splits of whole groups that respect size and subtype mix: ``(group, split, num_pairs, stratum)``.

    Strata are (most frequent subtype, size class). Inside a stratum groups come in hash order and the running
    number of rows decides the split, so every stratum is cut at the wanted shares and no group is divided.
    """
    check_ratios(ratios)
    counts = rows.groupBy(group, subtype).agg(F.count("*").alias("n"))
    shaped = counts.groupBy(group).agg(
        F.sum("n").alias("num_pairs"), F.max_by(subtype, F.struct("n", F.col(subtype))).alias("dominant"),
    ).withColumns({"stratum": F.concat_ws("/", "dominant", F.floor(F.log2("num_pairs")).cast("string")), "_s": seeded_key(seed, group)})
    shaped = pinned(shaped)
    running = running_sums(shaped, ["stratum"], ["_s", group], {"_cum": F.col("num_pairs")})
    total = shaped.groupBy("stratum").agg(F.sum("num_pairs").alias("_total"))
    place = (F.col("_cum") - F.col("num_pairs") / 2.0) / F.col("_total")
    border, out = 0.0, None
    names = list(ratios)
    for name in names[:-1]:
        border += ratios[name]
        out = F.when(place <= border, name) if out is None else out.when(place <= border, name)
    split = out.otherwise(names[-1]) if out is not None else F.lit(names[-1])
    return running.join(total, "stratum").select(group, split.alias("split"), "num_pairs", "stratum")


def largest_remainder(n: Column, shares: Mapping[str, float], by_share: bool = False) -> Column:
    """MAP of whole parts of n by share; what rounding leaves goes to the largest remainders.

    Ties: the name that sorts last, or with ``by_share`` the larger share and then the declared order.
    """
    def part(i: int, name: str, share: float) -> Column:
        exact = n * F.lit(float(share))
        tie = F.struct(F.lit(float(share)), F.lit(-i)) if by_share else F.struct(F.lit(0.0), F.lit(sorted(shares).index(name)))
        return F.struct((exact - F.floor(exact)).alias("rest"), tie.alias("tie"), F.lit(name).alias("name"), F.floor(exact).cast("long").alias("whole"))

    parts = F.array(*[part(i, k, s) for i, (k, s) in enumerate(shares.items())])
    ranked = F.reverse(F.array_sort(parts))
    left = n.cast("long") - F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["whole"])
    given = F.transform(ranked, lambda p, i: F.struct(p["name"].alias("key"), (p["whole"] + F.when(i < left, 1).otherwise(0)).alias("value")))
    return F.map_from_entries(given)


def allocation(n: int, shares: Mapping[str, float]) -> dict[str, int]:
    """:func:`largest_remainder` for one number of the driver (quotas of a configuration)."""
    exact = {k: n * float(s) for k, s in shares.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    rest = sorted(shares, key=lambda k: (exact[k] - out[k], shares[k], -list(shares).index(k)), reverse=True)
    for k in rest[: n - sum(out.values())]:
        out[k] += 1
    return out


def bucket_quota(rows: DataFrame, group: str, bucket: str, limit: int, order: Sequence[Column | str], ratios: Mapping[str, float] = fixed.BUCKET_RATIO, closed: str = "horizontal") -> DataFrame:
    """At most ``limit`` rows per group: first each bucket's quota, then one more of each open bucket in turn.

    The closed bucket never gets more than its quota. No group contributes more than limit rows per bucket to the
    second step.
    """
    quota = allocation(limit, ratios)
    table = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(ratios) for x in (k, i)])
    near = top_k(rows, [group, bucket], order, limit, "_r")
    over = F.col("_r") - table[F.col(bucket)]
    staged = near.withColumns({"_pass": F.when(over <= 0, 0).otherwise(1), "_round": F.greatest(over, F.lit(0)), "_b": place[F.col(bucket)]})
    staged = staged.filter((F.col("_pass") == 0) | (F.col(bucket) != closed))
    return top_k(staged, [group], ["_pass", "_round", "_b", "_r"], limit, "pick").drop("_pass", "_round", "_b", "_r")


def disjoint_groups(eligible: Mapping[str, DataFrame], targets: Mapping[str, int], key: str, seed: int) -> DataFrame:
    """Each group serves one type: types choose in the given order among groups not taken yet."""
    taken: DataFrame | None = None
    for name, groups in eligible.items():
        free = groups.select(key).distinct()
        if taken is not None:
            free = free.join(taken, key, "left_anti")
        chosen = pinned(sample(free, seed, targets[name], key).select(key, F.lit(name).alias("type")))
        taken = chosen if taken is None else taken.unionByName(chosen)
    if taken is None:
        raise ValueError("no types given")
    return taken


def yes_no_balanced(candidates: DataFrame, group: str, answer: str, targets: Mapping[str, int], seed: int, *key: str) -> DataFrame:
    """At most one row per group and answer, and at most ``targets[answer]`` rows per answer."""
    one = first_per_group(candidates.withColumn("_s", seeded_key(seed, group, answer, *key)), [group, answer], ["_s", *key])
    kept = top_k(one.withColumn("_g", seeded_key(seed, group)), [answer], ["_g", group], max(targets.values()), "_r")
    table = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    return kept.filter(F.col("_r") <= F.coalesce(table[F.col(answer)], F.lit(0))).drop("_s", "_g", "_r")


def shortfall(rows: DataFrame, answer: str, targets: Mapping[str, int]) -> DataFrame:
    """(answer, missing) against the targets."""
    want = rows.sparkSession.createDataFrame([(k, int(v)) for k, v in targets.items()], f"{answer} string, target long")
    have = rows.groupBy(answer).agg(F.count("*").alias("n"))
    return want.join(have, answer, "left").select(answer, F.greatest(F.col("target") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("missing"))


def capped_selection(candidates: DataFrame, within: Sequence[str], caps: Mapping[str, int], target: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Rows that respect a cap on every listed column at once, at most ``target`` per ``within``: what one pass in seeded order takes.

    A pass takes a row if none of its values has reached its cap and the group its target; nulls and empty texts are not capped. Here
    each round offers every open group its next rows in order, a number bounded by the target and without those a full value rules
    out already, and passes through them with the counts so far. What a round leaves out can never be taken, so the
    rounds together are that pass; they end when every group is full or has no rows left. Of the candidates with the same values in all
    listed columns, the pass takes the first ones up to some place: only as many as the least of their caps are written, once.
    """
    size = max(4 * target, GROUP_LIMIT)
    order = ["_s", *key, "_row"]
    columns = list(caps)
    pool = candidates.withColumns({"_g": F.to_json(F.struct(*within)), "_s": seeded_key(seed, *key), "_row": F.monotonically_increasing_id()})
    if target <= GROUP_LIMIT:
        # Spark keeps the first of them in every task before the shuffle.
        least = F.least(F.lit(target), *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", target).otherwise(caps[c]) for c in columns])
        pool = top_k(pool, ["_g", *columns], order, target, "_place").filter(F.col("_place") <= least).drop("_place")
    pool = pinned(pool)
    narrow = pool.select("_g", *dict.fromkeys([*order, *columns]))
    taken = pinned(narrow.limit(0))

    def one_pass(group: tuple, offered: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        used = {c: Counter(v for v in before[c] if v) for c in columns}
        room, rows = target - len(before), []
        for row, *values in zip(offered["_row"], *[offered[c] for c in columns]):
            if len(rows) >= room:
                break
            if all(not v or used[c][v] < caps[c] for c, v in zip(columns, values)):
                rows.append(row)
                for c, v in zip(columns, values):
                    used[c][v] += 1
        return pd.DataFrame({"_row": pd.Series(rows, dtype="int64")})

    def values(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("_g", "_row", *more, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])

    ends: DataFrame | None = None
    while True:
        left = narrow
        if ends is not None:
            left = left.join(ends, "_g").filter(F.struct(*order) > F.col("_end")).drop("_end")
            left = left.join(taken.groupBy("_g").agg(F.count("*").alias("_n")).filter(F.col("_n") >= target), "_g", "left_anti")
            for c in columns:
                full = taken.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).groupBy("_g", c).agg(F.count("*").alias("_n")).filter(F.col("_n") >= caps[c])
                left = left.join(full.drop("_n"), ["_g", c], "left_anti")
        offered = pinned(top_k(left.select(*narrow.columns), ["_g"], order, size, "_place"))
        if offered.isEmpty():
            break
        chosen = values(offered, "_place").groupBy("_g").cogroup(values(taken).groupBy("_g")).applyInPandas(lambda g, new, old: one_pass(g, new.sort_values("_place"), old), "_row long")
        taken = pinned(taken.unionByName(offered.join(chosen, "_row", "left_semi").select(*narrow.columns)))
        # A group that had no rows this time has none later either.
        ends = pinned(offered.groupBy("_g").agg(F.max(F.struct(*order)).alias("_end")))
    return pool.join(taken.select("_row"), "_row", "left_semi").drop("_g", "_s", "_row")


def share_caps(target: int, shares: Mapping[str, float] = fixed.SELECTION_SHARES) -> dict[str, int]:
    return {k: max(1, math.ceil(target * s)) for k, s in shares.items()}


def deduplicated(rows: DataFrame, signature: Sequence[str], row_id: str, order: Sequence[str]) -> DataFrame:
    """First row of every signature, then ids made unique with ``_dup2``, ``_dup3`` and so on."""
    unique = pinned(first_per_group(rows, list(signature), [F.col(c) for c in order]).select(*rows.columns))
    ranked = global_rank(unique, [row_id], [c for c in order if c != row_id], "_r")
    fresh = F.when(F.col("_r") == 1, F.col(row_id)).otherwise(F.concat(F.col(row_id), F.lit("_dup"), F.col("_r")))
    return ranked.withColumn(row_id, fresh).drop("_r")


def cooccurrence(present: DataFrame) -> DataFrame:
    """(a, b, n): images in which two different values meet, from ``present(image_id, present ARRAY)``.

    Equal sets are counted first; pairs are formed per distinct set only.
    """
    sets = present.groupBy("present").agg(F.count("*").alias("_m"))
    ends = sets.select("_m", F.explode("present").alias("a"), "present").select("_m", "a", F.explode("present").alias("b"))
    return ends.filter("a <> b").groupBy("a", "b").agg(F.sum("_m").alias("n"))


def hard_negatives(images: DataFrame, popular: DataFrame, seed: int) -> DataFrame:
    """Negatives of ``images(image_id, present, absent)`` by three strategies, with how each was found.

    ``hard`` is the absent value that occurs most often together with the present ones. It depends on the set of
    present values only, so it is computed once per distinct set and joined back; so is the absent value of the
    highest count in ``popular(category, n)``, ties to the lower name.
    """
    images = pinned(images)
    sets = images.select("present", "absent").distinct()
    pairs = cooccurrence(images)
    near = sets.select("present", "absent", F.explode("present").alias("a")).join(pairs, "a").filter(F.array_contains("absent", F.col("b")))
    sums = near.groupBy("present", "b").agg(F.sum("n").alias("score"))
    best = sums.groupBy("present").agg(F.max(F.struct("score", "b")).alias("top"), F.max("score").alias("most"))
    ties = sums.join(best, "present").filter("score = most").groupBy("present").agg(F.sort_array(F.collect_set("b")).alias("hardest"))
    named = sets.select("absent").distinct().select("absent", F.explode("absent").alias("category")).join(popular, "category")
    liked = named.groupBy("absent").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("liked"))
    joined = images.join(ties, "present", "left").join(liked, "absent", "left")
    some = pick(F.col("absent"), seed, "image_id")
    return joined.filter(F.size("absent") > 0).select(
        "image_id", some.alias("random_negative"), F.coalesce("liked", some).alias("popular_negative"),
        F.when(F.col("liked").isNotNull(), "popular_absent").otherwise("popular_fallback_random").alias("popular_strategy"),
        F.coalesce(pick(F.col("hardest"), seed, "image_id"), some).alias("hard_negative"),
        F.when(F.col("hardest").isNotNull(), "cooccurrence_hard_absent").otherwise("hard_fallback_random").alias("hard_strategy"),
    )


def negative_hardness(negatives: DataFrame, present: DataFrame) -> DataFrame:
    """Rank of each negative among the absent candidates of its image, by highest co-occurrence with a present value.

    ``negatives(row_id, image_id, negative)``, ``present(image_id, present)``. Candidates are ranked once per
    distinct set of present values (score descending, then name descending).
    """
    pairs = cooccurrence(present)
    vocabulary = [r[0] for r in present.select(F.explode("present").alias("w")).distinct().orderBy("w").limit(20_001).collect()]
    if len(vocabulary) > 20_000:
        raise ValueError("more than 20000 values")
    words = F.array(*map(F.lit, vocabulary))
    sets = present.select("present").distinct()
    scores = sets.select("present", F.explode("present").alias("a")).join(pairs, "a").groupBy("present", "b").agg(F.max("n").alias("n"))
    listed = scores.groupBy("present").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("score"))
    with_scores = sets.join(listed, "present", "left")
    absent = F.array_except(words, "present")
    zero = F.lit(0).cast("long")
    ranked = F.reverse(F.array_sort(F.transform(absent, lambda c: F.struct(F.coalesce(F.col("score")[c], zero).alias("n"), c.alias("c")))))
    by_set = with_scores.select("present", F.transform(ranked, lambda x: x["c"]).alias("order"), "score")
    joined = negatives.join(present, "image_id").join(by_set, "present")
    place = F.array_position("order", F.col("negative"))
    return joined.select(
        "row_id", "negative", F.when(place > 0, place).alias("rank"), F.coalesce(F.col("score")[F.col("negative")], zero).alias("count")
    )
