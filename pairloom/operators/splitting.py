"""Splits of whole groups by penalty: the largest groups greedily against a small shared state, the rest by strata.

A sequential greedy looks at every group with the state of all before it. That matters for large groups, which decide sizes
and mixes. The ``head`` largest are placed that way; there are at most that many, so their counts may come to the driver. Any
other group holds less than ``1 / head`` of all rows, by arithmetic, so strata of them can be cut anywhere at about that cost: each is
cut at the shares that the head has left open for its subtype, scaled so that the rows of all strata fill what is open in each split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordering import running_sums, seeded_key
from pairloom.operators.sampling import check_ratios
from pairloom.session import pinned

#: Largest groups that are placed one by one, and rounds of scaling the shares of the strata.
HEAD, ROUNDS = 1000, 10


def _gap(n: float, target: float, over: float) -> float:
    """Relative distance from a target, with an extra price for going over it."""
    t = max(target, 1.0)
    return abs(n - t) / t + over * max(n - t, 0.0) / t


def _placed(head: list, totals: Mapping[str, int], total: int, subtypes: int, open_gaps: Mapping[str, float], ratios: Mapping[str, float]) -> list[tuple[str, str]]:
    """(group, split) of the head, in order, by least penalty; ties to the split with fewer groups, then rows, then by name.

    A split that a group would take over its rows is an option only where every split would be: the relative distances of small
    splits shrink first and would else overfill them. ``totals`` covers the subtypes of the head and ``subtypes`` counts all; ``open_gaps`` is the distance of an empty split over all subtypes.
    """
    state = {s: {"pairs": 0, "groups": 0, "n": Counter(), "gaps": open_gaps[s]} for s in ratios}
    out = []
    for row in head:
        options = []
        for s, ratio in ratios.items():
            own = state[s]
            change = sum(_gap(own["n"][t] + n, totals[t] * ratio, 1.0) - _gap(own["n"][t], totals[t] * ratio, 1.0) for t, n in row["subtypes"].items())
            penalty = _gap(own["pairs"] + row["num_pairs"], total * ratio, 2.0) + (own["gaps"] + change) / max(subtypes, 1)
            options.append((own["pairs"] + row["num_pairs"] > total * ratio, round(penalty, 9), own["groups"], own["pairs"], s, change))
        *_, chosen, change = min(options)
        own = state[chosen]
        own["pairs"] += row["num_pairs"]
        own["groups"] += 1
        own["n"].update(row["subtypes"])
        own["gaps"] += change
        out.append((row["group"], chosen))
    return out


def _shares(factors: list[float], ratios: list[float]) -> list[Column]:
    """Share of a stratum that goes to each split: what is open there times the split's factor, or the ratio where nothing is open."""
    open_rows = [F.get("_gaps", F.lit(i)) * F.lit(f) for i, f in enumerate(factors)]
    together = sum(open_rows[1:], open_rows[0])
    return [F.when(together > 0, x / together).otherwise(r) for x, r in zip(open_rows, ratios)]


def penalty_split(rows: DataFrame, ratios: Mapping[str, float], seed: int = 42, group: str = "image_id", subtype: str = "subtype", head: int = HEAD) -> DataFrame:
    """``(group, split, num_pairs, placed)``: no group is divided, sizes and subtype mixes follow ``ratios``.

    The ``head`` largest groups (ties in hash order) go one by one to the split of least penalty: its distance from the wanted rows, going
    over counted three times, and the mean distance from the wanted rows of each subtype, going over counted twice. The
    others come in hash order within strata of their most frequent subtype, cut at the shares still open for it.
    """
    check_ratios(ratios)
    names = list(ratios)
    counts = pinned(rows.groupBy(F.col(group).cast("string").alias("group"), F.col(subtype).alias("subtype")).agg(F.count("*").alias("n")))
    shaped = pinned(counts.groupBy("group").agg(
        F.sum("n").alias("num_pairs"), F.max_by("subtype", F.struct("n", "subtype")).alias("stratum"),
    ).withColumn("_s", seeded_key(seed, "group")))
    largest = shaped.orderBy(F.desc("num_pairs"), "_s", "group").limit(head).select("group", "num_pairs", "_s")
    # At most ``head`` rows: small enough to broadcast, and to be read here.
    own = counts.join(F.broadcast(largest), "group").groupBy("group", "num_pairs", "_s").agg(F.map_from_entries(F.collect_list(F.struct("subtype", "n"))).alias("subtypes"))
    listed = sorted(own.collect(), key=lambda r: (-r["num_pairs"], r["_s"], r["group"]))
    totals = counts.groupBy("subtype").agg(F.sum("n").alias("total"))
    met = counts.join(F.broadcast(largest.select("group")), "group", "left_semi").select("subtype").distinct()
    known = {r["subtype"]: r["total"] for r in totals.join(met, "subtype", "left_semi").collect()}
    targets = [F.greatest(F.col("total") * F.lit(float(r)), F.lit(1.0)) for r in ratios.values()]
    empty = [F.sum(F.abs(F.lit(0.0) - t) / t) for t in targets]
    total, subtypes, *gaps = totals.agg(F.sum("total"), F.count("*"), *empty).first()
    placed = _placed(listed, known, total or 0, subtypes, dict(zip(names, gaps)), ratios)
    head_rows = rows.sparkSession.createDataFrame(placed, "group string, split string")
    in_head = counts.join(F.broadcast(head_rows), "group").groupBy("subtype").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"_h{i}") for i, s in enumerate(names)])
    left = totals.join(in_head, "subtype", "left")
    gaps = [F.greatest(F.col("total") * F.lit(float(ratios[s])) - F.coalesce(F.col(f"_h{i}"), F.lit(0)), F.lit(0.0)) for i, s in enumerate(names)]
    rest = pinned(shaped.join(F.broadcast(head_rows.select("group")), "group", "left_anti"))
    sizes = rest.groupBy("stratum").agg(F.sum("num_pairs").alias("_size"))
    strata = pinned(sizes.join(left.select(F.col("subtype").alias("stratum"), F.array(*gaps).alias("_gaps")), "stratum"))
    taken = Counter()
    for row, (_, split) in zip(listed, placed):
        taken[split] += row["num_pairs"]
    wanted = [max((total or 0) * ratios[s] - taken[s], 0.0) for s in names]
    factors = [1.0] * len(names)
    for _ in range(ROUNDS):
        got = strata.agg(*[F.sum(F.col("_size") * share) for share in _shares(factors, list(ratios.values()))]).first()
        factors = [f * w / g if g else f for f, w, g in zip(factors, wanted, got)]
    running = running_sums(rest, ["stratum"], ["_s", "group"], {"_cum": F.col("num_pairs")})
    joined = running.join(strata, "stratum")
    place = F.round((F.col("_cum") - F.col("num_pairs") / 2.0) / F.col("_size"), 9)
    split, so_far = None, F.lit(0.0)
    for name, share in list(zip(names, _shares(factors, list(ratios.values()))))[:-1]:
        so_far = so_far + share
        here = place <= F.round(so_far, 9)
        split = F.when(here, name) if split is None else split.when(here, name)
    split = split.otherwise(names[-1]) if split is not None else F.lit(names[-1])
    by_stratum = joined.select("group", split.alias("split"), "num_pairs", F.lit("stratum").alias("placed"))
    by_penalty = shaped.join(F.broadcast(head_rows), "group").select("group", "split", "num_pairs", F.lit("penalty").alias("placed"))
    return by_penalty.unionByName(by_stratum).withColumnRenamed("group", group)


def split_balance(rows: DataFrame, assigned: DataFrame, ratios: Mapping[str, float], group: str = "image_id", subtype: str = "subtype", tolerance: float = 0.01) -> DataFrame:
    """One row a split: its groups and rows, its share, half the distance of its subtype mix from the mix of all rows, whether both
    are within ``tolerance`` of what was wanted, and how many of its groups stand in another split too."""
    wanted = F.create_map(*[x for s, r in ratios.items() for x in (F.lit(s), F.lit(float(r)))])
    splits = assigned.select(F.col(group).cast("string").alias("_group"), "split")
    cells = pinned(rows.select(F.col(group).cast("string").alias("_group"), F.col(subtype).alias("_subtype")).join(splits, "_group").groupBy("split", "_subtype").agg(F.count("*").alias("n")))
    overall = cells.groupBy("_subtype").agg(F.sum("n").alias("g"))
    sizes = cells.groupBy("split").agg(F.sum("n").alias("num_pairs"))
    everything = overall.agg(F.sum("g")).first()[0] or 0
    expected = cells.join(overall, "_subtype").join(sizes, "split").withColumn("all", F.lit(everything))
    # A subtype that a split lacks adds its whole share: shares sum to one, so it is what the others leave.
    shares = expected.groupBy("split", "num_pairs", "all").agg(
        F.sum(F.abs(F.col("n") / F.col("num_pairs") - F.col("g") / F.col("all"))).alias("here"), F.sum(F.col("g") / F.col("all")).alias("covered"),
    )
    mix = ((F.col("here") + 1.0 - F.col("covered")) / 2.0).alias("mix_distance")
    homes = splits.distinct().groupBy("_group").agg(F.count("*").alias("_homes"))
    groups = splits.distinct().join(homes, "_group").groupBy("split").agg(F.count("*").alias("num_groups"), F.count_if(F.col("_homes") > 1).alias("crossing"))
    out = shares.select("split", "num_pairs", (F.col("num_pairs") / F.col("all")).alias("share"), mix).join(groups, "split")
    close = F.abs(F.col("share") - F.element_at(wanted, F.col("split"))) <= tolerance
    return out.select("split", "num_groups", "num_pairs", "share", "mix_distance", close.alias("share_ok"), (F.col("mix_distance") <= tolerance).alias("mix_ok"), "crossing")
