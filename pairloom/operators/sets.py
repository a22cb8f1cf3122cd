"""Set operations: overlaps, leakage between splits, shard and result merges, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordering import first_per_group
from pairloom.operators.validate import ValidationError


def member_sets(df: DataFrame, name: str, items: Sequence[str]) -> DataFrame:
    """``(owners ARRAY, n)``: how many items each combination of names owns.

    Items are reduced to the set of their names and equal sets are counted before any two names meet, so the work
    after the first aggregate depends on the number of combinations only.
    """
    owned = df.groupBy(*items).agg(F.sort_array(F.collect_set(name)).alias("owners"))
    return owned.groupBy("owners").agg(F.count("*").alias("n"))


def overlap(df: DataFrame, name: str, items: Sequence[str]) -> DataFrame:
    """Shared items and Jaccard index for every two names (itself included); an empty union gives 0."""
    combos = member_sets(df, name, items)
    ends = combos.select("n", F.explode("owners").alias("a"), "owners").select("n", "a", F.explode("owners").alias("b"))
    both = ends.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sizes = both.filter("a = b").select(F.col("a").alias("name"), F.col("shared").alias("size"))
    # Every ordered pair of names; the list of names is what the result is made of, so it is small by definition.
    names = sizes.agg(F.collect_list(F.struct("name", "size")).alias("all")).select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    grid = names.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb"))
    joined = grid.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return joined.select("a", "b", "shared", F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("jaccard"))


def ownership(df: DataFrame, name: str, items: Sequence[str], count: str = "n") -> DataFrame:
    """Number of items per ownership pattern: ``cat only``, ``attr+cat`` and so on."""
    label = F.when(F.size("owners") == 1, F.concat(F.get("owners", F.lit(0)), F.lit(" only"))).otherwise(F.array_join("owners", "+"))
    return member_sets(df, name, items).select(label.alias("owners"), F.col("n").alias(count))


def triple_overlap(df: DataFrame, name: str, items: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Items all names share, items any has, and their ratio."""
    wanted = F.array(*map(F.lit, sorted(names)))
    c = member_sets(df.filter(F.col(name).isin(*names)), name, items)
    every = F.coalesce(F.sum(F.when(F.size(F.array_except(wanted, "owners")) == 0, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return c.agg(every.alias("all_share"), total.alias("any_has"), F.when(total > 0, every / total).otherwise(0.0).alias("jaccard"))


def prefix_overlaps(ranked: DataFrame, keys: Sequence[str], name: str, items: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(keys, k, a, b, shared, jaccard): what every two names share among their first k items, for all ``ks`` from one join.

    ``ranked`` holds items with their rank. Names meet over the items they share and, for those that share none, over their group: each name
    is one row there, and every pair of names is a row of the result.
    """
    most = ranked.filter(F.col("rank") <= max(ks))
    left = most.select(*keys, *items, F.col(name).alias("a"), F.col("rank").alias("_ra"))
    right = most.select(*keys, *items, F.col(name).alias("b"), F.col("rank").alias("_rb"))
    # A shared item belongs to every k from the worse of its two ranks on.
    met = left.join(right, [*keys, *items]).filter("a < b").groupBy(*keys, "a", "b").agg(*[F.count_if(F.greatest("_ra", "_rb") <= k).alias(f"_s{k}") for k in ks])
    sizes = most.groupBy(*keys, name).agg(*[F.count_if(F.col("rank") <= k).alias(f"_n{k}") for k in ks])
    one = sizes.select(*keys, F.col(name).alias("a"), *[F.col(f"_n{k}").alias(f"_a{k}") for k in ks])
    other = sizes.select(*keys, F.col(name).alias("b"), *[F.col(f"_n{k}").alias(f"_b{k}") for k in ks])
    grid = one.join(other, list(keys)).filter("a < b").join(met, [*keys, "a", "b"], "left")

    def at(k: int) -> Column:
        shared = F.coalesce(F.col(f"_s{k}"), F.lit(0))
        union = F.col(f"_a{k}") + F.col(f"_b{k}") - shared
        return F.struct(F.lit(k).alias("k"), shared.alias("shared"), F.when(union > 0, shared / union).otherwise(0.0).alias("jaccard"))

    return grid.select(*keys, "a", "b", F.inline(F.array(*[at(k) for k in ks])))


def leakage(rows: DataFrame, assigned: DataFrame, group: str = "image_id", split: str = "split", row_id: str = "pair_id") -> DataFrame:
    """(check, n): groups in two splits, ids lost or repeated on the way from ``rows`` to ``assigned``."""
    straddling = member_sets(assigned, split, [group]).filter(F.size("owners") > 1)
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (("test", "train"), ("test", "val"), ("train", "val"))])
    inside = F.array_contains("owners", F.col("p.x")) & F.array_contains("owners", F.col("p.y"))
    zero = assigned.sparkSession.createDataFrame([("test", "train"), ("test", "val"), ("train", "val")], "x string, y string")
    seen = straddling.withColumn("p", F.explode(pairs)).filter(inside).groupBy("p.x", "p.y").agg(F.sum("n").alias("n"))
    between = zero.join(seen, ["x", "y"], "left").select(F.concat_ws("_", F.lit("overlap"), "x", "y").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))
    before = rows.groupBy(row_id).agg(F.count("*").alias("_a"))
    after = assigned.groupBy(row_id).agg(F.count("*").alias("_b"))
    ids = before.join(after, row_id, "full").agg(
        F.count_if(F.coalesce("_b", F.lit(0)) < F.coalesce("_a", F.lit(0))).alias("missing_ids"),
        F.coalesce(F.sum(F.greatest(F.coalesce("_b", F.lit(0)) - 1, F.lit(0))), F.lit(0)).alias("duplicate_ids"),
    )
    return between.unionByName(ids.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("missing_ids", "duplicate_ids")]))))


def image_overlap(df: DataFrame, key: str, image: str = "image_id") -> DataFrame:
    """Number of images any two types share."""
    return overlap(df, key, [image]).select("a", "b", F.col("shared").alias("overlap"))


def top_jaccard(a: DataFrame, b: DataFrame, value: str, count: str, k: int) -> DataFrame:
    """Jaccard index of the k most frequent values of two versions."""
    tops = [x.orderBy(F.desc(count), value).limit(k).select(value, F.lit(n).alias("version")) for n, x in (("a", a), ("b", b))]
    return overlap(tops[0].unionByName(tops[1]), "version", [value]).filter("a = 'a' and b = 'b'").select("shared", "jaccard")


def merged_shards(shards: Sequence[DataFrame], index: str = "row_index", row_id: str = "pair_id", vec: str = "vec") -> DataFrame:
    """Union of shards after checking that indices and ids are unique and vectors of one length."""
    merged = reduce(DataFrame.unionByName, shards)
    for c in (index, row_id):
        if merged.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            raise ValidationError(f"duplicate {c} across shards")
    low, high = merged.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValidationError(f"vectors of {low} and of {high} items")
    return merged


def merged_results(parts: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of repeated (shard, file) keys: the latest version wins."""
    return first_per_group(parts, keys, [-F.col(version)])


def reconciliation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows only one table has, counting repetitions."""
    only_a, only_b = a.exceptAll(b), b.exceptAll(a)
    return only_a.agg(F.count("*").alias("n")).select(F.lit("left_only").alias("side"), "n").unionByName(
        only_b.agg(F.count("*").alias("n")).select(F.lit("right_only").alias("side"), "n")
    )
