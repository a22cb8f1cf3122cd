"""Template and negative-candidate banks: building, validating, choosing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators.ordering import top_k

MIN_CANDIDATES = 5


def template_bank(spark: SparkSession) -> DataFrame:
    """``templates(subtype, pos, template_id, text_source, q_template, r_template)``, pos from 0 in each subtype."""
    seen: dict[str, int] = {}
    rows = []
    for subtype, template_id, question, response in fixed.TEMPLATES:
        pos = seen.get(subtype, 0)
        seen[subtype] = pos + 1
        rows.append((subtype, pos, template_id, "template", question, response))
    return spark.createDataFrame(rows, "subtype string, pos int, template_id string, text_source string, q_template string, r_template string")


def upgrade_templates(bank: DataFrame) -> DataFrame:
    """Rewrite the old count layout, which used the plural where the counted noun belongs."""
    old = (F.col("subtype") == "cnt") & ~F.col("r_template").contains("{obj_count}")
    fixed_slot = F.when(old, F.replace("r_template", F.lit("{obj_pl}"), F.lit("{obj_count}"))).otherwise(F.col("r_template"))
    plain = (F.col("subtype") == "cnt") & (fixed_slot == "There are {count} {obj_count} in the scene.")
    return bank.withColumn("r_template", F.when(plain, "The scene contains {count} {obj_count}.").otherwise(fixed_slot))


def template_violations(bank: DataFrame) -> DataFrame:
    """(template_id, rule, detail) for every broken rule of a template bank."""
    upgraded = upgrade_templates(bank)
    slots = F.create_map(*[x for k, v in fixed.TEMPLATE_SLOTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    targets = F.create_map(*[F.lit(x) for kv in fixed.TARGET_SLOT.items() for x in kv])

    def used(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"\{([a-z0-9_]+)\}"), F.lit(1)))

    shaped = upgraded.select(
        "subtype", "template_id", "text_source", slots[F.col("subtype")].alias("allowed"), targets[F.col("subtype")].alias("target"),
        F.array_union(used("q_template"), used("r_template")).alias("all_used"), used("r_template").alias("r_used"),
        F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("template_id", "text_source", "q_template", "r_template")])).alias("missing"),
    )

    def broken(when: Column, rule: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

    illegal, absent = F.array_except("all_used", "allowed"), F.array_except("allowed", "all_used")
    rules = F.array_compact(F.array(
        broken(F.col("allowed").isNull(), "unknown_subtype", F.col("subtype")),
        broken(F.size("missing") > 0, "missing_keys", F.array_join("missing", ", ")),
        broken(~F.col("text_source").isin("template", "gqa"), "text_source", F.col("text_source")),
        broken(F.size(illegal) > 0, "illegal_placeholders", F.array_join(F.sort_array(illegal), ", ")),
        broken(F.size(absent) > 0, "missing_placeholders", F.array_join(F.sort_array(absent), ", ")),
        broken(~F.array_contains("r_used", F.col("target")), "target_slot", F.col("target")),
    ))
    own = shaped.select("template_id", F.explode(rules).alias("v")).select("template_id", "v.rule", "v.detail")
    twice = upgraded.groupBy("template_id").agg(F.count("*").alias("n")).filter("n > 1")
    return own.unionByName(twice.select("template_id", F.lit("duplicate_id").alias("rule"), F.col("n").cast("string").alias("detail")))


def candidate_pool(
    vocabulary: DataFrame,
    n: int = 10,
    seeds: DataFrame | None = None,
    fallbacks: DataFrame | None = None,
) -> DataFrame:
    """Ordered negative candidates ``(category, pos, candidate)``, best first, at most ``n`` each.

    ``vocabulary(category, semantic_group, supercategory, pos)``; ``seeds(category, candidate, pos)``;
    ``fallbacks(semantic_group, other_group, pos)``. Tiers: seeds, same group, same supercategory, fallback
    groups, everything. A tier never contributes more than ``2n + 1`` per category, which is all that can be
    needed, so no category meets the whole vocabulary.
    """
    reach = 2 * n + 1

    def tier(df: DataFrame, number: Column | int) -> DataFrame:
        t = F.lit(number) if isinstance(number, int) else number
        return df.select("category", "candidate", F.struct(t.alias("t"), F.col("pos").alias("p")).alias("place"))

    others = vocabulary.select(F.col("category").alias("candidate"), "semantic_group", "supercategory", "pos")
    mine = vocabulary.select("category", "semantic_group", "supercategory")
    by_group = top_k(others, ["semantic_group"], ["pos"], reach).drop("rank", "supercategory")
    by_super = top_k(others, ["supercategory"], ["pos"], reach).drop("rank", "semantic_group")
    pools = [tier(mine.join(by_group, "semantic_group"), 1), tier(mine.join(by_super, "supercategory"), 2)]
    if seeds is not None:
        pools.append(tier(seeds, 0))
    if fallbacks is not None:
        far = fallbacks.select("semantic_group", "other_group", F.col("pos").alias("place_of_group"))
        linked = mine.join(far, "semantic_group").join(by_group.withColumnRenamed("semantic_group", "other_group"), "other_group")
        pools.append(tier(linked, F.col("place_of_group") + 3))
    first = others.select("candidate", "pos").orderBy("pos").limit(reach).collect()
    if first:
        place = vocabulary.schema["pos"].dataType
        filler = F.array(*[F.struct(F.lit(r["candidate"]).alias("candidate"), F.lit(r["pos"]).cast(place).alias("pos")) for r in first])
        pools.append(tier(mine.select("category", F.inline(filler)), 1_000_000))
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    named = pool.filter((F.trim("candidate") != "") & (F.col("candidate") != F.col("category")))
    unique = named.groupBy("category", "candidate").agg(F.min("place").alias("place"))
    return top_k(unique, ["category"], ["place"], n, "pos").select("category", F.col("pos") - 1, "candidate").toDF("category", "pos", "candidate")


def bank_arrays(pool: DataFrame) -> DataFrame:
    """``bank(category, candidates ARRAY)`` in pool order."""
    items = F.sort_array(F.collect_list(F.struct("pos", "candidate")))
    return pool.groupBy("category").agg(F.transform(items, lambda x: x["candidate"]).alias("candidates"))


def bank_violations(bank: DataFrame) -> DataFrame:
    """(category, rule) for broken entries of ``bank(category, candidates, semantic_group, supercategory)``."""
    rules = F.array_compact(F.array(
        F.when(F.coalesce(F.size("candidates"), F.lit(0)) < MIN_CANDIDATES, "too_few"),
        F.when(F.size(F.array_distinct("candidates")) < F.size("candidates"), "duplicates"),
        F.when(F.array_contains("candidates", F.col("category")), "contains_itself"),
        F.when(F.coalesce(F.trim("semantic_group"), F.lit("")) == "", "no_semantic_group"),
        F.when(F.coalesce(F.trim("supercategory"), F.lit("")) == "", "no_supercategory"),
    ))
    return bank.select("category", F.explode(rules).alias("rule"))


def first_admissible(candidates: Column, visible: Column, own: Column) -> Column:
    """First candidate that is not visible, else the first that is not the category itself."""
    other = F.filter(candidates, lambda c: c != own)
    unseen = F.filter(other, lambda c: ~F.array_contains(visible, c))
    return F.coalesce(F.get(unseen, F.lit(0)), F.get(other, F.lit(0)))
