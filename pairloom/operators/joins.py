"""Joins of predictions, labels, scene graphs, versions and experiment grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.operators.ordering import top_k


def with_baseline(rows: DataFrame, baseline: DataFrame, keys: Sequence[str], missing: str = "invalid") -> DataFrame:
    """Rows beside the prediction of their baseline (``base_pred``, ``base_score``).

    ``missing="invalid"`` keeps rows without a baseline and calls it invalid, ``"null"`` keeps them with a
    null, ``"skip"`` drops them.
    """
    extra = [c for c in ("score", "raw_output") if c in baseline.columns]
    right = baseline.select(*keys, F.col("pred").alias("base_pred"), *[F.col(c).alias(f"base_{c}") for c in extra])
    joined = rows.join(right, list(keys), "inner" if missing == "skip" else "left")
    return joined.withColumn("base_pred", F.coalesce("base_pred", F.lit("invalid"))) if missing == "invalid" else joined


def with_targets(edges: DataFrame, objects: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Edges beside the names of both ends; a dangling edge keeps a null ``object_name``. ``targets``: the objects they can point at, if others."""
    names = objects.select("image_id", F.col("object_id").alias("subject_id"), F.col("name").alias("subject_name"))
    ends = (objects if targets is None else targets).select("image_id", F.col("object_id").alias("target_id"), F.col("name").alias("object_name"))
    return edges.join(names, ["image_id", "subject_id"]).join(ends, ["image_id", "target_id"], "left")


def official_queries(queries: DataFrame, annotations: DataFrame, cap: int = 0) -> DataFrame:
    """Queries ``(category, id, query, image)`` joined with ``annotations(id, truth)``; ``reason`` says why one is skipped.

    With ``cap`` only the first so many kept queries of a category stay, by id.
    """
    keyed = queries.withColumn("question_id", F.col("id").try_cast("long"))
    joined = keyed.join(annotations.select(F.col("id").alias("question_id"), "truth", F.lit(True).alias("found")), "question_id", "left")
    label = text.yes_no(F.col("truth"))
    reason = (
        F.when(F.col("question_id").isNull(), "missing_id").when(F.col("found").isNull(), "missing_annotation")
        .when(label.isNull(), "missing_yes_no_label").when(F.coalesce(F.trim("query"), F.lit("")) == "", "missing_question")
        .when(F.coalesce(F.trim("image"), F.lit("")) == "", "missing_image")
    )
    judged = joined.select("category", "question_id", "query", "image", label.alias("label"), reason.alias("reason"))
    if not cap:
        return judged
    kept = top_k(judged.filter("reason is null"), ["category"], ["question_id"], cap, "row").drop("row")
    return kept.unionByName(judged.filter("reason is not null"))


def absent_values(present: DataFrame, vocabulary: Sequence[str], key: str = "image_id", value: str = "category") -> DataFrame:
    """Per image the sorted values of the vocabulary it lacks (``absent``) and has (``present``).

    The vocabulary is a bounded list; what an image has is at most that list, so no image meets the
    vocabulary in a cross join.
    """
    words = F.array(*map(F.lit, sorted(vocabulary)))
    return present.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("present")).withColumn("absent", F.array_except(words, "present"))


def vocabulary_of(df: DataFrame, value: str, limit: int = 20_000) -> list[str]:
    """Distinct values as a list, refused beyond ``limit``."""
    rows = [r[0] for r in df.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(value).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"vocabulary of {value} has more than {limit} values")
    return rows


def enriched(rows: DataFrame, captions: DataFrame, cache: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """Rows with the caption of their image; a cached caption takes precedence."""
    out = rows.join(captions.select(key, F.col("caption").alias("_made")), key, "left")
    if cache is None:
        return out.withColumnRenamed("_made", "caption").withColumn("cache_hit", F.lit(False))
    out = out.join(cache.select(key, F.col("caption").alias("_cached")), key, "left")
    return out.withColumns({"caption": F.coalesce("_cached", "_made"), "cache_hit": F.col("_cached").isNotNull()}).drop("_made", "_cached")


def version_diff(old: DataFrame, new: DataFrame, key: str = "row_index", value: str = "signature") -> DataFrame:
    """Rows on which two aligned versions differ, one missing side included."""
    a = old.select(key, F.col(value).alias("ours"))
    b = new.select(key, F.col(value).alias("theirs"))
    return a.join(b, key, "full").filter(~F.col("ours").eqNullSafe(F.col("theirs")))


def mismatch_table(spark: SparkSession, table: Mapping[str, Sequence[str]] = fixed.MISMATCHED_SUBTYPES) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, vs in table.items() for v in vs], "subtype string, other string")


def experiment_grid(subtypes: DataFrame, mismatches: DataFrame, seeds: Sequence[int], own_direction: bool = False) -> DataFrame:
    """Specs ``(name, subtype, direction_key, mask_key, match_type)`` to evaluate for every subtype."""
    s = F.col("subtype")
    kind = text.subtype_type(s)
    shared = F.concat(F.lit("g_"), kind, F.lit("_clean"))
    own = F.concat(F.lit("s_"), s, F.lit("_clean"))
    type_mask = F.concat(F.lit("mask_g_"), kind, F.lit("_norm_top64"))
    energy = lambda c: F.concat(F.lit("mask_s_"), c, F.lit("_energy_top64"))

    def spec(tail: Column, direction: Column, mask: Column, match: str) -> Column:
        return F.struct(
            F.concat(s, F.lit("__"), tail).alias("name"), s.alias("subtype"), direction.alias("direction_key"), mask.alias("mask_key"), F.lit(match).alias("match_type")
        )

    every = F.lit("g_all_clean")
    fixed_specs = [
        spec(F.lit("g_all__g_all_norm"), every, F.lit("mask_g_all_norm_top64"), "g_all_baseline"),
        spec(F.concat(shared, F.lit("__"), type_mask), shared, type_mask, "g_type_baseline"),
        spec(F.concat(shared, F.lit("__"), energy(s)), shared, energy(s), "matched_energy"),
        spec(F.concat(F.lit("g_all_clean__"), energy(s)), every, energy(s), "matched_energy_g_all"),
    ]
    if own_direction:
        fixed_specs.append(spec(F.concat(own, F.lit("__"), energy(s)), own, energy(s), "s_direction_ablation"))
    for seed in seeds:
        fixed_specs.append(spec(F.concat(shared, F.lit(f"__random_seed{seed}")), shared, F.lit(f"random_mask_top64_seed{seed}"), "random_mask"))
    own_rows = subtypes.select(F.inline(F.array(*fixed_specs)))
    available = subtypes.withColumnRenamed("subtype", "other")
    other = F.col("other")
    cross = subtypes.join(mismatches, "subtype").join(available, "other", "left_semi")
    return own_rows.unionByName(cross.select(spec(F.concat(shared, F.lit("__mismatch_"), other), shared, energy(other), "mismatched_energy").alias("v")).select("v.*"))
