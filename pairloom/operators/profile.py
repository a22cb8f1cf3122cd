"""Counts of data sets: profiles, vocabularies, stage and split statistics, audits and fingerprints of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.operators.ordering import dealt, global_rank, top_k
from pairloom.session import pinned


def image_profile(pairs: DataFrame, subtypes: Sequence[str], order: str) -> DataFrame:
    """Rows per image, in all and per subtype, with the lowest order value."""
    per = [F.count_if(F.col("subtype") == s).alias(f"n_{s}") for s in subtypes]
    return pairs.groupBy("image_id").agg(F.count("*").alias("num_pairs"), *per, F.min(order).alias("first"))


def first_categories(objects: DataFrame, name: str = "category", order: str = "annotation_id") -> DataFrame:
    """Categories of an image in order of first appearance; repeated ones are reduced before they meet."""
    first = objects.groupBy("image_id", name).agg(F.min(order).alias("_o"))
    listed = F.sort_array(F.collect_list(F.struct("_o", name)))
    return first.groupBy("image_id").agg(F.transform(listed, lambda x: x[name]).alias("categories"))


def supported_values(df: DataFrame, value: str, least: int = 2) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def top_values(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per group, ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return top_k(counts, list(keys), [-F.col("n"), F.col(value)], k)


def conditional_modes(df: DataFrame, given: str, value: str) -> DataFrame:
    """Frequency of every value given another column, with its rank (most frequent first, ties by value)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(given, value).agg(F.count("*").alias("n"))
    ordered = pinned(counts.withColumn("_n", -F.col("n")))
    return global_rank(ordered.filter(F.col(given).isNotNull()), [given], ["_n", value], "rank").drop("_n")


def grouped_counts(df: DataFrame, sets: Sequence[Sequence[str]], distinct: str | None = None) -> DataFrame:
    """One scan for several groupings: columns outside a grouping are null, ``level`` numbers it."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    aggs = [F.count("*").alias("n")]
    if distinct is not None:
        aggs.append(F.countDistinct(distinct).alias("distinct_n"))
    level = F.grouping_id().alias("level")
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(level, *aggs).select("level", *columns, *[a for a in ("n", "distinct_n")][: len(aggs)])


def template_of(template: Column, meta_template: Column, shell: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in (template, meta_template, shell)], F.lit("__missing_template__"))


def grammar_hits(rows: DataFrame, columns: Sequence[str], patterns: Sequence[str] = fixed.GRAMMAR_PATTERNS) -> DataFrame:
    """(pattern, n): rows whose texts contain a pattern, ignoring case."""
    joined = F.lower(F.concat_ws(" ", *columns))
    hits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(joined, F.lower(p)))
    return rows.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def mention_share(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], words: Sequence[str] = fixed.PART_STUFF) -> DataFrame:
    """Rows with words at all, rows that mention one of ``words``, and their ratio."""
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit("([a-z][a-z_-]+)"), F.lit(1))
    flagged = rows.select(*keys, F.size(tokens).alias("_t"), F.arrays_overlap(tokens, F.array(*map(F.lit, words))).alias("_f"))
    total, hit = F.count_if(F.col("_t") > 0), F.count_if("_f")
    return flagged.groupBy(*keys).agg(total.alias("total"), hit.alias("flagged"), F.when(total > 0, hit / total).otherwise(0.0).alias("ratio"))


def number_words(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(word, n): rows that contain a number word between word borders."""
    words = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    joined = F.lower(F.concat_ws(" ", *columns))
    hits = F.array_compact(F.array(*[F.when(text.any_word(joined, [w]), F.lit(w)) for w in words]))
    return rows.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def duplicate_questions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def risk_counts(rows: DataFrame, keys: Sequence[str], question: str) -> DataFrame:
    return rows.select(*keys, F.explode(text.question_risks(F.col(question))).alias("risk")).groupBy(*keys, "risk").agg(F.count("*").alias("n"))


def imbalance_warnings(counts: DataFrame, group: str, value: str, limit: float) -> DataFrame:
    """Groups whose largest and smallest value counts (of those present) differ by more than ``limit`` times."""
    return counts.groupBy(group).agg((F.max("n") / F.min("n")).alias("ratio"), F.count("*").alias("values")).filter((F.col("values") >= 2) & (F.col("ratio") > limit)).drop("values")


def captions(rows: DataFrame, order: str, limit: int = 24, types: Sequence[str] = ("cat", "attr", "rel"), expected: int = 0) -> DataFrame:
    """``(image_id, caption)``: distinct facts in type order, the first ``limit`` of them.

    An image keeps ``limit + 1`` facts before they are put together, so the array is bounded whatever its size. ``expected``: about how
    many facts there are, where they are many. They are dealt by image and sentence first, so a large image is spread over shares.
    """
    place = F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)])[F.col("type")]
    sentence = F.concat(F.regexp_replace(F.trim("fact"), r"\.+$", ""), F.lit("."))
    ready = rows.filter(F.col("type").isin(*types) & (F.coalesce(F.trim("fact"), F.lit("")) != ""))
    placed = dealt(ready.select("image_id", sentence.alias("sentence"), place.alias("p"), F.col(order).alias("o")), expected, "image_id", "sentence")
    unique = placed.groupBy("image_id", "sentence").agg(F.min(F.struct("p", "o")).alias("at"))
    kept = top_k(dealt(unique, expected, "image_id"), ["image_id"], ["at", "sentence"], limit + 1, "r")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"])
    grouped = kept.groupBy("image_id").agg(ordered.alias("s"))
    more = F.when(F.size("s") > limit, F.array(F.lit("Additional annotated visual facts are present."))).otherwise(F.array().cast("array<string>"))
    return grouped.select("image_id", F.array_join(F.concat(F.slice("s", 1, limit), more), " ").alias("caption"))


def scene_sentence(counts: Column, limit: int = 8) -> Column:
    """The most frequent categories of a MAP<category, n> as sentences, ties by name."""
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    said = F.transform(
        F.slice(entries, 1, limit),
        lambda e: F.concat(
            F.lit("There "), F.when(e["n"] == -1, "is ").otherwise("are "), text.number_word(-e["n"], 5), F.lit(" "), text.minpair_plural(e["k"], -e["n"]), F.lit(" in the image")
        ),
    )
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ". "), F.lit("."))).otherwise("The image contains visible objects.")


def word_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many texts of every group have how many words: ``(keys, words, n)``; null and blank texts have none."""
    return df.groupBy(*keys, text.word_count(F.coalesce(F.col(value), F.lit(""))).alias("words")).agg(F.count("*").alias("n"))


def image_counts(stages: Mapping[str, DataFrame], image: str = "image_id") -> DataFrame:
    """Per stage, how many images have how many rows: ``(stage, rows, images)``."""
    out = None
    for name, df in stages.items():
        own = df.groupBy(image).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("images")).select(F.lit(name).alias("stage"), "rows", "images")
        out = own if out is None else out.unionByName(own)
    return out


def first_images(df: DataFrame, by: str, n: int = 5, image: str = "image_id") -> DataFrame:
    """Rows per (image, ``by``) of the first ``n`` images by name."""
    chosen = df.select(image).distinct().orderBy(image).limit(n)
    return df.join(F.broadcast(chosen), image, "left_semi").groupBy(image, by).agg(F.count("*").alias("n"))
