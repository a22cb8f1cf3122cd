"""Question/answer rows and minimal pairs built from facts, scene graphs and relation records.

Every builder is a chain of joins, array picks and bounded ranks; random choices are hashes of the keys involved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.functions import geometry as geo
from pairloom.operators import absent, facts
from pairloom.operators.ordering import dealt, first_per_group, seeded_flip, seeded_key, top_k
from pairloom.operators.profile import conditional_modes, scene_sentence
from pairloom.operators.sampling import SMALL_SAMPLE, capped_selection, deduplicated, pick, share_caps, yes_no_balanced
from pairloom.session import pinned

ROW = ("row_id", "image_id", "type", "subtype", "question", "answer", "trusted_text", "subject", "object", "attribute", "relation")


def say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def under(c: Column) -> Column:
    return F.translate(c, " ", "_")


def row(**cols: Column) -> Column:
    """One question row as a struct with the common columns."""
    return F.struct(*[cols.get(c, F.lit("")).cast("string").alias(c) for c in ROW])


def unpack(df: DataFrame, *rows: Column, column: str = "r") -> DataFrame:
    """One output row per struct that is not null."""
    return df.select(F.inline(F.array_compact(F.array(*rows))))


# --- per-image questions -------------------------------------------------------------------------

def existence_rows(rows: DataFrame, vocabulary: DataFrame, seed: int = 42) -> DataFrame:
    """One present and one absent category per image from ``rows(image_id, category)`` and what can be absent, ``vocabulary(category)``."""
    image = F.col("image_id")
    index = absent.indexed(vocabulary, "category")
    images = absent.with_random(pinned(absent.presence(rows, index)), index, seed, "q")
    chosen = images.select("image_id", pick(F.col("present"), seed, "image_id").alias("p"), "q")
    p, q = F.col("p"), F.col("q")
    yes = row(
        row_id=say("cat_present_", image, "_", under(p)), image_id=image, type=F.lit("cat"), subtype=F.lit("cat_present"), answer=F.lit("yes"), subject=p,
        question=say("Is there ", text.article(p), " ", p, " in the image?"), trusted_text=say("There is ", text.article(p), " ", p, " in the image."),
    )
    no = row(
        row_id=say("cat_absent_", image, "_", under(q)), image_id=image, type=F.lit("cat"), subtype=F.lit("cat_absent"), answer=F.lit("no"), subject=q,
        question=say("Is there ", text.article(q), " ", q, " in the image?"), trusted_text=say("There is no ", q, " in the image."),
    )
    return unpack(chosen, F.when(p.isNotNull(), yes), F.when(q.isNotNull(), no))


def wrong_count(n: Column, seed: int, *key: str) -> Column:
    """A nearby count: one less or one more, for a single object two or three."""
    near = F.when(n == 1, F.array(F.lit(2), F.lit(3))).otherwise(F.array(n - 1, n + 1))
    return pick(near, seed, *key)


def count_rows(counts: DataFrame, seed: int = 42) -> DataFrame:
    """One counted category per image: question, right and wrong count."""
    keyed = counts.select("image_id", "category", F.col("n").cast("int").alias("n"), seeded_key(seed, "image_id", "category").alias("_s"))
    one = first_per_group(keyed, ["image_id"], ["_s", "category"])
    c, n, w = F.col("category"), F.col("n"), F.col("w")
    noun = text.plural(c)
    shown = one.withColumn("w", wrong_count(n, seed, "image_id"))

    def answer(k: Column) -> Column:
        return say(F.when(k == 1, "There is ").otherwise("There are "), k.cast("string"), " ", text.counted_noun(c, k), " in the image.")

    return shown.select(
        say("count_", F.col("image_id"), "_", under(c)).alias("row_id"), "image_id", F.lit("attr").alias("type"), F.lit("attr_count").alias("subtype"), c.alias("subject"),
        say("How many ", noun, " are there in the image?").alias("question"), answer(n).alias("factual"), answer(w).alias("counterfactual"), n.alias("count"), w.alias("wrong_count"),
    )


def color_rows(objects: DataFrame, seed: int = 42) -> DataFrame:
    """One coloured object per image: question, right and wrong colour."""
    keyed = objects.filter("color is not null").select("image_id", "annotation_id", "category", "color", seeded_key(seed, "image_id", "annotation_id").alias("_s"))
    one = first_per_group(keyed, ["image_id"], ["_s", "annotation_id"])
    c, wrong = F.col("category"), pick(F.array_remove(F.array(*map(F.lit, fixed.COLOR_NEGATIVES)), F.col("color")), seed, "image_id")
    return one.withColumn("w", wrong).select(
        say("color_", F.col("image_id"), "_", under(c)).alias("row_id"), "image_id", F.lit("attr").alias("type"), F.lit("attr_color").alias("subtype"), c.alias("subject"),
        say("What color is the ", c, " in the image?").alias("question"), say("The ", c, " is ", F.col("color"), ".").alias("factual"),
        say("The ", c, " is ", F.col("w"), ".").alias("counterfactual"), F.col("color").alias("color"), F.col("w").alias("wrong_color"),
    )


_SIDE = {"left_of": "left side of", "right_of": "right side of"}


def spatial_rows(annotations: DataFrame, max_rows: int = 4, seed: int = 42) -> DataFrame:
    """High-confidence relations between representatives, one yes and one no row each, an even number per image.

    ``annotations`` passed the strict hygiene and has width and height. Representatives are at most one per
    category, so the pairs of an image are bounded by the vocabulary. They are written once: they are sized up and meet each other.
    """
    reps = pinned(facts.representatives(annotations).select("image_id", "annotation_id", "category", "box", "width", "height"))

    def rule(a: Column, b: Column) -> Column:
        return geo.relation_high_confidence(a["box"], b["box"], a["width"], a["height"])

    both = facts.paired(reps, lambda a, b: ~rule(a, b).startswith("~"), ["category", "box", "width", "height"])
    ids = both.select("image_id", F.col("a.annotation_id").alias("a_id"), F.col("b.annotation_id").alias("b_id"), "a", "b")
    swap = seeded_flip(seed, "image_id", "a_id", "b_id")
    turned = ids.select("image_id", "a_id", "b_id", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    named = turned.select("image_id", "a_id", "b_id", F.col("a.category").alias("x"), F.col("b.category").alias("y"), rule(F.col("a"), F.col("b")).alias("rel"))
    kept = top_k(named, ["image_id"], [seeded_key(seed, "image_id", "a_id", "b_id"), "a_id", "b_id"], max(max_rows // 2, 0))
    x, y, rel = F.col("x"), F.col("y"), F.col("rel")
    opp = text.lookup(rel, fixed.RECORD_OPPOSITES)
    phrase = lambda r: text.lookup(r, fixed.RELATION_PHRASES)
    side = lambda r: text.lookup(r, _SIDE)
    fact = say("The ", x, " is located ", F.when(rel.isin(*_SIDE), "on the ").otherwise(""), side(rel), " the ", y, " in the image.")
    inverse = say("This means the ", y, " is ", side(opp), " the ", x, ".")

    def one(answer: str, asked: Column, trusted: Column) -> Column:
        return row(
            row_id=say("rel_", F.col("image_id"), "_", under(x), "_", rel, "_", under(y), f"_{answer}"), image_id=F.col("image_id"), type=F.lit("rel"),
            subtype=say("rel_", F.regexp_replace(rel, "_of$", "")), question=say("Is the ", x, " ", phrase(asked), " the ", y, " in the image?"), answer=F.lit(answer),
            trusted_text=trusted, subject=x, object=y, relation=rel,
        )

    return unpack(kept, one("yes", rel, say(fact, " ", inverse)), one("no", opp, say(fact, ", not ", phrase(opp), " the ", y, ". ", inverse)))


def record_rows(records: DataFrame, max_rows: int = 4, seed: int = 42, positive_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of external relation records, and counts of why records were skipped.

    ``records(record_id, image, subject, predicate, object, question, label)``; missing parts are read from the
    question. A yes record with an opposite relation also gives a no row. Per image the bucket quotas apply.
    """
    from pairloom.operators.sampling import bucket_quota

    parsed = text.relation_of_question(F.col("question"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    incomplete = blank("subject") | blank("object") | blank("predicate")
    truth = F.lower(F.coalesce("label", F.lit("")))
    read = records.withColumn("_p", F.when(incomplete, parsed)).select(
        "record_id", F.coalesce("image", F.lit("")).alias("image_id"), F.col("question").alias("given"),
        F.when(truth.isin("true", "1"), "yes").when(truth.isin("false", "0"), "no").when(truth.isin("yes", "no"), truth).otherwise("yes").alias("label"),
        text.clean(F.coalesce("_p.subject", "subject"), "entity").alias("s"), text.clean(F.coalesce("_p.object", "object"), "entity").alias("o"),
        text.relation_key(F.coalesce("_p.relation", "predicate"), "record").alias("r"),
    )
    s, o, r = F.col("s"), F.col("o"), F.col("r")
    bucket = text.record_relation_bucket(r)
    reason = (
        F.when((s == "") | (o == "") | (r == ""), "missing_fields").when(~text.relation_usable(s, r, o), say("filtered_", bucket)).when(F.col("image_id") == "", "missing_image")
    )
    judged = pinned(read.withColumns({"bucket": bucket, "reason": reason}))
    ok = judged.filter("reason is null")
    opp = text.lookup(r, fixed.RECORD_OPPOSITES, F.lit(None).cast("string"))
    yes_text, no_text = text.record_fact(s, r, o), text.record_fact(s, r, o, negated=True)
    own_text = yes_text if positive_only else F.when(F.col("label") == "yes", yes_text).otherwise(no_text)
    base_id = under(say("rel_", F.col("record_id").cast("string"), "_", s, "_", r, "_", o))
    first = row(
        row_id=base_id, image_id=F.col("image_id"), type=F.lit("rel"), subtype=text.lookup(F.col("bucket"), fixed.BUCKET_SUBTYPES), answer=F.col("label"), subject=s, object=o, relation=r,
        question=F.coalesce(F.when(F.col("given") != "", F.col("given")), text.record_question(s, r, o)), trusted_text=own_text,
    )
    turned = row(
        row_id=say(base_id, "_opposite_no"), image_id=F.col("image_id"), type=F.lit("rel"), subtype=text.lookup(text.record_relation_bucket(opp), fixed.BUCKET_SUBTYPES), answer=F.lit("no"),
        subject=s, object=o, relation=r, question=text.record_question(s, opp, o), trusted_text=yes_text if positive_only else say(yes_text, " ", text.record_fact(s, opp, o, negated=True)),
    )
    rows = unpack(ok, first, F.when((F.col("label") == "yes") & opp.isNotNull() & F.lit(max_rows > 1), turned))
    bucketed = rows.withColumn("bucket", text.record_relation_bucket(F.col("relation")))
    chosen = bucket_quota(bucketed, "image_id", "bucket", max_rows, [seeded_key(seed, "row_id"), "row_id"])
    skipped = judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return chosen.select(*ROW), skipped


def bundle(parts: Sequence[DataFrame], limit: int, rows: int = 0) -> DataFrame:
    """At most ``limit`` rows per image over several builders, earlier builders first. ``rows``: about how many the builders give."""
    tagged = [p.select(*[F.col(c) if c in p.columns else F.lit("").alias(c) for c in ROW], F.lit(i).alias("_part")) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return top_k(dealt(out, rows, "image_id"), ["image_id"], ["_part", "row_id"], limit).drop("rank", "_part")


def prompted(rows: DataFrame) -> DataFrame:
    """Add the image prompt and the text prompt of every row."""
    return rows.withColumns({"visual_prompt": text.visual_prompt(F.col("question")), "trusted_prompt": text.trusted_prompt(F.col("trusted_text"), F.col("question"))})


# --- scene-graph question sets --------------------------------------------------------------------

def clean_scene(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects with clean names and attributes, written once, relations between them, and counts of what was skipped.

    Cleaning is dear and its result is read several times by the rules for names, so it is computed once a row.
    """
    cleaned = facts.once(objects.select("image_id", "object_id", F.col("name").alias("_name"), "attributes"), text.phrase(F.col("_name")), "name")
    named = facts.once(cleaned, F.transform("attributes", text.phrase), "_clean").select("image_id", "object_id", "name", F.col("_clean").alias("attributes"))
    good = text.good_name(F.col("name"), "object")
    objs = pinned(named.filter(good).withColumn("attributes", F.sort_array(F.array_distinct(F.filter("attributes", lambda a: text.good_name(a, "attribute"))))))
    raw = facts.once(edges.withColumnRenamed("relation", "_named"), text.phrase(F.col("_named")), "_raw")
    rels = facts.once(raw, text.lookup(F.col("_raw"), fixed.SCENE_RELATION_ALIASES), "relation").select(*edges.columns)
    ok = text.good_name(F.col("relation"), "relation") & (F.coalesce("target_id", F.lit("")) != "")
    s = objs.select("image_id", F.col("object_id").alias("subject_id"), F.col("name").alias("subject"))
    o = objs.select("image_id", F.col("object_id").alias("target_id"), F.col("name").alias("object"))
    triples = rels.filter(ok).join(s, ["image_id", "subject_id"]).join(o, ["image_id", "target_id"]).filter("subject <> object")
    skipped = named.filter(~good).agg(F.count("*").alias("n")).select(F.lit("bad_object_name").alias("reason"), "n").unionByName(
        rels.filter(~ok).agg(F.count("*").alias("n")).select(F.lit("bad_relation").alias("reason"), "n")
    )
    return objs, triples, skipped


def bucketed_vocabulary(df: DataFrame, value: str, bucket: Column, least: int = 2) -> DataFrame:
    """(word, bucket): values seen ``least`` times or more, with their bucket."""
    return df.groupBy(value).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col(value).alias("word"), bucket.alias("bucket"))


def scene_existence(objs: DataFrame, vocabulary: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """Is there a ...? At most one yes and one no row per image; ``vocabulary(word)`` is what can be absent."""
    index = absent.indexed(vocabulary.select(F.col("word").alias("name")), "name")
    images = absent.with_random(pinned(absent.presence(objs, index, value="name")), index, seed, "q", value="name")
    p, q, image = F.col("p"), F.col("q"), F.col("image_id")
    chosen = images.select("image_id", pick(F.col("present"), seed, "image_id").alias("p"), "q")
    if max(targets.values()) <= SMALL_SAMPLE:
        # Images are taken by their seeded key, so only the first ones of each answer have to become rows.
        first = {a: chosen.filter(c.isNotNull()).orderBy(seeded_key(seed, "image_id"), "image_id").limit(targets.get(a, 0)) for a, c in (("yes", p), ("no", q))}
        chosen = first["yes"].unionByName(first["no"]).distinct()

    def one(name: Column, answer: str, subtype: str, trusted: Column) -> Column:
        return row(
            row_id=say("sg_", image, "_cat_", under(name), f"_{answer}"), image_id=image, type=F.lit("cat"), subtype=F.lit(subtype), answer=F.lit(answer), subject=name,
            question=say("Is there a ", name, " in the image?"), trusted_text=trusted,
        )

    rows = unpack(
        chosen, F.when(p.isNotNull(), one(p, "yes", "cat_present", say("There is a ", p, " in the image."))),
        F.when(q.isNotNull(), one(q, "no", "cat_absent", say("There is no ", q, " in the image."))),
    )
    return yes_no_balanced(rows, "image_id", "answer", targets, seed, "row_id")


def scene_attributes(objs: DataFrame, vocabulary: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """Is the ... red? One true and one false attribute per object, the first so many by seeded order."""
    image, name, p, q = F.col("image_id"), F.col("name"), F.col("p"), F.col("q")
    own = objs.filter(F.size("attributes") > 0).withColumn("p", pick(F.col("attributes"), seed, "image_id", "object_id"))
    asked = pinned(own.select("image_id", "object_id", "name", "p", F.col("attributes").alias("own"), p.alias("value"), text.attribute_bucket(p).alias("bucket")))
    both = absent.wrong_values(asked, vocabulary, seed, "image_id", "object_id").withColumnRenamed("wrong", "q")

    def one(value: Column, answer: str, trusted: Column) -> Column:
        return row(
            row_id=say("sg_", image, "_attr_", under(name), "_", under(value), f"_{answer}"), image_id=image, type=F.lit("attr"), subtype=say("attr_", text.attribute_bucket(value)),
            answer=F.lit(answer), subject=name, attribute=value, question=say("Is the ", name, " ", value, " in the image?"), trusted_text=trusted,
        )

    yes, no = one(p, "yes", say("The ", name, " is ", p, " in the image.")), one(q, "no", say("The ", name, " is not ", q, " in the image."))
    return _first_by_answer({"yes": (asked, yes), "no": (both.filter(q.isNotNull()), no)}, targets, seed)


def scene_counts(objs: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """Are there three ...? One counted name per image, right and wrong."""
    counts = objs.groupBy("image_id", "name").agg(F.count("*").cast("int").alias("n")).filter("n between 1 and 6")
    one_name = first_per_group(counts.withColumn("_s", seeded_key(seed, "image_id", "name")), ["image_id"], ["_s", "name"])
    image, name, n, w = F.col("image_id"), F.col("name"), F.col("n"), F.col("w")
    both = pinned(one_name.withColumn("w", pick(F.array_remove(F.sequence(F.lit(1), F.lit(6)), n), seed, "image_id")))
    truth = say("There are ", n.cast("string"), " ", text.scene_plural(name, n), " in the image")

    def one(k: Column, answer: str, trusted: Column) -> Column:
        return row(
            row_id=say("sg_", image, "_attr_count_", under(name), "_", k.cast("string"), f"_{answer}"), image_id=image, type=F.lit("attr"), subtype=F.lit("attr_count"), answer=F.lit(answer),
            subject=name, attribute=say("count=", k.cast("string")), question=say("Are there ", text.number_word(k), " ", text.scene_plural(name, k), " in the image?"), trusted_text=trusted,
        )

    yes, no = one(n, "yes", say(truth, ".")), one(w, "no", say(truth, ", not ", w.cast("string"), "."))
    return _first_by_answer({"yes": (both, yes), "no": (both, no)}, targets, seed)


def scene_relations(triples: DataFrame, vocabulary: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """Is the ... on the ...? A true triple, and a wrong relation (same bucket first) that the image does not hold."""
    unique = triples.select("image_id", "subject", "relation", "object").distinct()
    held = unique.groupBy("image_id", "subject", "object").agg(F.collect_set("relation").alias("held"))
    image, s, r, o, q = (F.col(c) for c in ("image_id", "subject", "relation", "object", "q"))
    key = ("image_id", "subject", "relation", "object")
    asked = unique.join(held, ["image_id", "subject", "object"]).select(*key, F.col("held").alias("own"), r.alias("value"))
    # The bucket takes many rules, so it is found once for each relation.
    buckets = pinned(facts.once(triples.select("relation").distinct(), text.scene_relation_bucket(r), "bucket"))
    asked = pinned(asked.join(buckets, "relation").select(*asked.columns, "bucket"))
    both = absent.wrong_values(asked, vocabulary, seed, *key).withColumnRenamed("wrong", "q")

    def one(rel: Column, answer: str, verb: str) -> Column:
        shown = text.scene_display(rel)
        return row(
            row_id=say("sg_", image, "_rel_", under(s), "_", under(rel), "_", under(o), f"_{answer}"), image_id=image, type=F.lit("rel"), subtype=say("rel_", text.scene_relation_bucket(rel)),
            answer=F.lit(answer), subject=s, object=o, relation=rel, question=say("Is the ", s, " ", shown, " the ", o, " in the image?"),
            trusted_text=say("The ", s, f" {verb} ", shown, " the ", o, " in the image."),
        )

    return _first_by_answer({"yes": (asked, one(r, "yes", "is")), "no": (both.filter(q.isNotNull()), one(q, "no", "is not"))}, targets, seed)


def _first_by_answer(answers: Mapping[str, tuple[DataFrame, Column]], targets: Mapping[str, int], seed: int) -> DataFrame:
    """The first so many rows of each answer by seeded order, from what each asks about and its row as a struct.

    A row's id decides, so the rest of a row is put together for those taken only; no answer sorts all its rows while its number is small.
    """
    out = None
    for answer, (asked, made) in answers.items():
        keyed = asked.withColumn("_id", made["row_id"]).withColumn("_s", seeded_key(seed, "image_id", "_id"))
        n = targets.get(answer, 0)
        if n <= SMALL_SAMPLE:
            kept = keyed.orderBy("_s", "_id").limit(n)
        else:
            kept = top_k(keyed.withColumn("_a", F.lit(answer)), ["_a"], ["_s", "_id"], n, "_r")
        part = unpack(kept, made)
        out = part if out is None else out.unionByName(part)
    return out


def scene_questions(objects: DataFrame, edges: DataFrame, targets: Mapping[str, int], seed: int = 42) -> DataFrame:
    """All three types of scene-graph questions, balanced and deduplicated."""
    objs, triples, _ = clean_scene(objects, edges)
    triples = pinned(triples)
    names = bucketed_vocabulary(objs, "name", F.lit(""))
    attrs = bucketed_vocabulary(objs.select(F.explode("attributes").alias("a")), "a", text.attribute_bucket(F.col("a")))
    rels = bucketed_vocabulary(triples, "relation", text.scene_relation_bucket(F.col("relation")))
    parts = [scene_existence(objs, names, targets, seed), scene_counts(objs, targets, seed), scene_attributes(objs, attrs, targets, seed), scene_relations(triples, rels, targets, seed)]
    rows = parts[0].select(*ROW)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*ROW))
    signature = ["image_id", "type", "subtype", "question", "answer", "trusted_text", "subject", "object", "attribute", "relation"]
    return deduplicated(rows, signature, "row_id", ["row_id", "question"])


# --- minimal pairs --------------------------------------------------------------------------------

PAIR = ("pair_id", "image_id", "expert_type", "subtype", "base_scene", "fact", "counterfact", "true_question", "false_question", "true_key", "false_key")
BALANCE = ("b_object", "b_subject", "b_value", "b_predicate")


def pair(df: DataFrame, condition: Sequence[Column | str], ends: tuple[Column, Column], balance: Mapping[str, Column] | None = None, **cols: Column) -> DataFrame:
    """Candidates in the common layout; the condition keys are JSON arrays that end with the queried value."""
    parts = [F.lit(c) if isinstance(c, str) else c.cast("string") for c in condition]
    keys = {"true_key": F.to_json(F.array(*parts, ends[0].cast("string"))), "false_key": F.to_json(F.array(*parts, ends[1].cast("string")))}
    shown = {**cols, **keys}
    none = F.lit(None).cast("string")
    return df.select(*[shown[c].cast("string").alias(c) for c in PAIR], *[(balance or {}).get(c[2:], none).cast("string").alias(c) for c in BALANCE])


def flatten(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: the question about the fact and the one about the counterfact."""
    def half(answer: str, question: str, key: str) -> Column:
        return F.struct(
            say(F.col("pair_id"), f"_{answer}").alias("row_id"), F.col("pair_id"), F.col("image_id"), F.col("expert_type"), F.col("subtype"), F.col(question).alias("question"),
            F.lit(answer).alias("answer"), say(F.col("base_scene"), " ", F.col("fact")).alias("fact_text"), say(F.col("base_scene"), " ", F.col("counterfact")).alias("counterfact_text"),
            F.col(key).alias("condition_key"),
        )

    return pairs.select(F.inline(F.array(half("yes", "true_question", "true_key"), half("no", "false_question", "false_key"))))


def clean_color_pairs(objs: DataFrame, seed: int = 42) -> DataFrame:
    """Colour of a whitelisted object against one of the four other colours most common for it."""
    colored = objs.filter(text.object_allowed(F.col("name"), fixed.COLOR_OBJECTS)).select(
        "image_id", "object_id", "name", F.explode(F.array_distinct(F.filter(F.transform("attributes", text.clean_color), lambda c: c.isin(*fixed.CLEAN_COLORS)))).alias("color")
    )
    modes = conditional_modes(colored, "name", "color").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "color"))).alias("m"))
    joined = colored.join(modes, "name")
    usual = F.array_remove(F.transform("m", lambda x: x["color"]), F.col("color"))
    any_color = F.array_remove(F.array(*map(F.lit, fixed.CLEAN_COLORS)), F.col("color"))
    options = F.slice(F.when(F.size(usual) > 0, usual).otherwise(any_color), 1, 4)
    ready = joined.withColumn("counter", pick(options, seed, "image_id", "object_id", "color")).withColumn("one", text.clean_singular(F.col("name")))
    name, one, c, w = (F.col(x) for x in ("name", "one", "color", "counter"))
    return pair(
        ready, ["attr_color_clean", name, c, w], (c, w), {"object": name, "value": c, }, expert_type=F.lit("attr"), subtype=F.lit("attr_color_clean"), image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", F.lit("attr_color_clean"), "image_id", "object_id", c, w), base_scene=text.scene_one(name), fact=say("The ", one, " is ", c, "."),
        counterfact=say("The ", one, " is ", w, "."), true_question=say("Is the ", one, " ", c, "?"), false_question=say("Is the ", one, " ", w, "?"),
    )


def clean_count_pairs(objs: DataFrame) -> DataFrame:
    """Counts one to four of a whitelisted object against one more (four against three)."""
    counts = objs.filter(text.object_allowed(F.col("name"), fixed.COUNT_OBJECTS)).groupBy("image_id", "name").agg(F.count("*").cast("int").alias("n")).filter("n between 1 and 4")
    name, n, w = F.col("name"), F.col("n"), F.col("w")
    ready = counts.withColumn("w", F.when(n < 4, n + 1).otherwise(3))

    def sentence(k: Column, ask: bool) -> Column:
        verb = F.when(k == 1, "Is there one " if ask else "There is one ").otherwise(say("Are there " if ask else "There are ", text.number_word(k, 4), " "))
        return say(verb, text.clean_plural(name, k), " in the image", "?" if ask else ".")

    return pair(
        ready, ["attr_count_clean", name, n, w], (n, w), {"object": name, "value": n.cast("string")}, expert_type=F.lit("attr"), subtype=F.lit("attr_count_clean"), image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", F.lit("attr_count_clean"), "image_id", under(name), n.cast("string"), w.cast("string")),
        base_scene=say("The image contains ", text.clean_plural(name), "."), fact=sentence(n, False), counterfact=sentence(w, False), true_question=sentence(n, True), false_question=sentence(w, True),
    )


VALUE_PAIRS = {
    "attr_state_clean": (fixed.STATE_PAIRS, fixed.STATE_OBJECTS, ""), "attr_material_clean": (fixed.MATERIAL_PAIRS, fixed.MATERIAL_OBJECTS, "made of "),
    "attr_shape_clean": (fixed.SHAPE_PAIRS, fixed.SHAPE_OBJECTS, ""), "attr_action_single_clean": (fixed.ACTION_PAIRS, fixed.ACTION_OBJECTS, ""),
}


def clean_value_pairs(objs: DataFrame, subtype: str) -> DataFrame:
    """State, material, shape or action of a whitelisted object against the value paired with it."""
    table, whitelist, made = VALUE_PAIRS[subtype]
    material = subtype == "attr_material_clean"
    values = F.transform("attributes", lambda a: text.lookup(a, fixed.MATERIAL_ALIASES)) if material else F.col("attributes")
    known = objs.filter(text.object_allowed(F.col("name"), whitelist)).select(
        "image_id", "object_id", "name", F.explode(F.array_distinct(F.filter(values, lambda x: x.isin(*table)))).alias("v")
    ).withColumns({"w": text.lookup(F.col("v"), table), "one": text.clean_singular(F.col("name"))})
    shown = (lambda c: text.lookup(c, {"wooden": "wood"})) if material else (lambda c: c)
    name, one, v, w = (F.col(c) for c in ("name", "one", "v", "w"))
    return pair(
        known, [subtype, name, v, w], (v, w), {"object": name, "value": v}, expert_type=F.lit("attr"), subtype=F.lit(subtype), image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", F.lit(subtype), "image_id", "object_id", v, w), base_scene=text.scene_one(name), fact=say("The ", one, f" is {made}", shown(v), "."),
        counterfact=say("The ", one, f" is {made}", shown(w), "."), true_question=say("Is the ", one, f" {made}", shown(v), "?"), false_question=say("Is the ", one, f" {made}", shown(w), "?"),
    )


BOX_SUBTYPES = {"horizontal": "rel_left_right_clean", "vertical": "rel_above_below_clean"}


def clean_box_pairs(objs: DataFrame, *axes: str) -> DataFrame:
    """Left/right or above/below of two whitelisted objects with a clear centre margin; objects meet once for all ``axes``.

    A margin is clear along one axis only, so a pair has one relation at most.
    """
    def rule(a: Column, b: Column) -> Column:
        return F.coalesce(*[geo.relation_by_margin(a["box"], b["box"], a["width"], a["height"], axis) for axis in axes])

    allowed = objs.filter(text.object_allowed(F.col("name"), fixed.REL_OBJECTS))
    both = facts.paired(allowed, lambda a, b: (a["name"] != b["name"]) & rule(a, b).isNotNull(), ["name", "box", "width", "height"], ordered=True, key="object_id")
    named = both.select(
        "image_id", F.col("a.object_id").alias("ai"), F.col("b.object_id").alias("bi"), F.col("a.name").alias("s"), F.col("b.name").alias("o"),
        text.clean_singular(F.col("a.name")).alias("s1"), text.clean_singular(F.col("b.name")).alias("o1"), rule(F.col("a"), F.col("b")).alias("r"),
    ).withColumn("w", text.relation_counter(F.col("r")))
    s, o, s1, o1, r, w = (F.col(c) for c in ("s", "o", "s1", "o1", "r", "w"))
    across = r.isin("left of", "right of")
    subtype = F.when(across, BOX_SUBTYPES["horizontal"]).otherwise(BOX_SUBTYPES["vertical"])

    def shown(c: Column) -> Column:
        return F.when(across, say("to the ", F.substring_index(c, " ", 1), " of")).otherwise(c)

    return pair(
        named, [subtype, s, o, r, w], (r, w), {"subject": s, "object": o, "predicate": r}, expert_type=F.lit("rel"), subtype=subtype, image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", subtype, "image_id", "ai", "bi", under(r)), base_scene=text.scene_two(s, o), fact=say("The ", s1, " is ", shown(r), " the ", o1, "."),
        counterfact=say("The ", s1, " is ", shown(w), " the ", o1, "."), true_question=say("Is the ", s1, " ", shown(r), " the ", o1, "?"),
        false_question=say("Is the ", s1, " ", shown(w), " the ", o1, "?"),
    )


def clean_contact_pairs(objs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holding/wearing and sitting/riding edges against a counter predicate; and the number of dangling edges."""
    from pairloom.operators.joins import with_targets

    named = with_targets(edges, objs)
    # Only edges and ends that some counter predicate is for are joined.
    keyed = facts.once(edges, text.relation_key(F.col("relation"), "clean"), "p").filter(F.col("p").isin("wearing", "holding", "sitting on", "riding"))
    ends = {*fixed.PERSON_SUBJECTS, *fixed.SIT_RIDE_SUBJECTS}, {*fixed.WEAR_HOLD_DUAL, *fixed.HOLDING_OBJECTS, *fixed.SITTING_OBJECTS, *fixed.RIDING_OBJECTS}
    contacts = with_targets(keyed, *(objs.filter(F.col("name").isin(*sorted(e))) for e in ends))
    s, o, p = F.col("subject_name"), F.col("object_name"), F.col("p")
    person, sitter = s.isin(*fixed.PERSON_SUBJECTS), s.isin(*fixed.SIT_RIDE_SUBJECTS)
    counter = (
        F.when((p == "wearing") & person & o.isin(*fixed.WEAR_HOLD_DUAL), "holding").when((p == "holding") & person & o.isin(*fixed.HOLDING_OBJECTS), "standing beside")
        .when((p == "sitting on") & sitter & o.isin(*fixed.SITTING_OBJECTS), "standing beside").when((p == "riding") & person & o.isin(*fixed.RIDING_OBJECTS), "standing beside")
    )
    subtype = F.when(p.isin("wearing", "holding"), "rel_holding_wearing_clean").otherwise("rel_sitting_riding_clean")
    odd = text.any_of(F.concat_ws(" ", p, o, F.col("w"), o), ("wearing umbrella", "eating hat", "riding shirt", "holding ground"))
    ready = facts.some(contacts, counter, "w").filter(~odd).withColumns({"subtype": subtype, "s1": text.clean_singular(s), "o1": text.clean_singular(o)})
    w, s1, o1 = F.col("w"), F.col("s1"), F.col("o1")
    pairs = pair(
        ready, [F.col("subtype"), s, o, p, w], (p, w), {"subject": s, "object": o, "predicate": p}, expert_type=F.lit("rel"), subtype=F.col("subtype"), image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", "subtype", "image_id", "subject_id", "target_id", under(p)), base_scene=text.scene_two(s, o), fact=say("The ", s1, " is ", p, " the ", o1, "."),
        counterfact=say("The ", s1, " is ", w, " the ", o1, "."), true_question=say("Is the ", s1, " ", p, " the ", o1, "?"), false_question=say("Is the ", s1, " ", w, " the ", o1, "?"),
    )
    return pairs, named.filter("object_name is null").agg(F.count("*").alias("missing_relation_target"))


def clean_pairs(objs: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """All ten clean subtypes."""
    out = clean_color_pairs(objs, seed).unionByName(clean_count_pairs(objs))
    for subtype in VALUE_PAIRS:
        out = out.unionByName(clean_value_pairs(objs, subtype))
    return out.unionByName(clean_box_pairs(objs, *BOX_SUBTYPES)).unionByName(clean_contact_pairs(objs, edges)[0])


def selected_pairs(pairs: DataFrame, target_rows: int, seed: int = 42) -> DataFrame:
    """Per subtype at most ``target_rows / 2`` pairs that respect the object, subject, value and predicate shares."""
    target = max(1, target_rows // 2)
    caps = {f"b_{k}": c for k, c in share_caps(target).items()}
    return capped_selection(pairs, ["subtype"], caps, target, seed, ["pair_id"])


# --- subtype minimal pairs --------------------------------------------------------------------------

def strategy_pairs(rows: DataFrame, vocabulary: DataFrame, counts: DataFrame, popular: DataFrame, seed: int = 42) -> DataFrame:
    """Existence pairs with a random, a popular and a hard negative: ``rows(image_id, category)``, ``vocabulary(category)``, ``counts(image_id, counts)``,
    ``popular(category, n)``."""
    present = rows.groupBy("image_id").agg(F.sort_array(F.collect_set("category")).alias("present"))
    chosen = absent.hard_negatives(rows, vocabulary, popular, seed).join(present, "image_id").join(counts, "image_id")
    p = F.col("p")
    ready = chosen.withColumn("p", pick(F.col("present"), seed, "image_id"))

    def scene(without: Column) -> Column:
        return scene_sentence(F.map_filter("counts", lambda k, n: k != without))

    def one(kind: str, negative: Column) -> Column:
        pair_id = F.concat_ws("_", F.lit(f"cat_{kind}"), "image_id", under(p), under(negative))
        yes = F.struct(
            say(pair_id, "_yes").alias("row_id"), F.col("image_id"), F.lit(f"cat_{kind}").alias("subtype"), F.lit("yes").alias("answer"), scene(p).alias("base_scene"),
            say("Is there ", text.article(p), " ", p, " in the image?").alias("question"), say("There is ", text.article(p), " ", p, " in the image.").alias("fact"),
        )
        no = F.struct(
            say(pair_id, "_no").alias("row_id"), F.col("image_id"), F.lit(f"cat_{kind}").alias("subtype"), F.lit("no").alias("answer"), scene(negative).alias("base_scene"),
            say("Is there ", text.article(negative), " ", negative, " in the image?").alias("question"), say("There is no ", negative, " in the image.").alias("fact"),
        )
        return F.array(yes, no)

    return ready.select(F.inline(F.concat(*[one(k, F.col(f"{k}_negative")) for k in ("random", "popular", "hard")])))


def offset_pairs(objs: DataFrame) -> DataFrame:
    """Spatial pairs by pixel offset between differently named objects."""
    both = facts.paired(
        objs, lambda a, b: (a["name"] != b["name"]) & geo.relation_by_offset(a["box"], b["box"]).isNotNull(), ["name", "box"], key="object_id"
    ).select("image_id", F.col("a.object_id").alias("ai"), F.col("b.object_id").alias("bi"), F.col("a.name").alias("s"), F.col("b.name").alias("o"), geo.relation_by_offset(F.col("a.box"), F.col("b.box")).alias("r"))
    return _relation_pairs(both.withColumn("w", text.relation_counter(F.col("r"))), "rel_spatial")


def contact_pairs(objs: DataFrame, edges: DataFrame) -> DataFrame:
    """Contact edges between differently named objects against their counter relation."""
    from pairloom.operators.joins import with_targets

    named = with_targets(edges, objs).withColumn("r", text.relation_key(F.col("relation"), "subtype")).filter("object_name is not null and object_name <> subject_name")
    known = facts.some(named, text.lookup(F.col("r"), fixed.CONTACT_COUNTERS, F.lit(None).cast("string")), "w")
    return _relation_pairs(known.withColumnsRenamed({"subject_id": "ai", "target_id": "bi", "subject_name": "s", "object_name": "o"}), "rel_contact")


def _relation_pairs(named: DataFrame, subtype: str) -> DataFrame:
    s, o, r, w = (F.col(c) for c in ("s", "o", "r", "w"))
    lo, hi = F.least(s, o), F.greatest(s, o)
    scene = say("There are ", text.article(lo), " ", lo, ", and ", text.article(hi), " ", hi, " in the image.")
    return pair(
        named, [subtype, s, o, r, w], (r, w), {"subject": s, "object": o, "predicate": r}, expert_type=F.lit("rel"), subtype=F.lit(subtype), image_id=F.col("image_id"),
        pair_id=F.concat_ws("_", F.lit(subtype), "image_id", "ai", under(r), "bi"), base_scene=scene, fact=say("The ", s, " is ", r, " the ", o, " in the image."),
        counterfact=say("The ", s, " is ", w, " the ", o, " in the image."), true_question=say("Is the ", s, " ", r, " the ", o, " in the image?"),
        false_question=say("Is the ", s, " ", w, " the ", o, " in the image?"),
    )


def caption_rows(rows: DataFrame, captions: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Rows beside the caption of their image and the sentence that answers their question."""
    from pairloom.operators.joins import enriched

    joined = enriched(rows, captions, cache)
    objects = F.filter(F.array("subject", "object"), lambda x: F.coalesce(x, F.lit("")) != "")
    fact = F.concat(F.regexp_replace(F.col("trusted_text"), r"\.+$", ""), F.lit("."))
    negative = (F.col("answer") == "no") & F.col("type").isin("cat", "attr")
    return joined.withColumn("query_caption", F.when(negative, text.no_object_sentence(objects)).when(F.coalesce("trusted_text", F.lit("")) != "", fact).otherwise(F.col("caption")))
