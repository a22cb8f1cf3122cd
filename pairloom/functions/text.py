"""Text expressions: cleaning, parsing, classifying, routing and rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import fixed

# Word borders that treat accented letters as letters, so that engines with ASCII-only \b agree.
LEFT = r"(?:^|[^\p{L}\p{N}_])"
RIGHT = r"(?:$|[^\p{L}\p{N}_])"


def lookup(value: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value of a small fixed table; ``default`` (the value itself if none is given) elsewhere."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[value], value if default is None else default)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Does the text contain one of the words as a substring?"""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Does the text contain one of the words between word borders?"""
    return text.rlike(LEFT + "(?:" + "|".join(words) + ")" + RIGHT)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


# --- first present field ---------------------------------------------------------------------

def first_present(*cols: Column, default: str | None = None) -> Column:
    """First value that is neither null nor the empty string."""
    filled = [F.when(c.cast("string") != "", c.cast("string")) for c in cols]
    return F.coalesce(*filled, *([F.lit(default)] if default is not None else []))


# --- yes/no labels ---------------------------------------------------------------------------

def yes_no(value: Column, mode: str = "words", subtype: Column | None = None) -> Column:
    """Normalised yes/no label.

    ``words``: word set or prefix, else null. ``words_unknown``: same, else "unknown".
    ``prefix``: prefix only, else null. ``prefix_invalid``: same, else "invalid".
    ``dotted``: word set or ``yes.``/``no.`` prefix, then the subtype, else "unknown".
    Prefix rules also take "nothing" for no.
    """
    return let(F.lower(strip(value.cast("string"))), lambda t: _yes_no(t, mode, subtype))


def _yes_no(t: Column, mode: str, subtype: Column | None) -> Column:
    if mode in ("prefix", "prefix_invalid"):
        out = F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no")
        return F.coalesce(out, F.lit("invalid")) if mode == "prefix_invalid" else out
    if mode == "dotted":
        out = F.when(t.isin(*fixed.YES_WORDS) | t.startswith("yes."), "yes").when(t.isin(*fixed.NO_WORDS) | t.startswith("no."), "no")
        by_subtype = F.when(subtype == "cat_present", "yes").when(subtype == "cat_absent", "no") if subtype is not None else F.lit(None)
        return F.coalesce(out, by_subtype, F.lit("unknown"))
    out = (
        F.when(t.isin(*fixed.YES_WORDS), "yes").when(t.isin(*fixed.NO_WORDS), "no")
        .when(t.startswith("yes"), "yes").when(t.startswith("no"), "no")
    )
    return F.coalesce(out, F.lit("unknown")) if mode == "words_unknown" else out


def parse_answer(text: Column, mode: str, label: Column | None = None) -> Column:
    """Yes/no decision in a generated answer.

    ``token``: first word of the yes or no word set, else null. ``earliest``: first whole word yes or no.
    ``first_word``: only the first alphabetic word counts. ``contains``: depends on the label, any substring.
    The last three give "invalid" when undecided.
    """
    t = F.lower(text)
    if mode == "token":
        words = F.filter(F.split(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w.isin(*fixed.YES_WORDS, *fixed.NO_WORDS))
        first = F.get(words, F.lit(0))
        return F.when(first.isin(*fixed.YES_WORDS), "yes").when(first.isin(*fixed.NO_WORDS), "no")
    if mode == "earliest":
        hit = F.regexp_extract(t, LEFT + "(yes|no)" + RIGHT, 1)
        return F.when(hit == "", "invalid").otherwise(hit)
    if mode == "first_word":
        word = F.regexp_extract(strip(t), r"^[\s\"'`*(\[]*([a-z]+)", 1)
        return F.when(word.isin("yes", "no"), word).otherwise("invalid")
    if mode == "contains":
        return (
            F.when(label == "yes", F.when(t.contains("yes"), "yes").otherwise("no"))
            .when(label == "no", F.when(t.contains("no"), "no").otherwise("yes"))
            .otherwise("invalid")
        )
    raise ValueError(f"unknown parser {mode}")


# --- cleaning --------------------------------------------------------------------------------

# What cleaning drops, by ranges: Java matches these several times faster than [^a-z0-9\-] with its negated union.
NO_WORD = r"[\x00-/:-`{-\x{10FFFF}]+"
NO_WORD_OR_HYPHEN = r"[\x00-,./:-`{-\x{10FFFF}]+"
NO_WORD_HYPHEN_OR_SPACE = r"[\x00-\x08\x0E-\x1F!-,./:-`{-\x{10FFFF}]+"


def clean(text: Column, mode: str) -> Column:
    """``phrase``: drop punctuation. ``text``: punctuation to space. ``spaces``: lower and squeeze.

    ``entity``: punctuation to space and leading articles dropped. ``object``: trailing marks and leading
    stop words dropped. ``query``: hyphen and punctuation to space (router text).
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    if mode == "phrase":
        return squeeze(F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), NO_WORD_HYPHEN_OR_SPACE, ""))
    if mode == "text":
        return F.trim(F.regexp_replace(t, NO_WORD_OR_HYPHEN, " "))
    if mode == "spaces":
        return squeeze(t)
    if mode == "query":
        return F.trim(F.regexp_replace(t, NO_WORD, " "))
    if mode == "entity":
        # Each article is dropped at most once, in this order.
        plain = F.trim(F.regexp_replace(t, r"[^a-z0-9_-]+", " "))
        return F.regexp_replace(plain, r"^(the )?(a )?(an )?", "")
    if mode == "object":
        t = squeeze(F.regexp_replace(strip(t), r"[?.!,;:]+$", ""))
        return squeeze(F.regexp_replace(t, r"^((a|an|the|any)( |$))+", ""))
    raise ValueError(f"unknown cleaning mode {mode}")


def phrase(text: Column) -> Column:
    """:func:`clean` of mode phrase, for columns of mostly clean texts: these are left after one match."""
    return F.when(text.rlike(r"\A[a-z0-9-]+(?: [a-z0-9-]+)*\z"), text).otherwise(clean(text, "phrase"))


def _singular_tail(t: Column) -> Column:
    return F.when(t.rlike("^.{2,}ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("^.{2,}[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)


def comparable_entity(text: Column) -> Column:
    """Entity name in a form in which singular and plural compare equal."""
    return let(squeeze(F.translate(clean(text, "entity"), "_-", "  ")), _singular_tail)


def relation_key(text: Column, vocabulary: str) -> Column:
    """Relation in canonical form under one of four dictionaries: scene, clean, subtype, record."""
    if vocabulary == "scene":
        return lookup(clean(text, "phrase"), fixed.SCENE_RELATION_ALIASES)
    if vocabulary == "clean":
        return lookup(clean(text, "text"), fixed.CLEAN_RELATION_ALIASES)
    if vocabulary == "subtype":
        return lookup(clean(text, "spaces"), fixed.SUBTYPE_RELATION_ALIASES)
    if vocabulary == "record":
        t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
        return lookup(t, fixed.RECORD_RELATION_ALIASES, F.translate(t, " ", "_"))
    raise ValueError(f"unknown relation vocabulary {vocabulary}")


def clean_color(text: Column) -> Column:
    return lookup(clean(text, "text"), {"grey": "gray"})


# --- quality and buckets ---------------------------------------------------------------------

def good_name(name: Column, kind: str) -> Column:
    """Length, word-count, stop-list and letter rules for object, attribute and relation names."""
    bad, chars, words = {
        "object": (fixed.BAD_OBJECT_NAMES, 40, 5),
        "attribute": (fixed.BAD_ATTRIBUTES, 30, 3),
        "relation": (fixed.VAGUE_RELATIONS, 45, 5),
    }[kind]
    return (
        name.isNotNull() & (name != "") & ~name.isin(*bad) & (F.length(name) <= chars)
        & (F.size(F.split(name, r"\s+")) <= words) & name.rlike("[a-z]")
    )


def object_allowed(name: Column, whitelist: Sequence[str]) -> Column:
    return name.isin(*whitelist) & ~name.isin(*fixed.PART_STUFF)


def relation_usable(subject: Column, relation: Column, obj: Column) -> Column:
    """Rule for cleaned entity names: no vague relation, no relation of a thing with itself."""

    def bare(name: Column) -> Column:
        return let(squeeze(F.translate(name, "_-", "  ")), _singular_tail)

    return ~relation.isin(*fixed.RECORD_VAGUE_RELATIONS) & (subject != "") & (obj != "") & (bare(subject) != bare(obj))


def scene_relation_bucket(relation: Column) -> Column:
    r = relation_key(relation, "scene")
    return (
        F.when(r.contains("left") | r.contains("right"), "horizontal")
        .when(r.isin("above", "below", "under", "over", "beneath"), "vertical")
        .when(r.contains("front of") | (r == "behind"), "depth")
        .when(r.isin("on", "in", "inside", "attached to", "hanging from", "covering", "covered by", "sitting on", "standing on"), "contact")
        .when(any_of(r, ("holding", "wearing", "riding", "carrying", "eating", "drinking", "playing", "looking at")), "interaction")
        .otherwise("semantic")
    )


def record_relation_bucket(relation: Column) -> Column:
    out = F.when(F.lit(False), "")
    for bucket, members in fixed.RELATION_BUCKETS.items():
        out = out.when(relation.isin(*members), bucket)
    return out.otherwise("semantic")


def metadata_relation_bucket(explicit: Column, subtype: Column, relation: Column) -> Column:
    """Bucket from metadata: explicit bucket, then subtype, then the relation itself."""
    e, s = F.lower(strip(explicit)), F.lower(strip(subtype))
    r = F.regexp_replace(squeeze(F.translate(F.lower(relation), "-", " ")), " ", "_")
    by_subtype = (
        F.when(s.isin("rel_position_horizontal", "rel_horizontal", "rel_left", "rel_right"), "horizontal")
        .when(s.isin("rel_position_vertical", "rel_vertical", "rel_above", "rel_below"), "vertical")
        .when(s.isin("rel_position_depth", "rel_depth"), "depth")
        .when(s == "rel_contact", "contact").when(s == "rel_interaction", "interaction").when(s == "rel_semantic", "semantic")
    )
    by_relation = (
        F.when(r.isin("left_of", "right_of"), "horizontal").when(r.isin("above", "below"), "vertical")
        .when(r.isin("in_front_of", "behind"), "depth")
        .when(r.isin("on", "under", "near", "next_to", "touching", "direct_contact"), "contact")
        .when(r.isin("holding", "wearing", "riding", "eating", "watching", "carrying", "using"), "interaction")
        .when(r != "", "semantic").otherwise("")
    )
    return F.coalesce(F.when(e.isin(*fixed.BUCKET_ORDER), e), by_subtype, by_relation, F.lit(""))


def attribute_bucket(attr: Column) -> Column:
    return (
        F.when(attr.isin(*fixed.COLOR_ATTRIBUTES), "color").when(attr.isin(*fixed.SIZE_ATTRIBUTES), "size")
        .when(attr.isin(*fixed.MATERIAL_ATTRIBUTES), "material").when(attr.isin(*fixed.STATE_ATTRIBUTES), "state").otherwise("general")
    )


def relation_axis(value: Column) -> Column:
    t = F.translate(F.lower(strip(value)), "- ", "__")
    return (
        F.when(t.isin("left_of", "right_of", "left", "right", "to_the_left_of", "to_the_right_of"), "horizontal")
        .when(t.isin("above", "below", "top", "bottom"), "vertical").otherwise("unknown")
    )


def subtype_type(subtype: Column) -> Column:
    """attr_* -> attr, rel_* -> rel, else the part before the first underscore."""
    return F.when(subtype.startswith("attr_"), "attr").when(subtype.startswith("rel_"), "rel").otherwise(F.substring_index(subtype, "_", 1))


def benchmark_category(blob: Column) -> Column:
    t = F.lower(blob)
    return (
        F.when(any_of(t, ("exist", "object", "chair")), "existence")
        .when(any_of(t, ("attr", "attribute", "color", "colour", "count", "number")), "attribute")
        .when(any_of(t, ("relation", "spatial", "position", "left", "right", "above", "below")), "relation")
        .otherwise("other")
    )


def dataset_of_path(path: Column) -> Column:
    t = F.lower(path)
    return F.when(t.contains("gqa"), "GQA").when(t.contains("coco"), "MSCOCO").otherwise("unknown")


# --- nouns -----------------------------------------------------------------------------------

def article(noun: Column) -> Column:
    return F.when(F.substring(F.lower(strip(noun)), 1, 1).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def plural(noun: Column) -> Column:
    """Plural used by the pair renderer."""
    regular = (
        F.when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es")))
        .when(noun.rlike("[^aeiouAEIOU]y$"), F.regexp_replace(noun, "y$", "ies"))
        .otherwise(F.concat(noun, F.lit("s")))
    )
    return lookup(noun, fixed.IRREGULAR_PLURALS, regular)


def counted_noun(noun: Column, count: Column) -> Column:
    return F.when(count == 1, noun).otherwise(plural(noun))


def clean_singular(noun: Column) -> Column:
    """Singular used by the clean minimal pairs."""
    return let(clean(noun, "text"), _clean_singular)


def _clean_singular(t: Column) -> Column:
    regular = (
        F.when(t.rlike("^.{2,}ies$"), F.regexp_replace(t, "ies$", "y"))
        .when(t.rlike("(ches|shes|xes)$"), F.regexp_replace(t, "es$", ""))
        .when(t.rlike("^.{2,}[^s]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)
    )
    return lookup(t, {v: k for k, v in fixed.CLEAN_IRREGULAR_PLURALS.items()}, regular)


def clean_plural(noun: Column, count: Column | None = None) -> Column:
    return let(clean_singular(noun), lambda s: _clean_plural(s, count))


def _clean_plural(s: Column, count: Column | None) -> Column:
    regular = (
        F.when(s.rlike("(s|x|ch|sh)$"), F.concat(s, F.lit("es")))
        .when(s.rlike("[^aeiou]y$"), F.regexp_replace(s, "y$", "ies")).otherwise(F.concat(s, F.lit("s")))
    )
    many = lookup(s, fixed.CLEAN_IRREGULAR_PLURALS, regular)
    return many if count is None else F.when(count == 1, s).otherwise(many)


def scene_plural(noun: Column, count: Column) -> Column:
    """Plural of the scene-graph sets: only an s is added."""
    return F.when((count == 1) | noun.endswith("s"), noun).otherwise(F.concat(noun, F.lit("s")))


def minpair_plural(noun: Column, count: Column) -> Column:
    return (
        F.when((count == 1) | noun.endswith("s"), noun)
        .when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies")).otherwise(F.concat(noun, F.lit("s")))
    )


def number_word(count: Column, up_to: int = 6) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in fixed.NUMBER_WORDS.items() if k <= up_to for x in (k, v)])[count.cast("int")], count.cast("string"))


def looks_plural(noun: Column) -> Column:
    head = F.element_at(F.split(clean(noun, "entity"), " "), -1)
    return head.isin("people", "men", "women", "children", "teeth", "feet") | (head.endswith("s") & ~head.rlike("(ss|us)$"))


def be_for(noun: Column) -> Column:
    return F.when(looks_plural(noun), "are").otherwise("is")


# --- questions -------------------------------------------------------------------------------

def object_of_question(question: Column) -> Column:
    """Queried object of an existence question; empty when there is none."""
    head = "(?i)" + LEFT + r"(?:is|are)\s+there\s+(?:(?:a|an|the|any)\s+)?"
    first = F.regexp_extract(question, head + r"(.+?)\s+in\s+(?:the\s+)?image" + RIGHT, 1)
    second = F.regexp_extract(question, head + r"(.+?)\?", 1)
    return clean(F.coalesce(F.nullif(first, F.lit("")), second), "object")


def relation_of_question(question: Column) -> Column:
    """STRUCT<subject, relation, object> of a relation question, null when it is not one."""
    contact = r"(?i)direct contact between the (.+?) and (.+?)\?"
    spatial = (
        r"(?i)is the (.+?) (to the left of|to the right of|above|below|on|under|next to|near|behind|in front of|touching) the (.+?) in"
    )

    def part(pattern: str, i: int) -> Column:
        return strip(F.regexp_extract(question, pattern, i))

    return F.when(
        question.rlike(contact),
        F.struct(part(contact, 1).alias("subject"), F.lit("direct_contact").alias("relation"), part(contact, 2).alias("object")),
    ).when(
        question.rlike(spatial),
        F.struct(part(spatial, 1).alias("subject"), relation_key(part(spatial, 2), "record").alias("relation"), part(spatial, 3).alias("object")),
    )


def image_id_of_path(path: Column) -> Column:
    """Trailing digits of the file stem, else the stem."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.when(digits != "", digits).otherwise(stem)


def question_class(question: Column, mode: str = "substring") -> Column:
    t = F.lower(question)
    if mode == "substring":
        return (
            F.when(any_of(t, fixed.CLASS_COUNT), "count").when(any_of(t, fixed.CLASS_COLOR), "color")
            .when(any_of(t, fixed.CLASS_ACTION), "action_state").otherwise("attribute_other")
        )
    return (
        F.when(any_word(t, fixed.WORD_COUNT), "count_number").when(any_word(t, fixed.WORD_COLOR), "color")
        .when(any_word(t, fixed.WORD_ACTION), "action").when(any_word(t, fixed.WORD_STATE), "state").otherwise("other_state")
    )


def router_weights(question: Column) -> Column:
    """ARRAY<STRUCT<label, weight>> in label order: equal shares over the raised labels."""

    def words(t: Column, group: Sequence[str]) -> Column:
        return any_word(t, [w for w in group if " " not in w]) | any_of(t, [w for w in group if " " in w])

    def flags(t: Column) -> Column:
        return F.array(
            words(t, fixed.ROUTER_COUNT), words(t, fixed.ROUTER_COLOR), words(t, fixed.ROUTER_ACTION), words(t, fixed.ROUTER_SPATIAL),
            any_of(t, fixed.ROUTER_CONTACT), t.rlike(LEFT + r"(?:is|are)\s+there" + RIGHT),
        )

    def labels(f: Column) -> Column:
        count, color, action, spatial, contact, exists = (f[i] for i in range(6))
        raised = {
            "cat": exists & ~(count | color | action | spatial | contact), "attr_count": count, "attr_color": color,
            "attr_action_state": action & ~contact & ~spatial, "rel_spatial": spatial, "rel_contact_missing": contact,
        }
        hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in raised.items()]))
        return let(hits, lambda h: F.when(F.size(h) == 0, F.array(F.lit("unknown"))).otherwise(h))

    def shares(hits: Column) -> Column:
        return F.transform(hits, lambda x: F.struct(x.alias("label"), (F.lit(1.0) / F.size(hits)).alias("weight")))

    return let(clean(question, "query"), lambda t: let(flags(t), lambda f: let(labels(f), shares)))


def router_primary(weights: Column) -> Column:
    """Raised label with the highest weight, ties by fixed priority."""
    ranked = F.transform(
        weights, lambda w: F.struct(w["weight"].alias("w"), (-F.array_position(F.array(*map(F.lit, fixed.ROUTER_PRIORITY)), w["label"])).alias("p"), w["label"].alias("l"))
    )
    return F.array_max(ranked)["l"]


def rule_route(question: Column, router: str = "rule", enabled: Sequence[str] = ("cat", "attr", "rel")) -> Column:
    """ARRAY of expert names a question goes to."""
    every = F.array(*map(F.lit, enabled))
    if router == "no_filter":
        return every
    if router.startswith("force_"):
        name = router.removeprefix("force_")
        if name in enabled:
            return F.array(F.lit(name))
        family = [e for e in enabled if e == "rel" or e.startswith("rel_")]
        return F.array(*map(F.lit, family)) if name == "rel" and family else every
    if router != "rule":
        raise ValueError(f"unknown router {router}")
    t = F.lower(question)
    out = F.when(F.lit(False), every)
    for name, words in (("attr", fixed.RULE_ATTR), ("rel", fixed.RULE_REL), ("cat", fixed.RULE_CAT)):
        if name in enabled:
            out = out.when(any_of(t, words), F.array(F.lit(name)))
    return out.otherwise(every)


def question_risks(question: Column) -> Column:
    """ARRAY of reasons why a question may confuse an answer parser."""
    t = F.lower(question)
    return F.array_compact(
        F.array(
            F.when(t.contains("yes") | F.concat(F.lit(" "), t).contains(" no"), "question_contains_yes_or_no"),
            F.when(word_count(question) > 40, "long_question"),
            F.when(~strip(question).endswith("?"), "not_question_mark_terminated"),
            F.when(any_word(t, ("not", "n't", "without")), "negation_word"),
        )
    )


def word_count(text: Column) -> Column:
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+"))).cast("long")


def predicate_of(text: Column) -> Column:
    """First known predicate phrase in the text."""
    t = F.lower(text)
    out = F.when(F.lit(False), "")
    for phrase in fixed.PREDICATE_PHRASES:
        out = out.when(t.contains(phrase), phrase)
    return out.otherwise("")


# --- run names, keys, identifiers -------------------------------------------------------------

def alpha_of_name(name: Column) -> Column:
    """alpha0.5 or a-1 anywhere in a run name."""
    return F.nullif(F.regexp_extract(name, r"(?:alpha|a)([-+]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def vector_and_alpha(name: Column) -> Column:
    """STRUCT<vector, alpha> of ``<vector>_alpha<number>``; p reads as a point and m as a minus."""
    pattern = r"^(.+)_alpha([0-9pPmM.-]+)$"
    hit = name.rlike(pattern)
    number = F.translate(F.regexp_extract(name, pattern, 2), "pPmM", "..--")
    vector = F.regexp_replace(F.regexp_extract(name, pattern, 1), "__plus__", "+")
    return F.struct(
        F.when(name == "baseline", "").when(hit, vector).otherwise(name).alias("vector"),
        F.when(hit, F.coalesce(number.try_cast("double"), F.lit(0.0))).alias("alpha"),
    )


def benchmark_of_run(path: Column) -> Column:
    """Benchmark key of a ``parent/run`` path."""
    t = F.lower(path)

    def family(name: str, parts: Sequence[str]) -> Column:
        out = F.when(F.lit(False), "")
        for p in parts:
            out = out.when(t.contains(p), f"{name}_{p}")
        return out.otherwise(name)

    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), path)
    return (
        F.when(t.contains("pope"), family("pope", ("random", "popular", "adversarial")))
        .when(t.contains("amber"), family("amber", ("attribute", "existence", "relation")))
        .when(t.contains("mme"), family("mme", ("existence", "count", "color", "position")))
        .otherwise(parent)
    )


def expert_of_run(name: Column) -> Column:
    t = F.lower(name)
    out = F.when(F.lit(False), "")
    for e in ("cat_res", "attr_res", "rel_res", "global_all", "cat", "attr", "rel"):
        out = out.when(t.rlike(f"(^|[_/-]){e}([_/-]|$)"), e)
    return out.otherwise("")


def condition_key(key: Column, meta_key: Column, subtype: Column, row_id: Column) -> Column:
    made = F.to_json(F.array(F.coalesce(subtype, F.lit("")), F.coalesce(row_id, F.lit(""))))
    return F.coalesce(F.when(key != "", key), F.when(meta_key != "", meta_key), made)


def safe_name(text: Column, limit: int = 60, fallback: str = "sample") -> Column:
    s = F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), 1, limit)
    return F.when(s == "", fallback).otherwise(s)


def stable_unit(text: Column) -> Column:
    """Text to [0, 1) in steps of a thousandth, from its SHA-256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 1000) / 1000.0


# --- rendering -------------------------------------------------------------------------------

def fill(template: Column, **slots: Column) -> Column:
    """Replace every ``{slot}`` of a template."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def visual_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nPlease answer the question based on the image."))


def trusted_prompt(scene: Column, question: Column) -> Column:
    return F.concat(
        F.lit("The given image depicts the following scene: "), scene,
        F.lit("\nPlease directly answer the following question from the image description, without guessing or reasoning.\nQuestion: "),
        question,
    )


def scene_one(obj: Column) -> Column:
    return F.concat(F.lit("There is "), article(obj), F.lit(" "), clean_singular(obj), F.lit(" in the image."))


def scene_two(subject: Column, obj: Column) -> Column:
    both = F.concat(
        F.lit("There are "), article(subject), F.lit(" "), clean_singular(subject), F.lit(" and "), article(obj), F.lit(" "),
        clean_singular(obj), F.lit(" in the image."),
    )
    same = F.concat(F.lit("There are "), clean_plural(subject), F.lit(" in the image."))
    return F.when(clean(subject, "text") == clean(obj, "text"), same).otherwise(both)


def record_fact(subject: Column, relation: Column, obj: Column, negated: bool = False) -> Column:
    phrase = lookup(relation, fixed.RELATION_PHRASES, F.translate(relation, "_", " "))
    return F.concat(
        F.lit("The "), subject, F.lit(" "), be_for(subject), F.lit(" not " if negated else " "), phrase, F.lit(" the "), obj, F.lit(" in the image.")
    )


def record_question(subject: Column, relation: Column, obj: Column) -> Column:
    phrase = lookup(relation, fixed.RELATION_PHRASES, F.translate(relation, "_", " "))
    plain = F.concat(F.when(looks_plural(subject), "Are").otherwise("Is"), F.lit(" the "), subject, F.lit(" "), phrase, F.lit(" the "), obj, F.lit(" in the image?"))
    contact = F.concat(F.lit("Is there direct contact between the "), subject, F.lit(" and the "), obj, F.lit("?"))
    return F.when(relation == "direct_contact", contact).otherwise(plain)


def scene_display(relation: Column) -> Column:
    return lookup(relation, {"left of": "to the left of", "right of": "to the right of"})


def count_counter(count: Column, top: int = 5) -> Column:
    """Counter value of a count: one more, but one less at ``top``; null outside 1..top."""
    return F.when((count < 1) | (count > top), F.lit(None).cast("int")).when(count == top, count - 1).otherwise(count + 1)


def color_counter(color: Column, palette: Sequence[str] = fixed.COLOR_NEGATIVES) -> Column:
    """First palette colour that differs."""
    return F.when(color.isNotNull(), F.when(color == palette[0], palette[1]).otherwise(palette[0]))


def relation_counter(relation: Column) -> Column:
    return lookup(relation, fixed.OPPOSITE_RELATION, F.lit(None).cast("string"))


def strip_answer_prefix(answer: Column) -> Column:
    return strip(F.regexp_replace(strip(answer), r"(?i)^(yes|no)\. ", ""))


def no_object_sentence(objects: Column) -> Column:
    n = F.size(objects)
    many = F.concat(F.array_join(F.slice(objects, 1, n - 1), ", "), F.lit(", or "), F.element_at(objects, -1))
    return (
        F.when(n == 0, "The queried object is not present in the image.")
        .when(n == 1, F.concat(F.lit("There is no "), F.get(objects, F.lit(0)), F.lit(" in the image.")))
        .otherwise(F.concat(F.lit("There is no "), many, F.lit(" in the image.")))
    )
