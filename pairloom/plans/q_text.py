"""Text functions (sections B1-B7, B18, B19, H1, H3-H15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.functions import geometry as geo
from pairloom.operators import facts, profile
from pairloom.plans.bind import Tables
from pairloom.plans.registry import query


def case(column: str, table: dict[str, str], default: str) -> str:
    """A lookup table as SQL CASE."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


@query(
    "B1_first_present",
    "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END, ''), '?') AS value FROM documents",
)
def b1(t: Tables) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    second = F.when(F.col("doc_id") % 2 == 1, F.col("source"))
    return t.documents.select("doc_id", text.first_present(first, second, default="?").alias("value"))


@query(
    "B2_label_modes",
    r"""WITH a AS (SELECT conv_id, turn, lower(regexp_replace(CASE WHEN turn % 3 = 0 THEN ['y', ' TRUE', '0', 'nothing', 'yes.', 'No. x'][CAST(conv_id % 6 + 1 AS INTEGER)] ELSE answer END, '^\s+|\s+$', '', 'g')) AS t FROM said),
    b AS (SELECT *, CASE WHEN t IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN t IN ('no', 'n', 'false', '0') THEN 'no' WHEN starts_with(t, 'yes') THEN 'yes' WHEN starts_with(t, 'no') THEN 'no' END AS words,
      CASE WHEN starts_with(t, 'yes') THEN 'yes' WHEN starts_with(t, 'no') THEN 'no' END AS prefix,
      CASE WHEN t IN ('yes', 'y', 'true', '1') OR starts_with(t, 'yes.') THEN 'yes' WHEN t IN ('no', 'n', 'false', '0') OR starts_with(t, 'no.') THEN 'no' END AS dotted FROM a)
    SELECT conv_id, turn, words, coalesce(words, 'unknown') AS words_unknown, prefix, coalesce(prefix, 'invalid') AS prefix_invalid,
      coalesce(dotted, CASE conv_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END, 'unknown') AS dotted FROM b""",
)
def b2(t: Tables) -> DataFrame:
    sample = F.get(F.array(*map(F.lit, ("y", " TRUE", "0", "nothing", "yes.", "No. x"))), (F.col("conv_id") % 6).cast("int"))
    value = F.when(F.col("turn") % 3 == 0, sample).otherwise(F.col("answer"))
    subtype = F.get(F.array(*map(F.lit, ("cat_present", "cat_absent", "other"))), (F.col("conv_id") % 3).cast("int"))
    modes = ("words", "words_unknown", "prefix", "prefix_invalid")
    return t.said.select("conv_id", "turn", *[text.yes_no(value, m).alias(m) for m in modes], text.yes_no(value, "dotted", subtype).alias("dotted"))


@query(
    "B3_benchmark_rows",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sample_id, CAST(l_orderkey AS VARCHAR) AS image_id, question,
       CASE WHEN l_returnflag = 'A' THEN 'yes' WHEN l_returnflag = 'N' THEN 'no' END AS label FROM asked""",
)
def b3(t: Tables) -> DataFrame:
    from pairloom.sources.benchmarks import normalize_samples

    raw = t.asked.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("question_id"), F.col("l_orderkey").alias("coco_id"), F.col("question").alias("text"),
        F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "NO").otherwise("").alias("answer"),
    )
    return normalize_samples(raw).select("sample_id", "image_id", "question", "label")


SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' ')"
HEAD = "substr(text, 1, 400)"


@query(
    "B4_text_cleaning",
    rf"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, md5({SQ.format("regexp_replace(" + SQ.format("replace(t, '_', ' ')") + r", '[^a-z0-9\-\s]', '', 'g')")}) AS phrase,
      md5({SQ.format(r"regexp_replace(replace(t, '_', ' '), '[^a-z0-9\-\s]', ' ', 'g')")}) AS plain,
      md5({SQ.format(r"regexp_replace(replace(t, '-', ' '), '[^a-z0-9\s]', ' ', 'g')")}) AS query FROM d""",
)
def b4(t: Tables) -> DataFrame:
    d = F.col("text")
    return t.documents.select("doc_id", F.md5(text.clean(d, "phrase")).alias("phrase"), F.md5(text.clean(d, "text")).alias("plain"), F.md5(text.clean(d, "query")).alias("query"))


@query(
    "B4_entity_names",
    r"""WITH n AS (SELECT DISTINCT p_name, ['The ' || p_name || 's!', 'a_' || p_name, '  An  ' || upper(p_name) || ' berries', p_name || ' class'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS raw FROM part),
    e AS (SELECT raw, """ + SQ.format(r"regexp_replace(trim(lower(raw)), '[^a-z0-9\s_-]+', ' ', 'g')") + r""" AS e FROM n),
    f AS (SELECT raw, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(e, '^the ', '')), '^a ', '')), '^an ', '')) AS entity FROM e),
    g AS (SELECT raw, entity, """ + SQ.format("replace(replace(entity, '_', ' '), '-', ' ')") + r""" AS c FROM f)
    SELECT raw, entity, CASE WHEN regexp_matches(c, '^.{2,}ies$') THEN regexp_replace(c, 'ies$', 'y') WHEN regexp_matches(c, '^.{2,}[^s]s$') THEN regexp_replace(c, 's$', '') ELSE c END AS comparable FROM g""",
)
def b4_entities(t: Tables) -> DataFrame:
    n = F.col("p_name")
    forms = F.array(F.concat(F.lit("The "), n, F.lit("s!")), F.concat(F.lit("a_"), n), F.concat(F.lit("  An  "), F.upper(n), F.lit(" berries")), F.concat(n, F.lit(" class")))
    raw = t.part.select("p_name", F.get(forms, (F.col("p_partkey") % 4).cast("int")).alias("raw")).distinct()
    return raw.select("raw", text.clean(F.col("raw"), "entity").alias("entity"), text.comparable_entity(F.col("raw")).alias("comparable"))


WORDS_VIEW = r"""w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents)"""
RELATIONS = ("to the left of", "on top of", "Over", "next to", "hold", "in back of", "standing_next_to", "is eating", "front of", "direct contact", "ride")


def relation_words(t: Tables) -> DataFrame:
    """Relation phrases met in the data: one of a fixed list, or the part name."""
    phrases = F.array(*map(F.lit, RELATIONS))
    k = (F.col("l_partkey") + F.col("l_suppkey")) % 13
    return t.lines.select(F.coalesce(F.get(phrases, k.cast("int")), F.col("p_name")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))


REL_WORDS_SQL = "rw AS (SELECT coalesce([" + ", ".join(f"'{r}'" for r in RELATIONS) + "][CAST((l_partkey + l_suppkey) % 13 + 1 AS INTEGER)], p_name) AS raw, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


@query(
    "B5_B7_relations",
    "WITH " + REL_WORDS_SQL + r""", c AS (SELECT raw, n, trim(regexp_replace(replace(lower(raw), '_', ' '), '[^a-z0-9\-\s]', '', 'g')) AS p, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS q FROM rw),
    k AS (SELECT raw, n, """ + case("p", fixed.SCENE_RELATION_ALIASES, "p") + " AS scene, " + case("p", fixed.CLEAN_RELATION_ALIASES, "p") + " AS clean, " + case("lower(raw)", fixed.SUBTYPE_RELATION_ALIASES, "lower(raw)")
    + " AS subtype, " + case("q", fixed.RECORD_RELATION_ALIASES, "replace(q, ' ', '_')") + """ AS record FROM c)
    SELECT raw, n, scene, clean, subtype, record,
      CASE WHEN contains(scene, 'left') OR contains(scene, 'right') THEN 'horizontal' WHEN scene IN ('above', 'below', 'under', 'over', 'beneath') THEN 'vertical' WHEN contains(scene, 'front of') OR scene = 'behind' THEN 'depth'
        WHEN scene IN ('on', 'in', 'inside', 'attached to', 'hanging from', 'covering', 'covered by', 'sitting on', 'standing on') THEN 'contact'
        WHEN regexp_matches(scene, 'holding|wearing|riding|carrying|eating|drinking|playing|looking at') THEN 'interaction' ELSE 'semantic' END AS scene_bucket,
      CASE """ + " ".join(f"WHEN record IN {listed(ws)} THEN '{b}'" for b, ws in fixed.RELATION_BUCKETS.items()) + """ ELSE 'semantic' END AS record_bucket,
      CASE WHEN replace(replace(lower(raw), '-', '_'), ' ', '_') IN ('left_of', 'right_of', 'left', 'right', 'to_the_left_of', 'to_the_right_of') THEN 'horizontal'
        WHEN lower(raw) IN ('above', 'below', 'top', 'bottom') THEN 'vertical' ELSE 'unknown' END AS axis FROM k""",
)
def b5(t: Tables) -> DataFrame:
    raw = F.col("raw")
    keyed = relation_words(t).select("raw", "n", *[text.relation_key(raw, v).alias(v) for v in ("scene", "clean", "subtype", "record")])
    return keyed.select("*", text.scene_relation_bucket(raw).alias("scene_bucket"), text.record_relation_bucket(F.col("record")).alias("record_bucket"), text.relation_axis(raw).alias("axis"))


@query(
    "B6_B7_word_quality",
    "WITH " + WORDS_VIEW + f"""
    SELECT w, CASE WHEN w <> '' AND w NOT IN {listed(fixed.BAD_OBJECT_NAMES)} AND length(w) <= 40 AND regexp_matches(w, '[a-z]') THEN 1 ELSE 0 END AS object_ok,
      CASE WHEN w <> '' AND w NOT IN {listed(fixed.BAD_ATTRIBUTES)} AND length(w) <= 30 AND regexp_matches(w, '[a-z]') THEN 1 ELSE 0 END AS attribute_ok,
      CASE WHEN w <> '' AND w NOT IN {listed(fixed.VAGUE_RELATIONS)} AND length(w) <= 45 AND regexp_matches(w, '[a-z]') THEN 1 ELSE 0 END AS relation_ok,
      CASE WHEN w IN {listed(fixed.COLOR_ATTRIBUTES)} THEN 'color' WHEN w IN {listed(fixed.SIZE_ATTRIBUTES)} THEN 'size' WHEN w IN {listed(fixed.MATERIAL_ATTRIBUTES)} THEN 'material'
        WHEN w IN {listed(fixed.STATE_ATTRIBUTES)} THEN 'state' ELSE 'general' END AS bucket FROM w""",
)
def b6(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).distinct()
    ok = lambda kind: F.when(text.good_name(F.col("w"), kind), 1).otherwise(0)
    return words.select("w", ok("object").alias("object_ok"), ok("attribute").alias("attribute_ok"), ok("relation").alias("relation_ok"), text.attribute_bucket(F.col("w")).alias("bucket"))


@query(
    "B18_types",
    """SELECT DISTINCT p.subtype, CASE WHEN p.subtype LIKE 'attr%' THEN 'attr' WHEN p.subtype LIKE 'rel%' THEN 'rel' ELSE split_part(p.subtype, '_', 1) END AS type, p.method,
      CASE WHEN contains(p.method, 'exist') OR contains(p.subtype, 'object') THEN 'existence' WHEN regexp_matches(p.subtype, 'attr|color|count|number') THEN 'attribute'
        WHEN regexp_matches(p.subtype, 'relation|spatial|position|left|right|above|below') THEN 'relation' ELSE 'other' END AS category FROM preds p""",
)
def b18(t: Tables) -> DataFrame:
    kinds = t.preds.select("subtype", "method").distinct()
    return kinds.select("subtype", text.subtype_type(F.col("subtype")).alias("type"), "method", text.benchmark_category(F.concat_ws(" ", "method", "subtype")).alias("category"))


@query(
    "B19_identifiers",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'sample' ELSE s END AS safe, CASE WHEN contains(lower(url), 'gqa') THEN 'GQA' WHEN contains(lower(url), 'coco') THEN 'MSCOCO' ELSE 'unknown' END AS dataset
      FROM (SELECT page_id, url, substr(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60) AS s FROM pages)""",
)
def b19(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_name(F.col("url")).alias("safe"), text.dataset_of_path(F.col("url")).alias("dataset"))


@query(
    "H1_nouns",
    """WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS noun, p_size % 4 AS k FROM part),
    m AS (SELECT unnest([noun, 'box', 'city', 'person', 'sheep', 'watches']) AS noun, k FROM n), d AS (SELECT DISTINCT noun, k FROM m),
    p AS (SELECT noun, k, CASE WHEN noun = 'person' THEN 'people' WHEN noun = 'sheep' THEN 'sheep' WHEN regexp_matches(noun, '(s|x|z|ch|sh)$') THEN noun || 'es' WHEN regexp_matches(noun, '[^aeiou]y$') THEN regexp_replace(noun, 'y$', 'ies') ELSE noun || 's' END AS plural FROM d)
    SELECT noun, k, plural, CASE WHEN k = 1 THEN noun ELSE plural END AS counted, CASE WHEN substr(noun, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article,
      CASE WHEN regexp_matches(noun, 's$') AND NOT regexp_matches(noun, '(ss|us)$') THEN 'are' ELSE 'is' END AS be, CASE k WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE '0' END AS word,
      CASE WHEN noun = 'watches' THEN 'watch' WHEN noun = 'person' THEN 'person' ELSE noun END AS clean_singular FROM p""",
)
def h1(t: Tables) -> DataFrame:
    base = t.part.select(F.substring_index("p_name", " ", -1).alias("noun"), (F.col("p_size") % 4).alias("k")).distinct()
    more = base.select(F.explode(F.array("noun", *map(F.lit, ("box", "city", "person", "sheep", "watches")))).alias("noun"), "k").distinct()
    n, k = F.col("noun"), F.col("k")
    return more.select(
        "noun", "k", text.plural(n).alias("plural"), text.counted_noun(n, k).alias("counted"), text.article(n).alias("article"), text.be_for(n).alias("be"), text.number_word(k).alias("word"),
        text.clean_singular(n).alias("clean_singular"),
    )


@query(
    "H3_counter_values",
    """SELECT subtype, positive_value, negative, count(*) AS n FROM judged WHERE subtype <> 'cat' GROUP BY ALL""",
)
def h3(t: Tables) -> DataFrame:
    v = F.col("positive_value")
    negative = F.when(F.col("subtype") == "cnt", text.count_counter(F.col("positive_int")).cast("string")).when(F.col("subtype") == "col", text.color_counter(v)).otherwise(text.relation_counter(v))
    shown = t.facts.filter("subtype <> 'cat'").select("subtype", "positive_value", negative.alias("negative"))
    return shown.groupBy("subtype", "positive_value", "negative").agg(F.count("*").alias("n"))


@query(
    "H4_prompts",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Question: ' || question || chr(10) || 'Please answer the question based on the image.' AS visual,
      md5('The given image depicts the following scene: There is ' || CASE WHEN substr(obj, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || obj || ' in the image.' || chr(10) ||
        'Please directly answer the following question from the image description, without guessing or reasoning.' || chr(10) || 'Question: ' || question) AS trusted FROM asked""",
)
def h4(t: Tables) -> DataFrame:
    q = F.col("question")
    return t.asked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.visual_prompt(q).alias("visual"), F.md5(text.trusted_prompt(text.scene_one(F.col("obj")), q)).alias("trusted"))


@query(
    "H5_answer_parsers",
    r"""WITH c AS (SELECT conv_id, turn, label, lower(answer) AS t FROM said),
    w AS (SELECT *, list_filter(string_split(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x IN ('yes', 'y', 'true', '1', 'no', 'n', 'false', '0'))[1] AS f, regexp_extract(t, '^[\s"''`*(\[]*([a-z]+)', 1) AS h FROM c)
    SELECT conv_id, turn, CASE WHEN f IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN f IN ('no', 'n', 'false', '0') THEN 'no' END AS token,
      coalesce(nullif(regexp_extract(t, '(?:^|[^\p{L}\p{N}_])(yes|no)(?:$|[^\p{L}\p{N}_])', 1), ''), 'invalid') AS earliest, CASE WHEN h IN ('yes', 'no') THEN h ELSE 'invalid' END AS first_word,
      CASE WHEN label = 'yes' THEN CASE WHEN contains(t, 'yes') THEN 'yes' ELSE 'no' END ELSE CASE WHEN contains(t, 'no') THEN 'no' ELSE 'yes' END END AS contains_mode FROM w""",
)
def h5(t: Tables) -> DataFrame:
    a, y = F.col("answer"), F.col("label")
    parsed = [text.parse_answer(a, m, y).alias(m if m != "contains" else "contains_mode") for m in ("token", "earliest", "first_word", "contains")]
    return t.said.select("conv_id", "turn", *parsed)


@query(
    "H6_question_parts",
    r"""WITH q AS (SELECT question, kind, obj, lower(p_type) AS pt FROM asked)
    SELECT question, count(*) AS n, CASE kind WHEN 0 THEN obj WHEN 6 THEN obj WHEN 4 THEN 'direct contact between the ' || obj || ' and ' || pt ELSE '' END AS object,
      CASE kind WHEN 3 THEN obj WHEN 4 THEN obj END AS subject, CASE kind WHEN 3 THEN 'left_of' WHEN 4 THEN 'direct_contact' END AS relation, CASE WHEN kind IN (3, 4) THEN pt END AS target FROM q GROUP BY ALL""",
)
def h6(t: Tables) -> DataFrame:
    rel = text.relation_of_question(F.col("question"))
    parts = t.asked.select("question", text.object_of_question(F.col("question")).alias("object"), rel.alias("r"))
    shown = parts.select("question", "object", F.col("r.subject").alias("subject"), F.col("r.relation").alias("relation"), F.col("r.object").alias("target"))
    return shown.groupBy("question", "object", "subject", "relation", "target").agg(F.count("*").alias("n"))


@query("H6_image_ids", r"SELECT page_id, CASE WHEN d <> '' THEN d ELSE stem END AS image_id FROM (SELECT page_id, regexp_extract(stem, '(\d+)$', 1) AS d, stem FROM (SELECT page_id, regexp_replace(string_split(split_part(url, '?', 1) || '.jpg', '/')[-1], '\.[^.]*$', '') AS stem FROM pages))")
def h6_ids(t: Tables) -> DataFrame:
    path = F.concat(F.substring_index("url", "?", 1), F.lit(".jpg"))
    return t.pages.select("page_id", text.image_id_of_path(path).alias("image_id"))


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(
    "H7_question_classes",
    "WITH q AS (SELECT lower(question) AS t FROM asked) SELECT CASE WHEN " + contains_any("t", fixed.CLASS_COUNT) + " THEN 'count' WHEN " + contains_any("t", fixed.CLASS_COLOR) + " THEN 'color' WHEN "
    + contains_any("t", fixed.CLASS_ACTION) + " THEN 'action_state' ELSE 'attribute_other' END AS substring_class, CASE "
    + " ".join(rf"WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})($|[^\p{{L}}\p{{N}}_])') THEN '{c}'" for c, ws in (("count_number", fixed.WORD_COUNT), ("color", fixed.WORD_COLOR), ("action", fixed.WORD_ACTION), ("state", fixed.WORD_STATE)))
    + " ELSE 'other_state' END AS word_class, count(*) AS n FROM q GROUP BY ALL",
)
def h7(t: Tables) -> DataFrame:
    q = F.col("question")
    return t.asked.groupBy(text.question_class(q).alias("substring_class"), text.question_class(q, "word").alias("word_class")).agg(F.count("*").alias("n"))


@query(
    "H9_rule_router",
    "WITH q AS (SELECT lower(question) AS t FROM asked) SELECT CASE WHEN " + contains_any("t", fixed.RULE_ATTR) + " THEN 'attr' WHEN " + contains_any("t", fixed.RULE_REL) + " THEN 'rel' WHEN " + contains_any("t", fixed.RULE_CAT)
    + " THEN 'cat' ELSE 'cat,attr,rel' END AS rule, 'rel_h,rel_v' AS forced, count(*) AS n FROM q GROUP BY ALL",
)
def h9(t: Tables) -> DataFrame:
    q = F.col("question")
    shown = t.asked.select(F.array_join(text.rule_route(q), ",").alias("rule"), F.array_join(text.rule_route(q, "force_rel", ("cat", "rel_h", "rel_v")), ",").alias("forced"))
    return shown.groupBy("rule", "forced").agg(F.count("*").alias("n"))


@query(
    "H8_router_weights",
    r"""WITH q AS (SELECT question, trim(regexp_replace(regexp_replace(replace(lower(question), '-', ' '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM asked),
    f AS (SELECT question, regexp_matches(t, '(^|\s)(is|are)\s+there($|\s)') AS ex, contains(t, 'how many') OR regexp_matches(t, '(^|\s)(number|total|count|one|two|three|four|five|six)($|\s)') AS c,
      regexp_matches(t, '(^|\s)(red|blue|green|yellow|black|white|gray|grey|brown|orange|color|colour)($|\s)') AS o, regexp_matches(t, '(^|\s)(sitting|standing|running|lying|holding|wearing|riding|carrying)($|\s)') AS a,
      regexp_matches(t, '(^|\s)(left|right|above|below|top|bottom)($|\s)') AS s, contains(t, 'direct contact') OR contains(t, 'touch') AS k FROM q),
    h AS (SELECT question, list_filter([CASE WHEN ex AND NOT (c OR o OR a OR s OR k) THEN 'cat' END, CASE WHEN c THEN 'attr_count' END, CASE WHEN o THEN 'attr_color' END, CASE WHEN a AND NOT k AND NOT s THEN 'attr_action_state' END,
      CASE WHEN s THEN 'rel_spatial' END, CASE WHEN k THEN 'rel_contact_missing' END], lambda x: x IS NOT NULL) AS h FROM f)
    SELECT question, CASE WHEN len(h) = 0 THEN 'unknown' ELSE array_to_string(h, ',') END AS labels, round(1 / greatest(len(h), 1), 6) AS weight, count(*) AS n FROM h GROUP BY ALL""",
)
def h8(t: Tables) -> DataFrame:
    w = t.asked.groupBy("question").agg(F.count("*").alias("n")).withColumn("w", text.router_weights(F.col("question")))
    return w.select("question", F.array_join(F.transform("w", lambda x: x["label"]), ",").alias("labels"), F.round(F.get("w", F.lit(0))["weight"], 6).alias("weight"), "n")


@query(
    "H10_H11_colors",
    """WITH p AS (SELECT l_orderkey AS image_id, l_linenumber % 3 + 1 AS segment_id, avg(l_partkey % 256) AS r, avg(l_suppkey * 7 % 256) AS g, avg(l_quantity * 5) AS b FROM lineitem GROUP BY ALL)
    SELECT image_id, segment_id, CASE WHEN (r + g + b) / 3 < 45 THEN 'black' WHEN (r + g + b) / 3 > 225 AND greatest(r, g, b) - least(r, g, b) < 25 THEN 'white'
      WHEN r > 150 AND g > 110 AND b < 120 THEN CASE WHEN r > 185 AND g > 170 THEN 'yellow' WHEN r > 165 AND g < 150 THEN 'orange' ELSE 'brown' END
      WHEN r > 120 AND g > 70 AND b < 90 AND (r + g + b) / 3 < 170 THEN 'brown' WHEN r > g + 35 AND r > b + 35 THEN 'red' WHEN g > r + 25 AND g > b + 25 THEN 'green' WHEN b > r + 25 AND b > g + 25 THEN 'blue'
      WHEN r > 170 AND g > 150 AND b < 110 THEN 'yellow' WHEN r > 175 AND g > 95 AND b < 90 THEN 'orange' WHEN (r + g + b) / 3 < 95 THEN 'brown' END AS color,
      CAST(image_id % 256 AS BIGINT) AS id_r, CAST(image_id // 256 % 256 AS BIGINT) AS id_g FROM p""",
)
def h10(t: Tables) -> DataFrame:
    rgb = t.lineitem.groupBy(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3 + 1).alias("segment_id")).agg(
        F.avg(F.col("l_partkey") % 256).alias("r"), F.avg(F.col("l_suppkey") * 7 % 256).alias("g"), F.avg(F.col("l_quantity") * 5).alias("b")
    )
    code = geo.segment_to_rgb(F.col("image_id"))
    return rgb.select("image_id", "segment_id", geo.color_of(F.col("r"), F.col("g"), F.col("b")).alias("color"), code["r"].alias("id_r"), code["g"].cast("long").alias("id_g"))


@query(
    "H12_condition_keys",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE '["' || lang || '","' || doc_id || '"]' END AS condition_key FROM documents""",
)
def h12(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    key = text.condition_key(F.when(d % 3 == 0, F.col("source")).otherwise(""), F.when(d % 3 == 1, F.col("lang")), F.col("lang"), d.cast("string"))
    return t.documents.select("doc_id", key.alias("condition_key"))


@query(
    "H13_run_names",
    """WITH r AS (SELECT sample_id, method, CASE event_id % 4 WHEN 0 THEN 'cat__plus__rel_alpha' || replace(CAST(event_id % 10 AS VARCHAR) || '.5', '.', 'p') WHEN 1 THEN 'baseline' WHEN 2 THEN 'run_attr_res_alpham' || (event_id % 7) ELSE 'plain_rel' END AS name, event_id FROM preds)
    SELECT sample_id, method, name, CASE event_id % 4 WHEN 0 THEN 'cat+rel' WHEN 1 THEN '' WHEN 2 THEN 'run_attr_res' ELSE name END AS vector,
      CASE event_id % 4 WHEN 0 THEN event_id % 10 + 0.5 WHEN 2 THEN -CAST(event_id % 7 AS DOUBLE) END AS alpha, CASE event_id % 4 WHEN 0 THEN 'cat' WHEN 1 THEN '' WHEN 2 THEN 'attr_res' ELSE 'rel' END AS expert FROM r""",
)
def h13(t: Tables) -> DataFrame:
    e = F.col("event_id")
    name = (
        F.when(e % 4 == 0, F.concat(F.lit("cat__plus__rel_alpha"), F.translate(F.concat((e % 10).cast("string"), F.lit(".5")), ".", "p"))).when(e % 4 == 1, "baseline")
        .when(e % 4 == 2, F.concat(F.lit("run_attr_res_alpham"), (e % 7).cast("string"))).otherwise("plain_rel")
    )
    named = t.preds.select("sample_id", "method", name.alias("name"))
    parsed = text.vector_and_alpha(F.col("name"))
    return named.select("sample_id", "method", "name", parsed["vector"].alias("vector"), parsed["alpha"].alias("alpha"), text.expert_of_run(F.col("name")).alias("expert"))


@query(
    "H14_C13_captions",
    """WITH f AS (SELECT image_id, CASE WHEN subtype = 'cat' THEN 'cat' WHEN subtype = 'rel' THEN 'rel' ELSE 'attr' END AS type, fact_id, 'The image has ' || subject_category || coalesce(' ' || positive_value, '') || '.' AS s FROM facts),
    d AS (SELECT image_id, s, min(((CASE type WHEN 'cat' THEN 0 WHEN 'attr' THEN 1 ELSE 2 END), fact_id)) AS place FROM f GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY place, s) AS r FROM d)
    SELECT image_id, string_agg(s, ' ' ORDER BY r) FILTER (WHERE r <= 6) || CASE WHEN count(*) > 6 THEN ' Additional annotated visual facts are present.' ELSE '' END AS caption FROM r GROUP BY image_id""",
)
def h14(t: Tables) -> DataFrame:
    kind = F.when(F.col("subtype").isin("cat", "rel"), F.col("subtype")).otherwise("attr")
    said = F.concat(F.lit("The image has "), "subject_category", F.coalesce(F.concat(F.lit(" "), "positive_value"), F.lit("")))
    return profile.captions(t.facts.select("image_id", kind.alias("type"), "fact_id", said.alias("fact")), "fact_id", 6, expected=t.line_count)


@query("H15_stable_unit", "SELECT doc_id, round((CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 1000) / 1000, 6) AS u FROM documents")
def h15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(text.stable_unit(F.col("text")), 6).alias("u"))


@query(
    "H4_scene_sentence",
    """WITH r AS (SELECT image_id, category, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, category) AS r FROM cnt)
    SELECT image_id, string_agg('There ' || CASE WHEN n = 1 THEN 'is ' ELSE 'are ' END || CASE n WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' ELSE CAST(n AS VARCHAR) END || ' ' ||
      CASE WHEN n = 1 OR category LIKE '%s' THEN category WHEN regexp_matches(category, '[^aeiou]y$') THEN regexp_replace(category, 'y$', 'ies') ELSE category || 's' END || ' in the image', '. ' ORDER BY r) || '.' AS scene FROM r WHERE r <= 8 GROUP BY image_id""",
)
def h4_scene(t: Tables) -> DataFrame:
    return facts.count_maps(t.cnt).select("image_id", profile.scene_sentence(F.col("counts")).alias("scene"))
