"""Question and minimal-pair builders (sections P3-P11, A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators import builders, facts, joins, profile, validate
from pairloom.plans.bind import Tables
from pairloom.plans.q_sampling import NUM, PRESENCE, types
from pairloom.plans.q_text import listed
from pairloom.plans.registry import query
from pairloom.session import pinned
from pairloom.sources import records

ARTICLE = "CASE WHEN lower(substr({0}, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END"


@query(
    "P3_existence_rows",
    f"""WITH {PRESENCE}, c AS (SELECT image_id, present[CAST({NUM.format("'42|' || image_id")} % len(present) + 1 AS INTEGER)] AS p, CASE WHEN len(absent) > 0 THEN absent[CAST({NUM.format("'42|' || image_id")} % len(absent) + 1 AS INTEGER)] END AS q FROM ab)
    SELECT 'cat_present_' || image_id || '_' || p AS row_id, image_id, 'cat_present' AS subtype, 'Is there ' || {ARTICLE.format("p")} || ' ' || p || ' in the image?' AS question, 'yes' AS answer, 'There is ' || {ARTICLE.format("p")} || ' ' || p || ' in the image.' AS trusted_text FROM c
    UNION ALL SELECT 'cat_absent_' || image_id || '_' || q, image_id, 'cat_absent', 'Is there ' || {ARTICLE.format("q")} || ' ' || q || ' in the image?', 'no', 'There is no ' || q || ' in the image.' FROM c WHERE q IS NOT NULL""",
)
def p3(t: Tables) -> DataFrame:
    return builders.existence_rows(t.objs, types(t)).select("row_id", "image_id", "subtype", "question", "answer", "trusted_text")


@query(
    "P4_count_rows",
    f"""WITH o AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('42|' || image_id || '|' || category), category) = 1),
    w AS (SELECT *, (CASE WHEN n = 1 THEN [2, 3] ELSE [n - 1, n + 1] END)[CAST({NUM.format("'42|' || image_id")} % 2 + 1 AS INTEGER)] AS w, CASE WHEN category LIKE '%Y' THEN category || 's' ELSE category || 's' END AS pl FROM o)
    SELECT image_id, 'How many ' || pl || ' are there in the image?' AS question, CASE WHEN n = 1 THEN 'There is 1 ' || category ELSE 'There are ' || n || ' ' || pl END || ' in the image.' AS factual,
      CASE WHEN w = 1 THEN 'There is 1 ' || category ELSE 'There are ' || w || ' ' || pl END || ' in the image.' AS counterfactual, CAST(n AS INTEGER) AS count, CAST(w AS INTEGER) AS wrong_count FROM w""",
)
def p4(t: Tables) -> DataFrame:
    return builders.count_rows(t.cnt).select("image_id", "question", "factual", "counterfactual", "count", "wrong_count")


@query(
    "P4_color_rows",
    f"""WITH o AS (SELECT * FROM objs WHERE color IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('42|' || image_id || '|' || annotation_id), annotation_id) = 1),
    w AS (SELECT *, list_filter(['black', 'white', 'red', 'yellow', 'green', 'blue', 'brown', 'orange'], lambda x: x <> color) AS ws FROM o)
    SELECT image_id, 'What color is the ' || category || ' in the image?' AS question, 'The ' || category || ' is ' || color || '.' AS factual, 'The ' || category || ' is ' || ws[CAST({NUM.format("'42|' || image_id")} % len(ws) + 1 AS INTEGER)] || '.' AS counterfactual FROM w""",
)
def p4_color(t: Tables) -> DataFrame:
    return builders.color_rows(t.objs).select("image_id", "question", "factual", "counterfactual")


SPATIAL = """hy AS (SELECT * FROM ann WHERE NOT crowd AND w > 1 AND h > 1 AND w * h / 40000 > 0.005 AND w * h / 40000 < 0.5),
    c AS (SELECT *, count(*) OVER (PARTITION BY image_id, category) AS n FROM hy), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id, category ORDER BY w * h DESC, annotation_id) = 1),
    rp AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE n = 1) OVER (PARTITION BY image_id) AS u FROM r) WHERE u < 2 OR n = 1),
    pr AS (SELECT a.image_id, a.annotation_id AS ai, b.annotation_id AS bi, a.category AS ac, b.category AS bc, (a.x + a.w / 2) - (b.x + b.w / 2) AS dx, (a.y + a.h / 2) - (b.y + b.h / 2) AS dy,
      greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM rp a JOIN rp b ON a.image_id = b.image_id AND a.annotation_id < b.annotation_id),
    sw AS (SELECT *, CAST('0x' || substr(md5('42|' || image_id || '|' || ai || '|' || bi), 1, 4) AS BIGINT) % 2 = 1 AS swap, md5('42|' || image_id || '|' || ai || '|' || bi) AS k FROM pr WHERE i / (s - i) <= 0.05),
    rl AS (SELECT image_id, ai, bi, k, CASE WHEN swap THEN bc ELSE ac END AS x, CASE WHEN swap THEN ac ELSE bc END AS y,
      CASE WHEN abs(dx) > 50 AND abs(dx) > 2 * abs(dy) THEN CASE WHEN (dx < 0) <> swap THEN 'left_of' ELSE 'right_of' END WHEN abs(dy) > 50 AND abs(dy) > 2 * abs(dx) THEN CASE WHEN (dy < 0) <> swap THEN 'above' ELSE 'below' END END AS rel FROM sw),
    kp AS (SELECT *, CASE rel WHEN 'left_of' THEN 'right_of' WHEN 'right_of' THEN 'left_of' WHEN 'above' THEN 'below' ELSE 'above' END AS opp FROM rl WHERE rel IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k, ai, bi) <= 2),
    ph AS (SELECT *, CASE rel WHEN 'left_of' THEN 'to the left of' WHEN 'right_of' THEN 'to the right of' ELSE rel END AS rp, CASE opp WHEN 'left_of' THEN 'to the left of' WHEN 'right_of' THEN 'to the right of' ELSE opp END AS op,
      CASE rel WHEN 'left_of' THEN 'on the left side of' WHEN 'right_of' THEN 'on the right side of' ELSE rel END AS rs, CASE opp WHEN 'left_of' THEN 'left side of' WHEN 'right_of' THEN 'right side of' ELSE opp END AS os FROM kp)"""


@query(
    "P5_spatial_rows",
    f"""WITH {SPATIAL}
    SELECT image_id, 'rel_' || regexp_replace(rel, '_of$', '') AS subtype, 'Is the ' || x || ' ' || rp || ' the ' || y || ' in the image?' AS question, 'yes' AS answer,
      'The ' || x || ' is located ' || rs || ' the ' || y || ' in the image. This means the ' || y || ' is ' || os || ' the ' || x || '.' AS trusted_text FROM ph
    UNION ALL SELECT image_id, 'rel_' || regexp_replace(rel, '_of$', ''), 'Is the ' || x || ' ' || op || ' the ' || y || ' in the image?', 'no',
      'The ' || x || ' is located ' || rs || ' the ' || y || ' in the image., not ' || op || ' the ' || y || '. This means the ' || y || ' is ' || os || ' the ' || x || '.' FROM ph""",
)
def p5(t: Tables) -> DataFrame:
    clean = t.by_image(t.ann).join(t.images.select("image_id", "width", "height"), "image_id")
    return builders.spatial_rows(clean.filter(facts.hygiene_reason("strict").isNull())).select("image_id", "subtype", "question", "answer", "trusted_text")


def relation_records(t: Tables) -> DataFrame:
    """External relation records: some complete, some only as a question."""
    k = F.col("kind")
    return t.asked.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat("l_orderkey", F.lit(".jpg"))).alias("image"),
        F.when(k < 3, F.concat(F.lit("the "), "obj")).alias("subject"), F.when(k == 0, "next to").when(k == 1, "of").when(k == 2, "holding").alias("predicate"),
        F.when(k < 3, F.lower("p_type")).alias("object"), F.when(k >= 3, F.col("question")).alias("question"), F.when(F.col("l_returnflag") == "A", "true").otherwise("no").alias("label"),
    )


@query(
    "P6_skipped_records",
    """SELECT CASE WHEN kind IN (5, 6, 7) THEN 'missing_fields' WHEN kind = 1 THEN 'filtered_semantic' ELSE 'missing_image' END AS reason, count(*) AS n FROM asked WHERE kind IN (1, 5, 6, 7) OR l_returnflag = 'R' GROUP BY 1""",
)
def p6_skipped(t: Tables) -> DataFrame:
    return builders.record_rows(relation_records(t))[1]


@query(
    "P6_record_rows",
    """WITH k AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rid, l_orderkey || '.jpg' AS image_id, obj AS s, lower(p_type) AS o, CASE kind WHEN 0 THEN 'next_to' WHEN 2 THEN 'holding' WHEN 3 THEN 'left_of' ELSE 'direct_contact' END AS r,
        CASE WHEN kind >= 3 THEN question END AS given, CASE WHEN l_returnflag = 'A' THEN 'yes' ELSE 'no' END AS label FROM asked WHERE kind IN (0, 2, 3, 4) AND l_returnflag <> 'R'),
    p AS (SELECT *, CASE r WHEN 'next_to' THEN 'next to' WHEN 'holding' THEN 'holding' WHEN 'left_of' THEN 'to the left of' ELSE 'in direct contact with' END AS ph, replace('rel_' || rid || '_' || s || '_' || r || '_' || o, ' ', '_') AS base FROM k),
    a AS (SELECT base AS row_id, image_id, r AS relation, CASE WHEN r = 'left_of' THEN 'horizontal' WHEN r = 'holding' THEN 'interaction' ELSE 'contact' END AS bucket, label AS answer,
        coalesce(given, 'Is the ' || s || ' ' || ph || ' the ' || o || ' in the image?') AS question, 'The ' || s || ' is ' || CASE WHEN label = 'yes' THEN '' ELSE 'not ' END || ph || ' the ' || o || ' in the image.' AS trusted_text FROM p
      UNION ALL SELECT base || '_opposite_no', image_id, r, 'horizontal', 'no', 'Is the ' || s || ' to the right of the ' || o || ' in the image?', 'The ' || s || ' is to the left of the ' || o || ' in the image. The ' || s || ' is not to the right of the ' || o || ' in the image.' FROM p WHERE r = 'left_of' AND label = 'yes'),
    n AS (SELECT *, row_number() OVER (PARTITION BY image_id, bucket ORDER BY md5('42|' || row_id), row_id) AS rk, CASE bucket WHEN 'horizontal' THEN 2 WHEN 'contact' THEN 1 ELSE 0 END AS q, CASE bucket WHEN 'horizontal' THEN 0 WHEN 'contact' THEN 3 ELSE 4 END AS bo FROM a)
    SELECT row_id, image_id, relation, answer, question, trusted_text FROM n WHERE rk <= q OR bucket <> 'horizontal'
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN rk <= q THEN 0 ELSE 1 END, greatest(rk - q, 0), bo, rk) <= 4""",
)
def p6(t: Tables) -> DataFrame:
    return builders.record_rows(relation_records(t))[0].select("row_id", "image_id", "relation", "answer", "question", "trusted_text")


@query(
    "A5_relation_layouts",
    """SELECT image_id, subject, predicate, object, count(*) AS n FROM (
      SELECT s.image_id AS image_id, s.name AS subject, e.relation AS predicate, coalesce(o.name, e.target_id) AS object FROM edges e JOIN sg s ON s.image_id = e.image_id AND s.object_id = e.subject_id LEFT JOIN sg o ON o.image_id = e.image_id AND o.object_id = e.target_id
      UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, 'near', source FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR), 'a', 'on', 'b' FROM benchmark) GROUP BY ALL""",
)
def a5(t: Tables) -> DataFrame:
    """The three record layouts, flattened: an objects map, a list of relationships, a flat row."""
    named = joins.with_targets(t.edges, t.sg)
    rel = F.array(F.struct(F.col("relation").alias("name"), F.col("target_id").alias("object")))
    subject = F.struct(F.col("subject_id").alias("id"), F.struct(F.col("subject_name").alias("name"), rel.alias("relations")))
    target = F.struct(F.col("target_id").alias("id"), F.struct(F.col("object_name").alias("name"), F.lit(None).cast("array<struct<name:string,object:string>>").alias("relations")))
    # One record per edge with both of its ends, so no image is gathered into one row.
    graph = named.select("image_id", F.map_from_entries(F.array(subject, target)).alias("objects"))
    listed_rels = t.documents.select(F.col("doc_id").cast("string").alias("image_id"), F.array(F.struct(F.col("lang").alias("subject"), F.lit("near").alias("predicate"), F.col("source").alias("object"))).alias("relationships"))
    flat = t.benchmark.select(F.col("item_id").cast("string").alias("image_id"), F.lit("a").alias("subject"), F.lit("on").alias("rel"), F.lit("b").alias("obj"))
    shown = records.flatten_relations(graph=graph, listed=listed_rels, flat=flat)
    return shown.groupBy("image_id", "subject", "predicate", "object").agg(F.count("*").alias("n"))


@query("P7_bundle")
def p7(t: Tables) -> DataFrame:
    """Existence, count and spatial rows of an image under one cap, with prompts."""
    clean = t.by_image(t.ann).join(t.images.select("image_id", "width", "height"), "image_id")
    objs = t.objs_table
    counts = builders.count_rows(facts.category_counts(objs)).withColumnRenamed("factual", "trusted_text")
    parts = [builders.existence_rows(objs, types(t)), counts, builders.spatial_rows(clean.filter(facts.hygiene_reason("strict").isNull()))]
    # About a row a line item, with long texts.
    return builders.prompted(builders.bundle(parts, 4, t.line_count)).select("row_id", "image_id", "type", "question", "visual_prompt", "trusted_prompt")


def scene_rows(t: Tables) -> DataFrame:
    # Questions need no boxes; only what they read is dealt and written.
    scenes = pinned(t.scenes.select("image_id", "object_id", "name", "attributes", "relation", "target_id"))
    edges = scenes.select("image_id", F.col("object_id").alias("subject_id"), "relation", "target_id")
    return builders.scene_questions(scenes, edges, {"yes": 300, "no": 300}, 42)


@query("P8_scene_questions")
def p8(t: Tables) -> DataFrame:
    rows = pinned(scene_rows(t))
    validate.require_none(validate.violations(rows, "row_id", ["row_id", "image_id", "question", "answer"], {"answer": ("yes", "no")}, ["row_id"]), "scene questions")
    return rows


@query(
    "P8_scene_existence",
    """WITH pr AS (SELECT image_id, list_sort(list(DISTINCT name)) AS present FROM sg GROUP BY image_id), vv AS (SELECT list_sort(list(name)) AS every FROM (SELECT name FROM sg GROUP BY name HAVING count(*) >= 2)),
    c AS (SELECT image_id, present[CAST(""" + NUM.format("'42|' || image_id") + """ % len(present) + 1 AS INTEGER)] AS p, list_filter(every, lambda x: NOT list_contains(present, x)) AS ab FROM pr, vv),
    q AS (SELECT image_id, p, CASE WHEN len(ab) > 0 THEN ab[CAST(""" + NUM.format("'42|' || image_id") + """ % len(ab) + 1 AS INTEGER)] END AS q FROM c),
    r AS (SELECT image_id, 'yes' AS answer, 'Is there a ' || p || ' in the image?' AS question FROM q UNION ALL SELECT image_id, 'no', 'Is there a ' || q || ' in the image?' FROM q WHERE q IS NOT NULL)
    SELECT image_id, answer, question FROM r QUALIFY row_number() OVER (PARTITION BY answer ORDER BY md5('42|' || image_id), image_id) <= CASE answer WHEN 'yes' THEN 1200 ELSE 900 END""",
)
def p8_existence(t: Tables) -> DataFrame:
    objs, _, _ = builders.clean_scene(t.sg, t.edges)
    names = builders.bucketed_vocabulary(objs, "name", F.lit(""))
    return builders.scene_existence(objs, names, {"yes": 1200, "no": 900}, 42).select("image_id", "answer", "question")


@query("P9_strategy_pairs")
def p9(t: Tables) -> DataFrame:
    cnt = pinned(facts.category_counts(t.objs))
    return builders.strategy_pairs(cnt, types(t), facts.count_maps(cnt), cnt.groupBy("category").agg(F.sum("n").alias("n")))


@query(
    "P9_spatial_pairs",
    """WITH p AS (SELECT a.image_id, a.object_id AS ai, b.object_id AS bi, a.name AS s, b.name AS o, (a.x + a.w / 2) - (b.x + b.w / 2) AS dx, (a.y + a.h / 2) - (b.y + b.h / 2) AS dy FROM sg a JOIN sg b ON a.image_id = b.image_id AND a.object_id < b.object_id AND a.name <> b.name),
    r AS (SELECT *, CASE WHEN abs(dx) >= 35 AND abs(dx) >= abs(dy) * 1.5 THEN CASE WHEN dx > 0 THEN 'right of' ELSE 'left of' END WHEN abs(dy) >= 35 AND abs(dy) >= abs(dx) * 1.5 THEN CASE WHEN dy > 0 THEN 'below' ELSE 'above' END END AS r FROM p)
    SELECT 'rel_spatial_' || image_id || '_' || ai || '_' || replace(r, ' ', '_') || '_' || bi AS pair_id, 'Is the ' || s || ' ' || r || ' the ' || o || ' in the image?' AS true_question,
      'Is the ' || s || ' ' || CASE r WHEN 'left of' THEN 'right of' WHEN 'right of' THEN 'left of' WHEN 'above' THEN 'below' ELSE 'above' END || ' the ' || o || ' in the image?' AS false_question FROM r WHERE r IS NOT NULL""",
)
def p9_spatial(t: Tables) -> DataFrame:
    return builders.offset_pairs(t.sg).select("pair_id", "true_question", "false_question")


@query(
    "P9_contact_pairs",
    """SELECT 'rel_contact_' || e.image_id || '_' || e.subject_id || '_' || replace(relation, ' ', '_') || '_' || e.target_id AS pair_id, 'The ' || s.name || ' is ' || relation || ' the ' || o.name || ' in the image.' AS fact,
      'The ' || s.name || ' is ' || CASE relation WHEN 'holding' THEN 'wearing' ELSE 'standing next to' END || ' the ' || o.name || ' in the image.' AS counterfact
    FROM edges e JOIN sg s ON s.image_id = e.image_id AND s.object_id = e.subject_id JOIN sg o ON o.image_id = e.image_id AND o.object_id = e.target_id WHERE relation IN ('holding', 'sitting on') AND s.name <> o.name""",
)
def p9_contact(t: Tables) -> DataFrame:
    return builders.contact_pairs(t.sg, t.edges).select("pair_id", "fact", "counterfact")


@query(
    "P10_clean_counts",
    f"""WITH n AS (SELECT image_id, name, count(*) AS n FROM sg WHERE name IN {listed(fixed.COUNT_OBJECTS)} GROUP BY ALL HAVING count(*) <= 4), w AS (SELECT *, CASE WHEN n < 4 THEN n + 1 ELSE 3 END AS w, CASE name WHEN 'man' THEN 'men' WHEN 'person' THEN 'people' ELSE name || 's' END AS pl FROM n),
    z AS (SELECT *, ['one', 'two', 'three', 'four'][CAST(n AS INTEGER)] AS nw, ['one', 'two', 'three', 'four'][CAST(w AS INTEGER)] AS ww FROM w)
    SELECT 'attr_count_clean_' || image_id || '_' || name || '_' || n || '_' || w AS pair_id, CASE WHEN n = 1 THEN 'Is there one ' || name ELSE 'Are there ' || nw || ' ' || pl END || ' in the image?' AS true_question,
      'Are there ' || ww || ' ' || pl || ' in the image?' AS false_question, CASE WHEN n = 1 THEN 'There is one ' || name ELSE 'There are ' || nw || ' ' || pl END || ' in the image.' AS fact,
      '["attr_count_clean","' || name || '","' || n || '","' || w || '","' || n || '"]' AS true_key FROM z""",
)
def p10_counts(t: Tables) -> DataFrame:
    return builders.clean_count_pairs(t.sg).select("pair_id", "true_question", "false_question", "fact", "true_key")


@query(
    "P10_clean_values",
    f"""WITH v AS (SELECT image_id, object_id, name, trait FROM sg),
    s AS (SELECT 'attr_state_clean' AS subtype, *, trait AS v, CASE trait WHEN 'wet' THEN 'dry' ELSE 'closed' END AS w, '' AS made FROM v WHERE trait IN ('wet', 'open') AND name IN {listed(fixed.STATE_OBJECTS)}
      UNION ALL SELECT 'attr_material_clean', *, 'metal', 'wooden', 'made of ' FROM v WHERE trait = 'metallic' AND name IN {listed(fixed.MATERIAL_OBJECTS)}
      UNION ALL SELECT 'attr_shape_clean', *, trait, CASE trait WHEN 'round' THEN 'square' ELSE 'short' END, '' FROM v WHERE trait IN ('round', 'long') AND name IN {listed(fixed.SHAPE_OBJECTS)}
      UNION ALL SELECT 'attr_action_single_clean', *, 'standing', 'sitting', '' FROM v WHERE trait = 'standing' AND name IN {listed(fixed.ACTION_OBJECTS)})
    SELECT subtype, subtype || '_' || image_id || '_' || object_id || '_' || v || '_' || w AS pair_id, 'The ' || name || ' is ' || made || v || '.' AS fact, 'Is the ' || name || ' ' || made || CASE w WHEN 'wooden' THEN 'wood' ELSE w END || '?' AS false_question FROM s""",
)
def p10_values(t: Tables) -> DataFrame:
    sg = t.sg
    out = None
    for subtype in builders.VALUE_PAIRS:
        part = builders.clean_value_pairs(sg, subtype).select("subtype", "pair_id", "fact", "false_question")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "P10_clean_colors",
    """WITH c AS (SELECT image_id, object_id, name, trait AS color FROM sg WHERE trait IN ('blue', 'red') AND name IN """ + listed(fixed.COLOR_OBJECTS) + """)
    SELECT 'attr_color_clean_' || image_id || '_' || object_id || '_' || color || '_' || CASE color WHEN 'red' THEN 'blue' ELSE 'red' END AS pair_id, 'Is the ' || name || ' ' || CASE color WHEN 'red' THEN 'blue' ELSE 'red' END || '?' AS false_question,
      'There is a ' || name || ' in the image.' AS base_scene FROM c""",
)
def p10_colors(t: Tables) -> DataFrame:
    return builders.clean_color_pairs(t.sg).select("pair_id", "false_question", "base_scene")


@query(
    "P10_clean_boxes",
    f"""WITH a AS (SELECT * FROM sg WHERE name IN {listed(fixed.REL_OBJECTS)}), p AS (SELECT x.image_id, x.object_id AS ai, y.object_id AS bi, x.name AS s, y.name AS o, ((x.x + x.w / 2) - (y.x + y.w / 2)) / 200 AS dx, ((x.y + x.h / 2) - (y.y + y.h / 2)) / 200 AS dy
      FROM a x JOIN a y ON x.image_id = y.image_id AND x.object_id <> y.object_id AND x.name <> y.name),
    r AS (SELECT 'rel_left_right_clean' AS subtype, *, CASE WHEN dx > 0 THEN 'right of' ELSE 'left of' END AS r FROM p WHERE abs(dx) > 0.15 AND abs(dx) > 1.5 * abs(dy)
      UNION ALL SELECT 'rel_above_below_clean', *, CASE WHEN dy > 0 THEN 'below' ELSE 'above' END FROM p WHERE abs(dy) > 0.15 AND abs(dy) > 1.5 * abs(dx))
    SELECT subtype, subtype || '_' || image_id || '_' || ai || '_' || bi || '_' || replace(r, ' ', '_') AS pair_id, 'The ' || s || ' is ' || CASE r WHEN 'right of' THEN 'to the right of' WHEN 'left of' THEN 'to the left of' ELSE r END || ' the ' || o || '.' AS fact FROM r""",
)
def p10_boxes(t: Tables) -> DataFrame:
    return builders.clean_box_pairs(t.sg, *builders.BOX_SUBTYPES).select("subtype", "pair_id", "fact")


@query(
    "P10_clean_contacts",
    f"""SELECT CASE relation WHEN 'holding' THEN 'rel_holding_wearing_clean' ELSE 'rel_sitting_riding_clean' END || '_' || e.image_id || '_' || e.subject_id || '_' || e.target_id || '_' || replace(relation, ' ', '_') AS pair_id,
      'Is the ' || s.name || ' standing beside the ' || o.name || '?' AS false_question FROM edges e JOIN sg s ON s.image_id = e.image_id AND s.object_id = e.subject_id JOIN sg o ON o.image_id = e.image_id AND o.object_id = e.target_id
    WHERE (relation = 'holding' AND s.name IN {listed(fixed.PERSON_SUBJECTS)} AND o.name IN {listed(fixed.HOLDING_OBJECTS)}) OR (relation = 'sitting on' AND s.name IN {listed(fixed.SIT_RIDE_SUBJECTS)} AND o.name IN {listed(fixed.SITTING_OBJECTS)})""",
)
def p10_contacts(t: Tables) -> DataFrame:
    return builders.clean_contact_pairs(t.sg, t.edges)[0].select("pair_id", "false_question")


@query("P11_caption_rows")
def p11(t: Tables) -> DataFrame:
    rows = pinned(scene_rows(t))
    made = profile.captions(rows.select("image_id", "type", "row_id", F.col("trusted_text").alias("fact")), "row_id", 24)
    return builders.caption_rows(rows, made).select("row_id", "image_id", "answer", "query_caption", "caption")
