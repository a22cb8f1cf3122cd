"""Facts, pairs and banks (sections A15, B8-B14, C1-C3, D1, E1, E2, E4, E13, E18, E20, H2, P1, P2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.functions import geometry as geo
from pairloom.operators import banks, facts, pairs
from pairloom.operators.ordering import top_k
from pairloom.plans.bind import Tables
from pairloom.plans.registry import query
from pairloom.session import pinned


def stages(t: Tables, written: bool = False) -> dict[str, DataFrame]:
    return pairs.pair_stages(t.facts, t.counts, banks.bank_arrays(t.bank), banks.template_bank(t.spark), written=written)


@query(
    "P2_pair_report",
    """
    SELECT '1_before_filter' AS stage, subtype, '' AS reason, count(*) AS n FROM judged GROUP BY ALL
    UNION ALL SELECT '2_after_filter', subtype, '', count(*) FROM judged WHERE drop_reason IS NULL GROUP BY ALL
    UNION ALL SELECT 'dropped', subtype, drop_reason, count(*) FROM judged WHERE drop_reason IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'dropped', subtype, 'capped_' || subtype || '_per_image', CAST(sum(greatest(n - CASE subtype WHEN 'rel' THEN 6 ELSE 4 END, 0)) AS BIGINT) AS n
      FROM (SELECT image_id, subtype, count(*) AS n FROM judged WHERE drop_reason IS NULL GROUP BY ALL) GROUP BY ALL HAVING sum(greatest(n - CASE subtype WHEN 'rel' THEN 6 ELSE 4 END, 0)) > 0
    UNION ALL SELECT '3_after_caps', subtype, '', count(*) FROM kept GROUP BY ALL
    UNION ALL SELECT '4_unbalanced', subtype, '', count(*) FROM pairs GROUP BY ALL
    UNION ALL SELECT '5_balanced', subtype, '', count(*) FROM bal GROUP BY ALL
    """,
)
def pair_report(t: Tables) -> DataFrame:
    s = stages(t, written=True)
    return pairs.pair_report(s["judged"], s["kept"], s["unbalanced"], s["balanced"])


PAIR_SQL = "SELECT pair_id, image_id, subtype, template_id, question, response_pos, response_neg, pos_label, neg_label, coalesce(rel_pattern, anchor_label) AS label_key FROM {}"


def pair_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "pair_id", "image_id", "subtype", "template_id", "question", "response_pos", "response_neg", "pos_label", "neg_label",
        F.coalesce("rel_pattern", "anchor_label").alias("label_key"),
    )


@query("H2_render_pairs", PAIR_SQL.format("pairs"))
def render_pairs(t: Tables) -> DataFrame:
    return pair_columns(stages(t)["unbalanced"])


@query("E2_balanced_pairs", PAIR_SQL.format("bal"))
def balanced_pairs(t: Tables) -> DataFrame:
    return pair_columns(stages(t)["balanced"])


@query("E1_image_caps", "SELECT image_id, subtype, fact_id FROM kept")
def image_caps(t: Tables) -> DataFrame:
    judged = pairs.judged_facts(t.facts, t.counts, banks.bank_arrays(t.bank))
    return pairs.capped(judged.filter("drop_reason is null")).select("image_id", "subtype", "fact_id")


@query("E4_template_index", "SELECT fact_id, subtype, fact_rank, template_id FROM pairs")
def template_index(t: Tables) -> DataFrame:
    judged = pairs.judged_facts(t.facts, t.counts, banks.bank_arrays(t.bank))
    kept = pinned(pairs.capped(judged.filter("drop_reason is null").select(*pairs.FACT, "negative")))
    return pairs.rendered(kept, banks.template_bank(t.spark)).select("fact_id", "subtype", "fact_rank", "template_id")


@query("B11_drop_reasons", "SELECT subtype, coalesce(drop_reason, '') AS reason, count(*) AS n FROM judged GROUP BY ALL")
def drop_reasons(t: Tables) -> DataFrame:
    judged = pairs.judged_facts(t.facts, t.counts, banks.bank_arrays(t.bank))
    return judged.groupBy("subtype", F.coalesce("drop_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("P1_atomic_facts", "SELECT fact_id, image_id, subtype, subject_category, object_category, positive_value, round(area_ratio, 6) AS area_ratio FROM facts")
def atomic_facts(t: Tables) -> DataFrame:
    return t.facts.select("fact_id", "image_id", "subtype", "subject_category", "object_category", "positive_value", F.round("area_ratio", 6).alias("area_ratio"))


@query("C1_objects", "SELECT object_id, image_id, annotation_id, category, color, round(area_ratio, 6) AS area_ratio FROM objs")
def objects(t: Tables) -> DataFrame:
    return t.objs.select("object_id", "image_id", "annotation_id", "category", "color", F.round("area_ratio", 6).alias("area_ratio"))


@query("D1_count_maps", "SELECT image_id, string_agg(category || '=' || n, ',' ORDER BY category) AS counts, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY image_id")
def count_maps(t: Tables) -> DataFrame:
    entries = F.map_entries("counts")
    shown = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return facts.count_maps(t.cnt).select("image_id", shown.alias("counts"), total.alias("total"))


@query(
    "C2_object_relations",
    "SELECT image_id, subject_id, predicate, object_id, rel_index, round(dx, 6) AS dx, round(dy, 6) AS dy, round(iou, 6) AS iou FROM rels",
)
def object_relations(t: Tables) -> DataFrame:
    return t.rels.select("image_id", "subject_id", "predicate", "object_id", "rel_index", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "iou")])


PAIR_GEOMETRY = """
    SELECT a.image_id, a.annotation_id AS a_id, b.annotation_id AS b_id, a.name AS a_name, b.name AS b_name,
           (a.x + a.w / 2) - (b.x + b.w / 2) AS dx, (a.y + a.h / 2) - (b.y + b.h / 2) AS dy,
           greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS inter,
           a.w * a.h + b.w * b.h AS areas
    FROM ann a JOIN ann b ON a.image_id = b.image_id AND a.annotation_id {op} b.annotation_id"""


@query(
    "C3_ordered_pairs",
    "WITH g AS (" + PAIR_GEOMETRY.format(op="<>") + """)
    SELECT image_id, a_id, b_id, CASE WHEN dx / 200 > 0 THEN 'right of' ELSE 'left of' END AS relation FROM g
    WHERE a_name <> b_name AND abs(dx / 200) > 0.15 AND abs(dx / 200) > abs(dy / 200) * 1.5""",
)
def ordered_pairs(t: Tables) -> DataFrame:
    side = F.lit(200.0)

    def rule(a, b):
        return geo.relation_by_margin(a["box"], b["box"], side, side, "horizontal")

    pairs_ = facts.paired(t.ann, lambda a, b: (a["name"] != b["name"]) & rule(a, b).isNotNull(), ["name", "box"], ordered=True)
    return pairs_.select("image_id", F.col("a.annotation_id").alias("a_id"), F.col("b.annotation_id").alias("b_id"), rule(F.col("a"), F.col("b")).alias("relation"))


@query(
    "B9_relation_modes",
    "WITH g AS (" + PAIR_GEOMETRY.format(op="<") + """), i AS (SELECT *, CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END AS iou FROM g),
    m AS (SELECT
      coalesce(CASE WHEN iou > 0.20 THEN NULL WHEN abs(dx) >= abs(dy) AND abs(dx) >= 20 THEN CASE WHEN dx < 0 THEN 'left of' ELSE 'right of' END
           WHEN abs(dy) > abs(dx) AND abs(dy) >= 20 THEN CASE WHEN dy < 0 THEN 'above' ELSE 'below' END END, '') AS share_mode,
      CASE WHEN iou > 0.05 THEN '~overlap' WHEN abs(dx) > 50 AND abs(dx) > abs(dy) * 2 THEN CASE WHEN dx < 0 THEN 'left_of' ELSE 'right_of' END
           WHEN abs(dy) > 50 AND abs(dy) > abs(dx) * 2 THEN CASE WHEN dy < 0 THEN 'above' ELSE 'below' END
           WHEN abs(dx) >= abs(dy) THEN '~ambiguous_horizontal' ELSE '~ambiguous_vertical' END AS sure_mode,
      coalesce(CASE WHEN abs(dx) >= 35 AND abs(dx) >= abs(dy) * 1.5 THEN CASE WHEN dx > 0 THEN 'right of' ELSE 'left of' END
           WHEN abs(dy) >= 35 AND abs(dy) >= abs(dx) * 1.5 THEN CASE WHEN dy > 0 THEN 'below' ELSE 'above' END END, '') AS offset_mode FROM i)
    SELECT share_mode, sure_mode, offset_mode, count(*) AS n FROM m GROUP BY ALL""",
)
def relation_modes(t: Tables) -> DataFrame:
    side = F.lit(200.0)
    both = facts.paired(t.ann, lambda a, b: F.lit(True), ["box"])
    a, b = F.col("a.box"), F.col("b.box")
    shown = both.select(
        F.coalesce(geo.relation_by_image_share(a, b, side, side), F.lit("")).alias("share_mode"),
        geo.relation_high_confidence(a, b, side, side).alias("sure_mode"),
        F.coalesce(geo.relation_by_offset(a, b), F.lit("")).alias("offset_mode"),
    )
    return shown.groupBy("share_mode", "sure_mode", "offset_mode").agg(F.count("*").alias("n"))


@query(
    "B8_box_geometry",
    "SELECT annotation_id, image_id, round(w * h / 40000, 6) AS area_ratio, x + w / 2 AS cx, round(y + h / 2, 6) AS cy, round((x + w / 2) / 200, 6) AS ncx FROM ann",
)
def box_geometry(t: Tables) -> DataFrame:
    box, side = F.col("box"), F.lit(200.0)
    return t.ann.select(
        "annotation_id", "image_id", F.round(geo.area_ratio(box["w"], box["h"], side, side), 6).alias("area_ratio"),
        geo.center_x(box).alias("cx"), F.round(geo.center_y(box), 6).alias("cy"), F.round(geo.center_x(box) / side, 6).alias("ncx"),
    )


@query(
    "B10_hygiene",
    """SELECT CASE WHEN crowd THEN 'crowd' WHEN w <= 1 OR h <= 1 THEN 'invalid_bbox' WHEN w * h / 40000 <= 0.005 THEN 'too_small'
              WHEN w * h / 40000 >= 0.5 THEN 'too_large' ELSE '' END AS reason, count(*) AS n FROM ann JOIN images USING (image_id) GROUP BY ALL""",
)
def hygiene(t: Tables) -> DataFrame:
    reason = F.coalesce(facts.hygiene_reason("strict"), F.lit(""))
    return t.ann.join(t.images, "image_id").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "E13_representatives",
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY image_id, category) AS n FROM ann),
    r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id, category ORDER BY w * h DESC, annotation_id) = 1),
    u AS (SELECT *, count(*) FILTER (WHERE n = 1) OVER (PARTITION BY image_id) AS uniques FROM r)
    SELECT image_id, category, annotation_id, n FROM u WHERE uniques < 2 OR n = 1""",
)
def representatives(t: Tables) -> DataFrame:
    return facts.representatives(t.ann).select("image_id", "category", "annotation_id", "n")


@query("E20_candidate_pool", "SELECT category, CAST(pos AS BIGINT) AS pos, candidate FROM bank")
def candidate_pool(t: Tables) -> DataFrame:
    return t.bank


@query("E18_first_admissible", "SELECT image_id, category, negative FROM catneg")
def first_admissible(t: Tables) -> DataFrame:
    each = t.cnt.select("image_id", "category")
    visible = each.groupBy("image_id").agg(F.collect_set("category").alias("visible"))
    joined = each.join(visible, "image_id").join(banks.bank_arrays(t.bank), "category")
    return joined.select("image_id", "category", banks.first_admissible(F.col("candidates"), F.col("visible"), F.col("category")).alias("negative"))


@query(
    "B14_bank_violations",
    """WITH b AS (SELECT p_name AS category, list(p_brand ORDER BY p_partkey) AS c FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) <= length(p_name) % 7) GROUP BY p_name)
    SELECT category, 'too_few' AS rule FROM b WHERE len(c) < 5 UNION ALL SELECT category, 'duplicates' FROM b WHERE len(list_distinct(c)) < len(c)
    UNION ALL SELECT category, 'no_supercategory' FROM b WHERE category LIKE 'r%'""",
)
def bank_violations(t: Tables) -> DataFrame:
    # A bank entry is a short list: the first brands of each name, a different number for names of different length.
    short = top_k(t.part, ["p_name"], ["p_partkey"], 6).filter(F.col("rank") <= F.length("p_name") % 7)
    bank = short.groupBy(F.col("p_name").alias("category")).agg(F.collect_list("p_brand").alias("candidates"))
    bank = bank.withColumn("semantic_group", F.lit("g")).withColumn("supercategory", F.when(F.col("category").startswith("r"), "").otherwise("s"))
    return banks.bank_violations(bank)


@query(
    "A15_B13_template_usage",
    "SELECT t.subtype, t.template_id, count(p.pair_id) AS used FROM tpl t LEFT JOIN pairs p ON p.template_id = t.template_id GROUP BY ALL",
)
def template_usage(t: Tables) -> DataFrame:
    bank = banks.template_bank(t.spark)
    if banks.template_violations(bank).limit(1).count():
        raise ValueError("template bank is not valid")
    used = stages(t)["unbalanced"].groupBy("template_id").agg(F.count("*").alias("used"))
    return bank.join(used, "template_id", "left").select("subtype", "template_id", F.coalesce("used", F.lit(0)).alias("used"))


__all__ = ["fixed", "stages"]
