"""Sampling, splitting, balancing, profiles and audits (sections B12, B17, C5, C8, C9, C14, D2-D9, D29-D31, E3, E5-E12, E14, E17, E19, F2-F4, F6, F7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.operators import absent, facts, joins, ordering, profile, sampling, selection, sets, splitting, validate
from pairloom.plans.bind import Tables
from pairloom.plans.q_metrics import rounded
from pairloom.plans.q_text import case, listed
from pairloom.plans.registry import query
from pairloom.session import pinned

NUM = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def types_of(t: Tables) -> list[str]:
    return joins.vocabulary_of(t.part, "p_type")


def presence(t: Tables) -> DataFrame:
    return joins.absent_values(t.objs.select("image_id", "category"), types_of(t))


def types(t: Tables) -> DataFrame:
    """The vocabulary of categories as a table."""
    return t.part.select(F.col("p_type").alias("category"))


def has_types(t: Tables) -> DataFrame:
    """The categories of every image, sorted."""
    return t.objs.groupBy("image_id").agg(F.sort_array(F.collect_set("category")).alias("present"))


PRESENCE = """pr AS (SELECT image_id, list_sort(list(DISTINCT category)) AS present FROM objs GROUP BY image_id), vv AS (SELECT list_sort(list(DISTINCT p_type)) AS every FROM part),
    ab AS (SELECT image_id, present, list_filter(every, lambda x: NOT list_contains(present, x)) AS absent FROM pr, vv)"""


@query("E5_seeded_sample", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY md5('11|' || o_orderkey), o_orderkey LIMIT 500")
def e5(t: Tables) -> DataFrame:
    return sampling.sample(t.orders.select("o_orderkey", "o_orderpriority"), 11, 500, "o_orderkey")


@query("E5_seeded_flip", "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5('3|' || o_orderkey), 1, 4) AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS flip FROM orders")
def e5_flip(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(ordering.seeded_flip(3, "o_orderkey"), 1).otherwise(0).alias("flip"))


@query("E6_stratified_sample", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('11|' || o_orderkey), o_orderkey) AS rank FROM orders QUALIFY rank <= 20")
def e6(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], 20, 11, "o_orderkey")


@query(
    "E7_ratio_split",
    """WITH r AS (SELECT image_id, priority, row_number() OVER (PARTITION BY priority ORDER BY md5('5|' || image_id), image_id) AS r, count(*) OVER (PARTITION BY priority) AS n FROM images)
    SELECT image_id, priority, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def e7(t: Tables) -> DataFrame:
    return sampling.ratio_split(t.images.select("image_id", "priority"), "image_id", {"train": 0.8, "val": 0.1, "test": 0.1}, 5, ["priority"])


GROUP_SPLIT = """c AS (SELECT image_id, category AS subtype, n FROM cnt),
    sh AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS num_pairs, arg_max(subtype, (n, subtype)) AS dominant FROM c GROUP BY image_id),
    st AS (SELECT *, dominant || '/' || CAST(CAST(floor(log2(num_pairs)) AS BIGINT) AS VARCHAR) AS stratum FROM sh),
    cu AS (SELECT *, sum(num_pairs) OVER (PARTITION BY stratum ORDER BY md5('42|' || image_id), image_id ROWS UNBOUNDED PRECEDING) AS cum, sum(num_pairs) OVER (PARTITION BY stratum) AS total FROM st),
    sp AS (SELECT image_id, CASE WHEN (cum - num_pairs / 2) / total <= 0.8 THEN 'train' WHEN (cum - num_pairs / 2) / total <= 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split, num_pairs, stratum FROM cu)"""
RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def splits(t: Tables) -> DataFrame:
    rows = t.objs.select("image_id", F.col("category").alias("subtype"))
    return sampling.group_split(rows, RATIOS)


@query("E8_group_split", f"WITH {GROUP_SPLIT} SELECT image_id, split, num_pairs, stratum FROM sp")
def e8(t: Tables) -> DataFrame:
    return splits(t)


#: The greedy as a recursion over the largest groups; a state is the rows, groups and rows a subtype of the three splits.
PENALTY_SPLIT = """pc AS (SELECT image_id, category AS subtype, n FROM cnt),
    pg AS (SELECT list(subtype ORDER BY subtype) AS names, list(g ORDER BY subtype) AS gs, CAST(sum(g) AS BIGINT) AS total, count(*) AS k FROM (SELECT subtype, sum(n) AS g FROM pc GROUP BY subtype)),
    ps AS (SELECT image_id, CAST(sum(n) AS BIGINT) AS num_pairs, arg_max(subtype, (n, subtype)) AS stratum, map(list(subtype), list(n)) AS own FROM pc GROUP BY image_id),
    ph AS (SELECT *, row_number() OVER (ORDER BY num_pairs DESC, md5('42|' || image_id), image_id) AS i FROM ps QUALIFY i <= 1000),
    pv AS (SELECT ph.i, ph.num_pairs, list_transform(names, lambda x: coalesce(own[x], 0)) AS v, gs, total, k FROM ph, pg),
    RATIO AS (SELECT [0.8::DOUBLE, 0.1, 0.1] AS r, ['train', 'val', 'test'] AS s),
    st(i, pairs, groups, subs, chosen) AS (
      SELECT CAST(0 AS BIGINT), [0::BIGINT, 0, 0], [0::BIGINT, 0, 0], list_transform([1, 2, 3], lambda z: list_transform(range(k), lambda y: 0::BIGINT)), 0 FROM pg
      UNION ALL
      SELECT i, list_transform([1, 2, 3], lambda z: pairs[z] + CASE WHEN z = c THEN num_pairs ELSE 0 END), list_transform([1, 2, 3], lambda z: groups[z] + CASE WHEN z = c THEN 1 ELSE 0 END),
             list_transform([1, 2, 3], lambda z: CASE WHEN z = c THEN list_transform(list_zip(subs[z], v), lambda q: q[1] + q[2]) ELSE subs[z] END), c
      FROM (SELECT pv.i, pairs, groups, subs, num_pairs, v,
              list_sort(list_transform([1, 2, 3], lambda z: {'o': pairs[z] + num_pairs > total * r[z], 'p': round(
                  abs(pairs[z] + num_pairs - greatest(total * r[z], 1.0)) / greatest(total * r[z], 1.0) + 2 * greatest(pairs[z] + num_pairs - greatest(total * r[z], 1.0), 0.0) / greatest(total * r[z], 1.0)
                  + list_sum(list_transform(list_zip(subs[z], v, gs), lambda q: abs(q[1] + q[2] - greatest(q[3] * r[z], 1.0)) / greatest(q[3] * r[z], 1.0) + greatest(q[1] + q[2] - greatest(q[3] * r[z], 1.0), 0.0) / greatest(q[3] * r[z], 1.0))) / k, 9),
                'g': groups[z], 'n': pairs[z], 's': s[z], 'z': z}))[1].z AS c
            FROM st JOIN pv ON pv.i = st.i + 1, RATIO)),
    pp AS (SELECT image_id, s[chosen] AS split, num_pairs FROM ph JOIN st USING (i), RATIO),
    pd AS (SELECT subtype AS stratum, [greatest(g * 0.8::DOUBLE - coalesce(a, 0), 0.0), greatest(g * 0.1::DOUBLE - coalesce(b, 0), 0.0), greatest(g * 0.1::DOUBLE - coalesce(c, 0), 0.0)] AS gaps
      FROM (SELECT subtype, sum(n) AS g, sum(n) FILTER (WHERE split = 'train') AS a, sum(n) FILTER (WHERE split = 'val') AS b, sum(n) FILTER (WHERE split = 'test') AS c FROM pc LEFT JOIN pp USING (image_id) GROUP BY subtype)),
    rs AS (SELECT * FROM ps WHERE image_id NOT IN (SELECT image_id FROM pp)),
    sz AS (SELECT stratum, sum(num_pairs) AS size, any_value(gaps) AS gaps FROM rs JOIN pd USING (stratum) GROUP BY stratum),
    wt AS (SELECT list_transform([1, 2, 3], lambda z: greatest(total * r[z] - coalesce(h[s[z]], 0), 0.0)) AS want FROM pg, RATIO, (SELECT map(list(split), list(n)) AS h FROM (SELECT split, sum(num_pairs) AS n FROM pp GROUP BY split))),
    fr(n, f) AS (
      SELECT 0, [1.0::DOUBLE, 1.0, 1.0]
      UNION ALL
      SELECT n + 1, list_transform([1, 2, 3], lambda z: CASE WHEN got[z] > 0 THEN f[z] * want[z] / got[z] ELSE f[z] END)
      FROM (SELECT n, f, [sum(size * x[1] / y), sum(size * x[2] / y), sum(size * x[3] / y)] AS got
            FROM (SELECT n, f, size, [gaps[1] * f[1], gaps[2] * f[2], gaps[3] * f[3]] AS x, gaps[1] * f[1] + gaps[2] * f[2] + gaps[3] * f[3] AS y FROM fr, sz WHERE n < 10) GROUP BY n, f), wt),
    bd AS (SELECT stratum, gaps[1] * f[1] / y AS a, gaps[1] * f[1] / y + gaps[2] * f[2] / y AS b FROM (SELECT stratum, gaps, f, gaps[1] * f[1] + gaps[2] * f[2] + gaps[3] * f[3] AS y FROM sz, fr WHERE n = 10)),
    pr AS (SELECT image_id, num_pairs, stratum, round((sum(num_pairs) OVER (PARTITION BY stratum ORDER BY md5('42|' || image_id), image_id ROWS UNBOUNDED PRECEDING) - num_pairs / 2) / sum(num_pairs) OVER (PARTITION BY stratum), 9) AS place FROM rs),
    pz AS (SELECT image_id, split, num_pairs, 'penalty' AS placed FROM pp
      UNION ALL SELECT image_id, CASE WHEN place <= round(a, 9) THEN 'train' WHEN place <= round(b, 9) THEN 'val' ELSE 'test' END, num_pairs, 'stratum' FROM pr JOIN bd USING (stratum))"""


def penalty_rows(t: Tables) -> DataFrame:
    return t.objs_table.select("image_id", F.col("category").alias("subtype"))


@query("E8_penalty_split", f"WITH RECURSIVE {PENALTY_SPLIT} SELECT * FROM pz")
def e8_penalty(t: Tables) -> DataFrame:
    return splitting.penalty_split(penalty_rows(t), RATIOS)


@query(
    "E8_penalty_balance",
    f"""WITH RECURSIVE {PENALTY_SPLIT}, cells AS (SELECT split, subtype, sum(n) AS n FROM pc JOIN pz USING (image_id) GROUP BY ALL), g AS (SELECT subtype, sum(n) AS g FROM pc GROUP BY subtype),
    sq AS (SELECT split, sum(num_pairs) AS num_pairs, count(*) AS num_groups FROM pz GROUP BY split), al AS (SELECT sum(g) AS a FROM g),
    mix AS (SELECT split, sum(abs(coalesce(n, 0) / num_pairs - g / a)) / 2 AS d FROM sq CROSS JOIN g CROSS JOIN al LEFT JOIN cells USING (split, subtype) GROUP BY split)
    SELECT split, num_groups, CAST(num_pairs AS BIGINT) AS num_pairs, round(num_pairs / a, 6) AS share, round(d, 6) AS mix_distance,
      abs(num_pairs / a - CASE split WHEN 'train' THEN 0.8::DOUBLE ELSE 0.1 END) <= 0.02 AS share_ok, d <= 0.02 AS mix_ok,
      (SELECT count(*) FROM pz x WHERE x.split = sq.split AND x.image_id IN (SELECT image_id FROM pz y WHERE y.split <> x.split)) AS crossing
    FROM sq JOIN mix USING (split), al""",
)
def e8_penalty_balance(t: Tables) -> DataFrame:
    rows = penalty_rows(t)
    table = splitting.split_balance(rows, pinned(splitting.penalty_split(rows, RATIOS)), RATIOS, tolerance=0.02)
    return table.withColumns({"share": F.round("share", 6), "mix_distance": F.round("mix_distance", 6)})


@query(
    "D8_C9_split_statistics",
    f"WITH {GROUP_SPLIT} SELECT split, coalesce(category, '') AS subtype, count(*) AS n, count(DISTINCT image_id) AS distinct_n FROM objs JOIN sp USING (image_id) GROUP BY GROUPING SETS ((split, category), (split))",
)
def d8(t: Tables) -> DataFrame:
    joined = t.objs.select("image_id", F.col("category").alias("subtype")).join(splits(t).select("image_id", "split"), "image_id")
    table = profile.grouped_counts(joined, [["split", "subtype"], ["split"]], "image_id")
    return table.select("split", F.coalesce("subtype", F.lit("")).alias("subtype"), "n", "distinct_n")


@query(
    "D8_template_counts",
    f"""WITH {GROUP_SPLIT} SELECT split, CASE annotation_id % 3 WHEN 0 THEN category WHEN 1 THEN lower(category) ELSE '__missing_template__' END AS template, count(*) AS n
    FROM objs JOIN sp USING (image_id) GROUP BY ALL""",
)
def d8_templates(t: Tables) -> DataFrame:
    """Rows name their template themselves, in their metadata or not at all."""
    third, none = F.col("annotation_id") % 3, F.lit("")
    named = profile.template_of(F.when(third == 0, F.col("category")).otherwise(none), F.when(third == 1, F.lower("category")), none)
    rows = t.objs.select("image_id", named.alias("template")).join(splits(t).select("image_id", "split"), "image_id")
    return rows.groupBy("split", "template").agg(F.count("*").alias("n"))


@query(
    "F3_leakage",
    "SELECT unnest(['overlap_test_train', 'overlap_test_val', 'overlap_train_val', 'missing_ids', 'duplicate_ids']) AS check, unnest([0, 0, 0, (SELECT count(*) FROM objs WHERE l_linenumber = 7), 0]) AS n",
)
def f3(t: Tables) -> DataFrame:
    rows = t.objs.select("image_id", F.col("object_id").alias("pair_id"), "annotation_id")
    # The last lines are left out on purpose, so that there are lost ids to find.
    assigned = rows.filter("annotation_id < 7000000000000000").join(splits(t).select("image_id", "split"), "image_id")
    return sets.leakage(rows, assigned)


@query(
    "E9_largest_remainder",
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), p AS (SELECT o_custkey, n, s.name, n * s.share AS exact FROM n, (VALUES ('cat', 0.5::DOUBLE), ('attr', 0.3), ('rel', 0.2)) s(name, share)),
    r AS (SELECT *, floor(exact) AS whole, row_number() OVER (PARTITION BY o_custkey ORDER BY exact - floor(exact) DESC, name DESC) AS rk, n - sum(floor(exact)) OVER (PARTITION BY o_custkey) AS rest FROM p)
    SELECT o_custkey, n, CAST(max(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END) FILTER (WHERE name = 'cat') AS BIGINT) AS cat, CAST(max(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END) FILTER (WHERE name = 'attr') AS BIGINT) AS attr,
      CAST(max(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END) FILTER (WHERE name = 'rel') AS BIGINT) AS rel FROM r GROUP BY ALL""",
)
def e9(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    m = n.withColumn("m", sampling.largest_remainder(F.col("n"), {"cat": 0.5, "attr": 0.3, "rel": 0.2}))
    return m.select("o_custkey", "n", *[F.col("m")[k].alias(k) for k in ("cat", "attr", "rel")])


@query(
    "E10_bucket_quota",
    """WITH b AS (SELECT image_id, annotation_id, ['horizontal', 'horizontal', 'vertical', 'depth', 'contact', 'interaction'][CAST(l_orderkey % 3 + l_linenumber % 4 + 1 AS INTEGER)] AS bucket FROM ann),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id, bucket ORDER BY annotation_id) AS r, CASE bucket WHEN 'horizontal' THEN 2 WHEN 'depth' THEN 1 WHEN 'contact' THEN 1 ELSE 0 END AS q,
      CASE bucket WHEN 'horizontal' THEN 0 WHEN 'vertical' THEN 1 WHEN 'depth' THEN 2 WHEN 'contact' THEN 3 WHEN 'interaction' THEN 4 ELSE 5 END AS bo FROM b),
    s AS (SELECT *, CASE WHEN r <= q THEN 0 ELSE 1 END AS pass, greatest(r - q, 0) AS rd FROM r)
    SELECT image_id, annotation_id, bucket, row_number() OVER (PARTITION BY image_id ORDER BY pass, rd, bo, r) AS pick FROM s WHERE pass = 0 OR bucket <> 'horizontal' QUALIFY pick <= 4""",
)
def e10(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("horizontal", "horizontal", "vertical", "depth", "contact", "interaction")))
    line = F.floor(F.col("annotation_id") / 1000000000000000)
    bucket = F.get(names, (F.col("image_id").cast("long") % 3 + line % 4).cast("int"))
    rows = t.ann.select("image_id", "annotation_id", bucket.alias("bucket"))
    return sampling.bucket_quota(rows, "image_id", "bucket", 4, ["annotation_id"])


@query(
    "E11_disjoint_types",
    """WITH a AS (SELECT image_id, 'rel' AS type FROM (SELECT DISTINCT image_id FROM rels) ORDER BY md5('8|' || image_id), image_id LIMIT 300),
    b AS (SELECT image_id, 'attr' AS type FROM (SELECT DISTINCT image_id FROM objs WHERE color IS NOT NULL) WHERE image_id NOT IN (SELECT image_id FROM a) ORDER BY md5('8|' || image_id), image_id LIMIT 400),
    c AS (SELECT image_id, 'cat' AS type FROM (SELECT DISTINCT image_id FROM objs) WHERE image_id NOT IN (SELECT image_id FROM a) AND image_id NOT IN (SELECT image_id FROM b) ORDER BY md5('8|' || image_id), image_id LIMIT 500)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def e11(t: Tables) -> DataFrame:
    eligible = {"rel": facts.relations(t.objs), "attr": t.objs.filter("color is not null"), "cat": t.objs}
    return sampling.disjoint_groups(eligible, {"rel": 300, "attr": 400, "cat": 500}, "image_id", 8)


@query(
    "E12_yes_no_balanced",
    """WITH c AS (SELECT image_id, annotation_id AS id, CASE WHEN category < 'N' THEN 'yes' ELSE 'no' END AS answer FROM ann),
    o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id, answer ORDER BY md5('4|' || image_id || '|' || answer || '|' || id), id) = 1)
    SELECT image_id, id, answer FROM o QUALIFY row_number() OVER (PARTITION BY answer ORDER BY md5('4|' || image_id), image_id) <= CASE answer WHEN 'yes' THEN 1500 ELSE 700 END""",
)
def e12(t: Tables) -> DataFrame:
    rows = t.ann.select("image_id", F.col("annotation_id").alias("id"), F.when(F.col("category") < "N", "yes").otherwise("no").alias("answer"))
    return sampling.yes_no_balanced(rows, "image_id", "answer", {"yes": 1500, "no": 700}, 4, "id")


@query(
    "E12_shortfall",
    """WITH n AS (SELECT CASE WHEN category < 'N' THEN 'yes' ELSE 'no' END AS answer, count(DISTINCT image_id) AS n FROM ann GROUP BY 1),
    w AS (SELECT * FROM (VALUES ('yes', 15000), ('no', 700), ('unsure', 5)) t(answer, target))
    SELECT answer, greatest(target - least(coalesce(n, 0), target), 0) AS missing FROM w LEFT JOIN n USING (answer)""",
)
def e12_shortfall(t: Tables) -> DataFrame:
    targets = {"yes": 15000, "no": 700, "unsure": 5}
    rows = t.ann.select("image_id", F.col("annotation_id").alias("id"), F.when(F.col("category") < "N", "yes").otherwise("no").alias("answer"))
    return sampling.shortfall(sampling.yes_no_balanced(rows, "image_id", "answer", targets, 4, "id"), "answer", targets)


@query(
    "E14_deduplicate",
    """WITH s AS (SELECT o_orderkey, CAST(o_custkey % 200 AS VARCHAR) AS row_id, o_orderpriority, o_orderstatus FROM orders),
    u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY row_id, o_orderpriority, o_orderstatus ORDER BY o_orderkey) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY o_orderkey) AS r FROM u)
    SELECT o_orderkey, CASE WHEN r = 1 THEN row_id ELSE row_id || '_dup' || r END AS row_id, o_orderpriority, o_orderstatus FROM r""",
)
def e14(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 200).cast("string").alias("row_id"), "o_orderpriority", "o_orderstatus")
    return sampling.deduplicated(rows, ["row_id", "o_orderpriority", "o_orderstatus"], "row_id", ["o_orderkey"])


@query(
    "C8_absent_values",
    f"WITH {PRESENCE} SELECT image_id, array_to_string(present, ',') AS present, array_to_string(absent, ',') AS absent FROM ab",
)
def c8(t: Tables) -> DataFrame:
    return presence(t).select("image_id", F.array_join("present", ",").alias("present"), F.array_join("absent", ",").alias("absent"))


COOC = """co AS (SELECT a.category AS a, b.category AS b, count(*) AS n FROM (SELECT DISTINCT image_id, category FROM objs) a JOIN (SELECT DISTINCT image_id, category FROM objs) b ON a.image_id = b.image_id AND a.category <> b.category GROUP BY ALL)"""


@query("D4_cooccurrence", f"WITH {COOC} SELECT a, b, n FROM co")
def d4(t: Tables) -> DataFrame:
    return sampling.cooccurrence(has_types(t))


@query(
    "E17_hard_negatives",
    f"""WITH {PRESENCE}, {COOC}, pop AS (SELECT category, row_number() OVER (ORDER BY sum(n) DESC, category) AS r FROM cnt GROUP BY category),
    rn AS (SELECT *, absent[CAST({NUM.format("'6|' || image_id")} % len(absent) + 1 AS INTEGER)] AS rnd FROM ab WHERE len(absent) > 0),
    pp AS (SELECT image_id, min_by(pop.category, r) AS popular FROM rn JOIN pop ON list_contains(absent, pop.category) GROUP BY image_id),
    sc AS (SELECT rn.image_id, co.b, sum(co.n) AS s FROM (SELECT image_id, absent, unnest(present) AS a FROM rn) rn JOIN co ON co.a = rn.a AND list_contains(rn.absent, co.b) GROUP BY ALL),
    hd AS (SELECT image_id, list_sort(list(b)) AS hs FROM (SELECT *, max(s) OVER (PARTITION BY image_id) AS m FROM sc) WHERE s = m GROUP BY image_id)
    SELECT rn.image_id, rnd AS random_negative, coalesce(popular, rnd) AS popular_negative, CASE WHEN popular IS NULL THEN 'popular_fallback_random' ELSE 'popular_absent' END AS popular_strategy,
      coalesce(hs[CAST({NUM.format("'6|' || rn.image_id")} % len(hs) + 1 AS INTEGER)], rnd) AS hard_negative, CASE WHEN hs IS NULL THEN 'hard_fallback_random' ELSE 'cooccurrence_hard_absent' END AS hard_strategy
    FROM rn LEFT JOIN pp USING (image_id) LEFT JOIN hd USING (image_id)""",
)
def e17(t: Tables) -> DataFrame:
    popular = t.cnt.groupBy("category").agg(F.sum("n").alias("n"))
    return absent.hard_negatives(t.objs.select("image_id", "category"), types(t), popular, 6)


@query(
    "D6_negative_hardness",
    f"""WITH {PRESENCE}, {COOC}, ng AS (SELECT image_id, present, absent, absent[CAST({NUM.format("'6|' || image_id")} % len(absent) + 1 AS INTEGER)] AS negative FROM ab WHERE len(absent) > 0),
    cand AS (SELECT image_id, present, negative, unnest(absent) AS c FROM ng), sc AS (SELECT cand.image_id, negative, c, coalesce(max(co.n), 0) AS n FROM cand LEFT JOIN co ON co.b = cand.c AND list_contains(cand.present, co.a) GROUP BY ALL)
    SELECT image_id AS row_id, negative, rank, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, c DESC) AS rank FROM sc) WHERE c = negative""",
)
def d6(t: Tables) -> DataFrame:
    index = absent.indexed(types(t), "category")
    images = pinned(absent.presence(t.objs, index))
    chosen = absent.with_random(images, index, 6, "negative").filter("negative IS NOT NULL").select("image_id", F.col("image_id").alias("row_id"), "negative")
    return absent.negative_hardness(chosen, images, index)


@query(
    "E19_wrong_values",
    f"""WITH v AS (SELECT DISTINCT p_name AS w, split_part(p_name, ' ', 1) AS b FROM part), own AS (SELECT image_id, list(DISTINCT name) AS own FROM ann GROUP BY image_id),
    f AS (SELECT image_id, min_by(name, annotation_id) AS value FROM ann GROUP BY image_id), x AS (SELECT f.image_id, value, own, split_part(value, ' ', 1) AS b FROM f JOIN own USING (image_id)),
    s AS (SELECT x.image_id, value, list(w ORDER BY w) FILTER (WHERE v.b = x.b) AS same, list(w ORDER BY w) AS anyw FROM x JOIN v ON NOT list_contains(own, w) GROUP BY ALL)
    SELECT image_id, value, CASE WHEN same IS NULL THEN anyw[CAST({NUM.format("'2|' || image_id")} % len(anyw) + 1 AS INTEGER)] ELSE same[CAST({NUM.format("'2|' || image_id")} % len(same) + 1 AS INTEGER)] END AS wrong FROM s""",
)
def e19(t: Tables) -> DataFrame:
    words = t.part.select(F.col("p_name").alias("word"), F.substring_index("p_name", " ", 1).alias("bucket"))
    own = t.ann.groupBy("image_id").agg(F.collect_set("name").alias("own"), F.min_by("name", "annotation_id").alias("value"))
    rows = own.withColumn("bucket", F.substring_index("value", " ", 1))
    return absent.wrong_values(rows, words, 2, "image_id").select("image_id", "value", "wrong")


@query("E3_capped_selection")
def e3(t: Tables) -> DataFrame:
    """Selection under four caps at once; the tests check that every cap holds."""
    from pairloom.operators import builders

    # The caps read six columns; the texts of a pair are not put together for the candidates.
    pairs = builders.clean_pairs(t.scenes_table, t.edges_table).select("pair_id", "subtype", "b_object", "b_subject", "b_value", "b_predicate")
    return builders.selected_pairs(pairs, 400)


@query(
    "E3_seeded_selection",
    """WITH RECURSIVE so AS (SELECT object_id, substr(brand, 1, 7) AS subtype, category, brand, color,
      row_number() OVER (PARTITION BY substr(brand, 1, 7) ORDER BY md5('9|' || object_id), object_id) AS i FROM objs),
    pass(subtype, i, cats, brands, colors, n, hit) AS (
      SELECT subtype, CAST(0 AS BIGINT), []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], 0, false FROM so GROUP BY subtype
      UNION ALL
      SELECT subtype, i, CASE WHEN ok THEN list_append(cats, category) ELSE cats END, CASE WHEN ok THEN list_append(brands, brand) ELSE brands END, CASE WHEN ok THEN list_append(colors, color) ELSE colors END, n + ok::INT, ok
      FROM (SELECT so.subtype, so.i, cats, brands, colors, n, category, brand, color,
              len(list_filter(cats, lambda x: x = category)) < 2 AND len(list_filter(brands, lambda x: x = brand)) < 60 AND (color IS NULL OR len(list_filter(colors, lambda x: x = color)) < 12) AS ok
            FROM pass JOIN so ON so.subtype = pass.subtype AND so.i = pass.i + 1 WHERE n < 240))
    SELECT object_id, so.subtype, category, brand, color FROM so JOIN pass USING (subtype, i) WHERE hit""",
)
def e3_seeded(t: Tables) -> DataFrame:
    """Under three caps at once, the rows that one pass in seeded order takes."""
    rows = t.objs.select("object_id", F.substring("brand", 1, 7).alias("subtype"), "category", "brand", "color")
    return sampling.capped_selection(rows, ["subtype"], {"category": 2, "brand": 60, "color": 12}, 240, 9, ["object_id"])


@query("B12_row_violations", "SELECT CAST(doc_id AS VARCHAR) AS row_id, 'enum:lang' AS rule FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT text, 'duplicate:text' FROM documents GROUP BY text HAVING count(*) > 1")
def b12(t: Tables) -> DataFrame:
    return validate.violations(t.documents, "doc_id", ["doc_id", "text"], {"lang": ("en", "fr")}, ["text"])


@query(
    "B17_shards",
    "SELECT doc_id, row_index FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents) WHERE row_index % 4 = 1",
)
def b17(t: Tables) -> DataFrame:
    return validate.shard(validate.indexed(t.documents.select("source", "doc_id"), ["source", "doc_id"]), "row_index", 4, 1).select("doc_id", "row_index")


@query(
    "C5_official_queries",
    """WITH q AS (SELECT lang AS category, CASE WHEN doc_id % 10 = 0 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS query, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'i.jpg' END AS image FROM documents),
    j AS (SELECT q.*, TRY_CAST(q.id AS BIGINT) AS qid, l.doc_id AS found, CASE WHEN l.toxic = 1 OR l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS label FROM q LEFT JOIN labels l ON l.doc_id = TRY_CAST(q.id AS BIGINT)),
    r AS (SELECT *, CASE WHEN qid IS NULL THEN 'missing_id' WHEN found IS NULL THEN 'missing_annotation' WHEN label IS NULL THEN 'missing_yes_no_label' WHEN trim(query) = '' THEN 'missing_question' WHEN image = '' THEN 'missing_image' END AS reason FROM j)
    SELECT category, qid AS question_id, label, reason FROM (SELECT *, row_number() OVER (PARTITION BY category, reason IS NULL ORDER BY qid) AS rk FROM r) WHERE reason IS NOT NULL OR rk <= 25""",
)
def c5(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    queries = t.documents.select(
        F.col("lang").alias("category"), F.when(d % 10 == 0, F.concat(F.lit("x"), d)).otherwise(d.cast("string")).alias("id"), F.when(d % 7 == 0, " ").otherwise(F.col("source")).alias("query"),
        F.when(d % 11 == 0, "").otherwise("i.jpg").alias("image"),
    )
    truth = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "?").when(F.col("quality") == 1, "yes").otherwise("no").alias("truth"))
    return joins.official_queries(queries, truth, 25).select("category", "question_id", "label", "reason")


@query(
    "C4_edge_targets",
    """SELECT relation, CASE WHEN o.object_id IS NULL THEN 'missing_relation_target' WHEN o.name = s.name THEN 'same_name' ELSE 'ok' END AS outcome, count(*) AS n
       FROM edges e JOIN sg s ON s.image_id = e.image_id AND s.object_id = e.subject_id LEFT JOIN sg o ON o.image_id = e.image_id AND o.object_id = e.target_id GROUP BY ALL""",
)
def c4(t: Tables) -> DataFrame:
    named = joins.with_targets(t.edges, t.sg)
    outcome = F.when(F.col("object_name").isNull(), "missing_relation_target").when(F.col("object_name") == F.col("subject_name"), "same_name").otherwise("ok")
    return named.groupBy("relation", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "C11_best_segment",
    """WITH s AS (SELECT image_id, category, annotation_id % 1000000 AS segment_id, x + 3 AS x, y, w, h, annotation_id AS pos FROM ann WHERE l_linenumber % 2 = 1),
    p AS (SELECT a.image_id, a.annotation_id, s.segment_id, s.pos, greatest(least(a.x + a.w, s.x + s.w) - greatest(a.x, s.x), 0) * greatest(least(a.y + a.h, s.y + s.h) - greatest(a.y, s.y), 0) AS i, a.w * a.h AS aa, s.w * s.h AS sa,
      CASE WHEN a.x + a.w / 2 BETWEEN s.x AND s.x + s.w AND a.y + a.h / 2 BETWEEN s.y AND s.y + s.h THEN 1.0 ELSE 0 END AS inside FROM ann a JOIN s ON a.image_id = s.image_id AND a.category = s.category),
    c AS (SELECT *, i / (aa + sa - i) * 10 + inside + greatest(0, 1 - abs(sa - aa) / greatest(aa, sa)) AS score FROM p)
    SELECT image_id, annotation_id, arg_max(segment_id, (score, -pos)) AS segment_id, round(max(score), 6) AS score FROM c GROUP BY ALL""",
)
def c11(t: Tables) -> DataFrame:
    box = F.col("box")
    moved = F.struct((box["x"] + 3).alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"))
    area = box["w"] * box["h"]
    line = F.floor(F.col("annotation_id") / 1000000000000000)
    segments = t.ann.filter(line % 2 == 1).select("image_id", "category", (F.col("annotation_id") % 1000000).alias("segment_id"), moved.alias("box"), area.alias("area"), F.col("annotation_id").alias("pos"))
    return rounded(facts.best_segment(t.ann.withColumn("area", area), segments), "score")


@query(
    "C12_segment_colors",
    """WITH px AS (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey AS pos, l_partkey % 256 AS r, l_suppkey * 7 % 256 AS g, CAST(l_quantity * 5 AS BIGINT) AS b, l_linenumber, l_suppkey FROM lineitem),
    px1 AS (SELECT image_id, pos, max(r) AS r, max(g) AS g, max(b) AS b, max(l_linenumber) % 2 AS segment_id FROM px GROUP BY ALL),
    mk AS (SELECT * FROM px1 WHERE NOT (image_id % 5 = 0 AND segment_id = 0))
    SELECT m.image_id, m.segment_id, round(avg(p.r), 6) AS r, round(avg(p.g), 6) AS g, round(avg(p.b), 6) AS b FROM mk m JOIN px1 p USING (image_id, pos)
    WHERE m.image_id IN (SELECT a.image_id FROM (SELECT image_id, count(*) AS n FROM px1 GROUP BY ALL) a JOIN (SELECT image_id, count(*) AS n FROM mk GROUP BY ALL) b ON a.image_id = b.image_id AND a.n = b.n) GROUP BY ALL""",
)
def c12(t: Tables) -> DataFrame:
    raw = t.lineitem.groupBy(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos")).agg(
        F.max(F.col("l_partkey") % 256).alias("r"), F.max(F.col("l_suppkey") * 7 % 256).alias("g"), F.max((F.col("l_quantity") * 5).cast("long")).alias("b"), (F.max("l_linenumber") % 2).alias("segment_id")
    )
    mask = raw.filter("not (image_id % 5 = 0 and segment_id = 0)").select("image_id", "pos", "segment_id")
    return rounded(facts.segment_colors(raw.drop("segment_id"), mask).drop("color"))


@query(
    "C14_version_diff",
    "SELECT coalesce(d.doc_id, b.item_id) AS row_index, md5(d.text) AS ours, md5(b.text) AS theirs FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id WHERE md5(d.text) IS DISTINCT FROM md5(b.text)",
)
def c14(t: Tables) -> DataFrame:
    old = t.documents.select(F.col("doc_id").alias("row_index"), F.md5("text").alias("signature"))
    return joins.version_diff(old, t.benchmark.select(F.col("item_id").alias("row_index"), F.md5("text").alias("signature")))


@query(
    "C13_enriched_rows",
    "SELECT c.conv_id, c.turn, coalesce(CASE WHEN l.quality = 1 THEN 'cached ' || l.doc_id END, 'made ' || d.lang) AS caption, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS cache_hit FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN labels l ON l.doc_id = c.conv_id",
)
def c13(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.col("conv_id").alias("image_id"))
    made = t.documents.select(F.col("doc_id").alias("image_id"), F.concat(F.lit("made "), "lang").alias("caption"))
    cache = t.labels.filter("quality = 1").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("cached "), "doc_id").alias("caption"))
    return joins.enriched(rows, made, cache).select("conv_id", "turn", "caption", F.col("cache_hit").cast("int").alias("cache_hit"))


@query(
    "D2_image_profiles",
    """SELECT image_id, count(*) AS num_pairs, count(*) FILTER (WHERE category = 'ECONOMY') AS "n_ECONOMY", count(*) FILTER (WHERE category = 'PROMO') AS "n_PROMO", min(annotation_id) AS first,
       (SELECT string_agg(c, ',' ORDER BY o) FROM (SELECT category AS c, min(annotation_id) AS o FROM objs i WHERE i.image_id = x.image_id GROUP BY category)) AS categories FROM objs x GROUP BY image_id""",
)
def d2(t: Tables) -> DataFrame:
    rows = t.objs.withColumn("subtype", F.col("category"))
    table = profile.image_profile(rows, ["ECONOMY", "PROMO"], "annotation_id")
    return table.join(profile.first_categories(t.objs), "image_id").withColumn("categories", F.array_join("categories", ","))


@query("D3_vocabulary", "SELECT name, count(*) AS n FROM ann GROUP BY name HAVING count(*) >= 900")
def d3(t: Tables) -> DataFrame:
    return profile.supported_values(t.ann, "name", 900)


@query("D5_conditional_modes", "SELECT category, color, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, color) AS rank FROM objs WHERE color IS NOT NULL GROUP BY category, color")
def d5(t: Tables) -> DataFrame:
    return profile.conditional_modes(t.objs, "category", "color")


@query(
    "D7_label_usage",
    "SELECT subtype, label_key, n, rank FROM (SELECT subtype, coalesce(rel_pattern, anchor_label) AS label_key, count(*) AS n, row_number() OVER (PARTITION BY subtype ORDER BY count(*) DESC, coalesce(rel_pattern, anchor_label)) AS rank FROM bal GROUP BY 1, 2) WHERE rank <= 5",
)
def d7(t: Tables) -> DataFrame:
    from pairloom.plans.q_pairs import pair_columns, stages

    return profile.top_values(pair_columns(stages(t)["balanced"]), ["subtype"], "label_key", 5)


@query(
    "D9_dataset_profile",
    """SELECT CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level, coalesce(lang, '') AS lang, coalesce(source, '') AS source, count(*) AS n, count(DISTINCT n_chars) AS distinct_n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""",
)
def d9(t: Tables) -> DataFrame:
    table = profile.grouped_counts(t.documents, [["lang", "source"], ["lang"], ["source"], []], "n_chars")
    return table.withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})


@query(
    "D9_top_values",
    "SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY lang, source QUALIFY rank <= 3",
)
def d9_top(t: Tables) -> DataFrame:
    return profile.top_values(t.documents, ["lang"], "source", 3)


@query(
    "D29_quality_gate",
    """WITH c AS (SELECT subtype, count(*) AS n, count(*) FILTER (WHERE label = 'yes') AS yes FROM base GROUP BY subtype), t(subtype, target) AS (VALUES ('cat_random', 100), ('attr_color', 100000), ('attr_count', 150), ('missing_one', 10)),
    j AS (SELECT t.subtype, target, coalesce(n, 0) AS n, coalesce(yes, 0) AS yes FROM t LEFT JOIN c USING (subtype)),
    r AS (SELECT 'empty:' || subtype AS rule, 2 AS sev, n = 0 AS broken FROM j WHERE subtype = 'missing_one' UNION ALL SELECT 'coverage_below_70:' || subtype, 2, n / target < 0.7 FROM j WHERE subtype = 'cat_random'
      UNION ALL SELECT 'coverage_below_50:' || subtype, 1, n > 0 AND n / target < 0.5 FROM j UNION ALL SELECT 'yes_share:' || subtype, 1, n > 0 AND NOT (yes / n BETWEEN 0.45 AND 0.55) FROM j)
    SELECT CASE max(CASE WHEN broken THEN sev ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (WHERE broken), '') AS reasons FROM r""",
)
def d29(t: Tables) -> DataFrame:
    counts = t.base.groupBy("subtype").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "yes").alias("yes"))
    targets = {"cat_random": 100, "attr_color": 100000, "attr_count": 150, "missing_one": 10}
    return selection.gate(selection.coverage_rules(counts, targets, ["missing_one"], ["cat_random"]))


@query(
    "D29_imbalance_warnings",
    "SELECT lang, round(max(n) / min(n), 6) AS ratio FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang HAVING count(*) >= 2 AND max(n) / min(n) > 2",
)
def d29_warn(t: Tables) -> DataFrame:
    return rounded(profile.imbalance_warnings(t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")), "lang", "source", 2.0))


@query(
    "D30_audits",
    f"""WITH d AS (SELECT lang, lower(text) AS t FROM documents), w AS (SELECT lang, regexp_extract_all(t, '([a-z][a-z_-]+)', 1) AS tk FROM d)
    SELECT lang, count(*) FILTER (WHERE len(tk) > 0) AS total, count(*) FILTER (WHERE list_has_any(tk, [{", ".join("'" + x + "'" for x in ("the", "ou", "leaf", "er"))}])) AS flagged FROM w GROUP BY lang""",
)
def d30(t: Tables) -> DataFrame:
    return profile.mention_share(t.documents, ["lang"], ["text"], ("the", "ou", "leaf", "er")).drop("ratio")


@query(
    "D30_grammar_hits",
    "SELECT p AS pattern, count(*) AS n FROM (SELECT text, unnest(['The er', 'watchs', ' and ', 'ou er']) AS p FROM documents) WHERE contains(lower(text), lower(p)) GROUP BY p",
)
def d30_grammar(t: Tables) -> DataFrame:
    return profile.grammar_hits(t.documents, ["text"], ("The er", "watchs", " and ", "ou er"))


@query(
    "D30_predicates",
    "SELECT question, CASE WHEN contains(lower(question), 'left of') THEN 'left of' ELSE '' END AS predicate, count(*) AS n FROM asked GROUP BY ALL",
)
def d30_pred(t: Tables) -> DataFrame:
    return t.asked.groupBy("question").agg(F.count("*").alias("n")).select("question", text.predicate_of(F.col("question")).alias("predicate"), "n")


@query(
    "D31_question_risks",
    r"""WITH q AS (SELECT kind, question, lower(question) AS t FROM asked),
    r AS (SELECT kind, unnest(list_filter([CASE WHEN contains(t, 'yes') OR contains(' ' || t, ' no') THEN 'question_contains_yes_or_no' END, CASE WHEN len(string_split_regex(trim(question), '\s+')) > 40 THEN 'long_question' END,
      CASE WHEN NOT ends_with(trim(question), '?') THEN 'not_question_mark_terminated' END, CASE WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(not|n''t|without)($|[^\p{L}\p{N}_])') THEN 'negation_word' END], lambda x: x IS NOT NULL)) AS risk FROM q)
    SELECT kind, risk, count(*) AS n FROM r GROUP BY ALL""",
)
def d31(t: Tables) -> DataFrame:
    return profile.risk_counts(t.asked, ["kind"], "question")


@query("D31_duplicate_questions", "SELECT l_orderkey, question, count(*) AS n FROM asked GROUP BY ALL HAVING count(*) > 1")
def d31_dup(t: Tables) -> DataFrame:
    return profile.duplicate_questions(t.asked, ["l_orderkey", "question"])


@query(
    "F2_result_merge",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
)
def f2(t: Tables) -> DataFrame:
    return sets.merged_results(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("F4_image_overlap", "WITH d AS (SELECT DISTINCT image_id, category FROM objs) SELECT a.category AS a, b.category AS b, count(*) AS overlap FROM d a JOIN d b ON a.image_id = b.image_id GROUP BY ALL")
def f4(t: Tables) -> DataFrame:
    return sets.image_overlap(t.objs, "category")


@query(
    "F5_top_value_overlap",
    """WITH a AS (SELECT source FROM documents WHERE lang = 'en' GROUP BY source ORDER BY count(*) DESC, source LIMIT 10), b AS (SELECT source FROM documents WHERE lang = 'fr' GROUP BY source ORDER BY count(*) DESC, source LIMIT 10)
    SELECT (SELECT count(*) FROM a JOIN b USING (source)) AS shared, round((SELECT count(*) FROM a JOIN b USING (source)) / (SELECT count(*) FROM (SELECT source FROM a UNION SELECT source FROM b)), 6) AS jaccard""",
)
def f5_top(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    side = lambda x: counts.filter(F.col("lang") == x).select("source", "n")
    return rounded(sets.top_jaccard(side("en"), side("fr"), "source", "n", 10))


@query("F5_triple_overlap", "WITH d AS (SELECT source, count(DISTINCT lang) AS k FROM documents WHERE lang IN ('de', 'es', 'fr') GROUP BY source) SELECT CAST(count(*) FILTER (WHERE k = 3) AS BIGINT) AS all_share, count(*) AS any_has, round(count(*) FILTER (WHERE k = 3) / count(*), 6) AS jaccard FROM d")
def f5_triple(t: Tables) -> DataFrame:
    return rounded(sets.triple_overlap(t.documents, "lang", ["source"], ["de", "es", "fr"]))


@query(
    "F6_order_preserving_distinct",
    """WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM documents), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
    SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words FROM f GROUP BY doc_id""",
)
def f6(t: Tables) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return t.documents.select("doc_id", F.md5(F.array_join(words, " ")).alias("words"))


@query("F7_reconciliation", "SELECT 'left_only' AS side, (SELECT count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1)) AS n UNION ALL SELECT 'right_only', (SELECT count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0))")
def f7(t: Tables) -> DataFrame:
    half = lambda r: t.documents.filter(F.col("doc_id") % 2 == r).select("lang", "source")
    return sets.reconciliation(half(0), half(1))


__all__ = ["case", "fixed", "listed"]


@query(
    "D30_number_words",
    "SELECT w AS word, count(*) AS n FROM (SELECT ' ' || lower(regexp_replace(obj || ' ' || ['one', 'two', 'six', 'bone'][CAST(kind % 4 + 1 AS INTEGER)], '[^a-z]', ' ', 'g')) || ' ' AS t, unnest(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten']) AS w FROM asked) WHERE contains(t, ' ' || w || ' ') GROUP BY w",
)
def d30_numbers(t: Tables) -> DataFrame:
    more = F.get(F.array(*map(F.lit, ("one", "two", "six", "bone"))), (F.col("kind") % 4).cast("int"))
    return profile.number_words(t.asked.select("obj", more.alias("extra")), ["obj", "extra"])
