"""Further modes and parts of operators whose main form is registered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import fixed, text
from pairloom.functions import vectors as v
from pairloom.operators import banks, facts, metrics, profile, selection, sets
from pairloom.operators import vectors as vec
from pairloom.plans.bind import DIM, HEADS, LAYERS, Tables
from pairloom.plans.q_metrics import metrics_sql, rounded
from pairloom.plans.q_pairs import stages
from pairloom.plans.q_sources import documents_needed, documents_of
from pairloom.plans.q_text import REL_WORDS_SQL, listed, relation_words
from pairloom.plans.q_vectors import R6, H, directions, items
from pairloom.plans.registry import query
from pairloom.session import fresh_path, pinned
from pairloom.sources import readers


@query(
    "A3_segments",
    """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY annotation_id, w * h, x, y) - 1 AS INTEGER) AS pos, annotation_id AS segment_id, annotation_id // 1000000 % 1000000000 % 97 AS category_id,
       round(w * h, 6) AS area, x, round(h, 6) AS h FROM ann""",
)
def a3_segments(t: Tables) -> DataFrame:
    """Segment documents: the segments of an image in a list under the image."""
    path = fresh_path(t.spark, "a3s")
    box = F.array(*[F.col(f"box.{c}") for c in "xywh"])
    category = F.floor(F.col("annotation_id") / 1000000) % 1000000000 % 97
    segment = F.struct(F.col("annotation_id").alias("id"), category.alias("category_id"), (F.col("box.w") * F.col("box.h")).alias("area"), box.alias("bbox"))
    images = t.ann.groupBy("image_id").agg(F.sort_array(F.collect_list(segment)).alias("segments_info"))
    each = images.select(F.struct(F.col("image_id").cast("long").alias("image_id"), F.concat("image_id", F.lit(".png")).alias("file_name"), "segments_info").alias("entry"), "image_id")
    chunk = F.pmod(F.xxhash64("image_id"), F.lit(documents_needed(t.lineitem)))
    documents_of(each, chunk, F.to_json(F.struct(F.collect_list("entry").alias("annotations"))), path)
    got = readers.read_segments(t.spark, path)
    return got.select("image_id", "pos", "segment_id", "category_id", F.round("area", 6).alias("area"), F.col("box.x").alias("x"), F.round("box.h", 6).alias("h"))


@query(
    "A10_padded_names",
    "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '/img/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.jpg' END AS resolved FROM documents",
)
def a10_padded(t: Tables) -> DataFrame:
    """Files named by the 12-digit id, for rows that name no file, a missing one, or one whose id has no file either."""
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".jpg"))
    files = t.documents.filter("doc_id % 3 < 2").select(F.concat(F.lit("/img/"), name).alias("path"), name.alias("name"))
    raw = F.when(F.col("doc_id") % 3 == 0, "").otherwise("lost.jpg")
    got = readers.resolve_paths(t.documents.select("doc_id", raw.alias("raw")), files, "doc_id", "raw", ["/other", "/img"], padded_id="doc_id")
    return got.select("doc_id", "resolved")


@query("A16_unfold_nested_all", f"SELECT pair_no, subtype, branch, layer, head, d, {R6} FROM acts")
def a16_all(t: Tables) -> DataFrame:
    """Every payload in the nested layout [layer][head][dim]."""
    layers = F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda j: F.slice("embedding", (i * HEADS + j) * DIM + 1, DIM)))
    pair, even = F.floor(F.col("vec_id") / 2), F.col("vec_id") % 2 == 0
    kind = t.embeddings.filter(even).select(pair.alias("pair_no"), F.get(F.array(*map(F.lit, ("cat", "cnt", "col", "rel"))), F.col("label") % 4).alias("subtype"))
    rows = t.embeddings.select(pair.alias("pair_no"), F.when(even, "pos").otherwise("neg").alias("branch"), layers.alias("payload")).join(kind, "pair_no")
    return items(vec.unfold_nested(rows, "payload"), "pair_no", "subtype", "branch", *H)


@query(
    "F3_crossing_groups",
    """WITH a AS (SELECT image_id, object_id, CASE WHEN annotation_id % 10 < 8 THEN 'train' WHEN annotation_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, annotation_id % 11 = 0 AS twice FROM objs),
    h AS (SELECT image_id, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM a GROUP BY image_id),
    n AS (SELECT object_id, count(*) AS before, sum(CASE WHEN twice THEN 2 ELSE 1 END) AS after FROM a GROUP BY object_id)
    SELECT unnest(['overlap_test_train', 'overlap_test_val', 'overlap_train_val', 'missing_ids', 'duplicate_ids']) AS check,
      unnest([(SELECT count(*) FILTER (WHERE te AND tr) FROM h), (SELECT count(*) FILTER (WHERE te AND va) FROM h), (SELECT count(*) FILTER (WHERE tr AND va) FROM h), 0, (SELECT CAST(sum(greatest(after - 1, 0)) AS BIGINT) FROM n)]) AS n""",
)
def f3_crossing(t: Tables) -> DataFrame:
    """A split by annotation instead of by image, with some rows twice: what the check has to find, over all rows."""
    k = F.col("annotation_id") % 10
    rows = t.objs.select("image_id", F.col("object_id").alias("pair_id"), "annotation_id", F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"))
    assigned = rows.unionByName(rows.filter("annotation_id % 11 = 0"))
    return sets.leakage(rows.drop("split"), assigned)


@query("A10_listed_files", "SELECT lang, 1 AS readable FROM documents GROUP BY lang")
def a10_files(t: Tables) -> DataFrame:
    """Files that were written by language, listed without reading them."""
    path = fresh_path(t.spark, "a10")
    t.documents.select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    found = readers.list_files(t.spark, path, "*.parquet").withColumn("lang", F.regexp_extract("path", "lang=([^/]*)/", 1))
    return found.groupBy("lang").agg(F.min((F.col("size") > 0) & F.col("name").endswith(".parquet")).cast("int").alias("readable"))


@query(
    "B7_metadata_bucket",
    "WITH " + REL_WORDS_SQL + f""", m AS (SELECT raw, n, CASE n % 4 WHEN 0 THEN ' Contact ' WHEN 1 THEN '' WHEN 2 THEN 'sideways' END AS given, ['rel_left', 'rel_depth', 'REL_CONTACT', 'rel_other', ''][CAST(length(raw) % 5 + 1 AS INTEGER)] AS subtype,
      replace(trim(regexp_replace(replace(lower(raw), '-', ' '), '\\s+', ' ', 'g')), ' ', '_') AS r FROM rw)
    SELECT raw, given, subtype, CASE WHEN lower(trim(given)) IN {listed(fixed.BUCKET_ORDER)} THEN lower(trim(given)) WHEN lower(subtype) = 'rel_left' THEN 'horizontal' WHEN lower(subtype) = 'rel_depth' THEN 'depth'
      WHEN lower(subtype) = 'rel_contact' THEN 'contact' WHEN r IN ('left_of', 'right_of') THEN 'horizontal' WHEN r IN ('above', 'below') THEN 'vertical' WHEN r IN ('in_front_of', 'behind') THEN 'depth'
      WHEN r IN ('on', 'under', 'near', 'next_to', 'touching', 'direct_contact') THEN 'contact' WHEN r IN ('holding', 'wearing', 'riding', 'eating', 'watching', 'carrying', 'using') THEN 'interaction' WHEN r <> '' THEN 'semantic' ELSE '' END AS bucket FROM m""",
)
def b7_metadata(t: Tables) -> DataFrame:
    """Bucket of a relation from what the row says, then its subtype, then the relation."""
    n = F.col("n") % 4
    given = F.when(n == 0, " Contact ").when(n == 1, "").when(n == 2, "sideways")
    subtype = F.get(F.array(*map(F.lit, ("rel_left", "rel_depth", "REL_CONTACT", "rel_other", ""))), F.length("raw") % 5)
    rows = relation_words(t).select("raw", given.alias("given"), subtype.alias("subtype"))
    return rows.withColumn("bucket", text.metadata_relation_bucket(F.col("given"), F.col("subtype"), F.col("raw")))


_Q = ("Is there a {label}?", "How many {obj_pl} are there?", "What color is the {obj}?", "Where is the {obj1} to the {obj2}?", "", "Is {zzz} here?")
_A = ("It is {label}.", "There are {count} {obj_pl}.", "The {obj} is {color}.", "The {obj1} is {rel} the {obj2}.", "Nothing.")


@query(
    "B13_bad_bank",
    f"""WITH b AS (SELECT 'tpl_' || p_partkey // 3 AS template_id, ['cat', 'cnt', 'col', 'rel', 'zzz'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS subtype, ['template', 'gqa', 'web'][CAST(p_size % 3 + 1 AS INTEGER)] AS text_source,
      {list(_Q)}[CAST(p_size % 6 + 1 AS INTEGER)] AS q, {list(_A)}[CAST(p_partkey // 5 % 5 + 1 AS INTEGER)] AS a0 FROM part),
    u AS (SELECT *, CASE WHEN subtype = 'cnt' AND NOT contains(a0, '{{obj_count}}') THEN replace(a0, '{{obj_pl}}', '{{obj_count}}') ELSE a0 END AS a FROM b),
    s AS (SELECT *, CASE subtype WHEN 'cat' THEN ['label'] WHEN 'cnt' THEN ['count', 'obj_pl', 'obj_count'] WHEN 'col' THEN ['obj', 'color'] WHEN 'rel' THEN ['obj1', 'obj2', 'rel'] END AS allowed,
      CASE subtype WHEN 'cat' THEN 'label' WHEN 'cnt' THEN 'count' WHEN 'col' THEN 'color' WHEN 'rel' THEN 'rel' END AS target,
      list_distinct(regexp_extract_all(q, '\\{{([a-z0-9_]+)\\}}', 1) || regexp_extract_all(a, '\\{{([a-z0-9_]+)\\}}', 1)) AS used, regexp_extract_all(a, '\\{{([a-z0-9_]+)\\}}', 1) AS rused FROM u)
    SELECT template_id, 'unknown_subtype' AS rule, subtype AS detail FROM s WHERE allowed IS NULL
    UNION ALL SELECT template_id, 'missing_keys', 'q_template' FROM s WHERE q = ''
    UNION ALL SELECT template_id, 'text_source', text_source FROM s WHERE text_source = 'web'
    UNION ALL SELECT template_id, 'illegal_placeholders', array_to_string(list_sort(list_filter(used, lambda x: NOT list_contains(allowed, x))), ', ') FROM s WHERE len(list_filter(used, lambda x: NOT list_contains(allowed, x))) > 0
    UNION ALL SELECT template_id, 'missing_placeholders', array_to_string(list_sort(list_filter(allowed, lambda x: NOT list_contains(used, x))), ', ') FROM s WHERE len(list_filter(allowed, lambda x: NOT list_contains(used, x))) > 0
    UNION ALL SELECT template_id, 'target_slot', target FROM s WHERE NOT list_contains(rused, target)
    UNION ALL SELECT template_id, 'duplicate_id', CAST(count(*) AS VARCHAR) FROM b GROUP BY template_id HAVING count(*) > 1""",
)
def b13_bad(t: Tables) -> DataFrame:
    """A bank with one template a part, most of them wrong in some way."""

    def one(values, place):
        return F.get(F.array(*map(F.lit, values)), place.cast("int"))

    key, size = F.col("p_partkey"), F.col("p_size")
    bank = t.part.select(
        F.concat(F.lit("tpl_"), F.floor(key / 3)).alias("template_id"), one(("cat", "cnt", "col", "rel", "zzz"), key % 5).alias("subtype"), one(("template", "gqa", "web"), size % 3).alias("text_source"),
        one(_Q, size % 6).alias("q_template"), one(_A, F.floor(key / 5) % 5).alias("r_template"),
    )
    return banks.template_violations(bank)


SIZE = 16
COLOR_SQL = """CASE WHEN (r + g + b) / 3 < 45 THEN 'black' WHEN (r + g + b) / 3 > 225 AND greatest(r, g, b) - least(r, g, b) < 25 THEN 'white'
      WHEN r > 150 AND g > 110 AND b < 120 THEN CASE WHEN r > 185 AND g > 170 THEN 'yellow' WHEN r > 165 AND g < 150 THEN 'orange' ELSE 'brown' END
      WHEN r > 120 AND g > 70 AND b < 90 AND (r + g + b) / 3 < 170 THEN 'brown' WHEN r > g + 35 AND r > b + 35 THEN 'red' WHEN g > r + 25 AND g > b + 25 THEN 'green' WHEN b > r + 25 AND b > g + 25 THEN 'blue'
      WHEN r > 170 AND g > 150 AND b < 110 THEN 'yellow' WHEN r > 175 AND g > 95 AND b < 90 THEN 'orange' WHEN (r + g + b) / 3 < 95 THEN 'brown' END"""
PIXELS_SQL = """px AS (SELECT vec_id AS image_id, pos, CAST(floor(abs(x) * 1000) AS BIGINT) % 256 AS r, CAST(floor(abs(x) * 3000) AS BIGINT) % 256 AS g, CAST(floor(abs(x) * 7000) AS BIGINT) % 256 AS b
      FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
    mk AS (SELECT image_id, pos, CASE WHEN pos < image_id % 40 + 1 THEN 1 WHEN pos < image_id % 40 + 1 + image_id % 23 THEN 2 WHEN image_id % 2 = 0 THEN 1 ELSE 3 END AS segment_id FROM px
      WHERE NOT (image_id % 7 = 0 AND pos >= image_id % 40 + 1 + image_id % 23))"""


def pixels(t: Tables) -> DataFrame:
    """Every vector as a row of 64 pixels."""
    x = F.abs(F.col("x").cast("double"))
    each = t.embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "x"))
    return each.select("image_id", F.col("pos").cast("long").alias("pos"), *[(F.floor(x * k) % 256).alias(c) for c, k in (("r", 1000), ("g", 3000), ("b", 7000))])


@query(
    "C12_run_colors",
    f"""WITH {PIXELS_SQL}, whole AS (SELECT image_id FROM mk GROUP BY image_id HAVING count(*) = 64),
    m AS (SELECT image_id, segment_id, count(*) AS pixels, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM mk JOIN px USING (image_id, pos) WHERE image_id IN (SELECT image_id FROM whole) GROUP BY ALL)
    SELECT image_id, segment_id, pixels, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, {COLOR_SQL} AS color FROM m""",
)
def c12_runs(t: Tables) -> DataFrame:
    """Colours from run-length masks: three runs an image, one image in seven without its last one."""
    image = t.embeddings.select(F.col("vec_id").alias("image_id"), (F.col("vec_id") % 40 + 1).alias("a"), (F.col("vec_id") % 23).alias("n"))
    end = F.col("a") + F.col("n")
    one, three = F.when(F.col("image_id") % 2 == 0, 1).otherwise(3), F.col("image_id") % 7 != 0
    runs = image.select("image_id", F.inline(F.array(
        F.struct(F.lit(1).alias("segment_id"), F.lit(0).cast("long").alias("first"), F.col("a").alias("n")), F.struct(F.lit(2).alias("segment_id"), F.col("a").alias("first"), F.col("n").alias("n")),
        F.struct(one.alias("segment_id"), end.alias("first"), F.when(three, 64 - end).otherwise(0).alias("n")),
    )))
    return rounded(facts.run_colors(facts.raster_blocks(pixels(t), SIZE), runs, SIZE), "r", "g", "b")


@query(
    "C12_mask_runs",
    f"""WITH {PIXELS_SQL}, i AS (SELECT image_id, segment_id, pos, pos - row_number() OVER (PARTITION BY image_id, segment_id ORDER BY pos) AS k FROM mk)
    SELECT image_id, segment_id, min(pos) AS first, count(*) AS n FROM i GROUP BY image_id, segment_id, k""",
)
def c12_mask(t: Tables) -> DataFrame:
    """A mask of pixels as its runs."""
    a, n, k = F.col("image_id") % 40 + 1, F.col("image_id") % 23, F.col("pos")
    segment = F.when(k < a, 1).when(k < a + n, 2).when(F.col("image_id") % 2 == 0, 1).otherwise(3)
    mask = pixels(t).filter(~((F.col("image_id") % 7 == 0) & (k >= a + n))).select("image_id", "pos", segment.alias("segment_id"))
    return facts.mask_runs(mask)


@query(
    "D7_image_counts",
    """SELECT stage, rows, count(*) AS images FROM (SELECT 'unbalanced' AS stage, image_id, count(*) AS rows FROM pairs GROUP BY image_id UNION ALL SELECT 'balanced', image_id, count(*) FROM bal GROUP BY image_id) GROUP BY ALL""",
)
def d7_images(t: Tables) -> DataFrame:
    s = stages(t)
    return profile.image_counts({"unbalanced": s["unbalanced"], "balanced": s["balanced"]})


@query("D7_first_images", "SELECT image_id, subtype, count(*) AS n FROM pairs WHERE image_id IN (SELECT DISTINCT image_id FROM pairs ORDER BY image_id LIMIT 5) GROUP BY ALL")
def d7_first(t: Tables) -> DataFrame:
    return profile.first_images(stages(t)["unbalanced"].select("image_id", "subtype"), "subtype", 5)


@query("D22_word_histogram", "SELECT kind, len(string_split_regex(trim(question), '\\s+')) AS words, count(*) AS n FROM asked GROUP BY ALL")
def d22_words(t: Tables) -> DataFrame:
    return profile.word_histogram(t.asked, ["kind"], "question")


@query(
    "D25_f1_matrix",
    f"""WITH m AS ({metrics_sql("method, subtype", "preds", "labeled")}),
    v AS (SELECT subtype, CASE method WHEN 'click' THEN 'g_attr_clean' WHEN 'error' THEN 'd_' || subtype || '_top' WHEN 'purchase' THEN 'x_cat_y' ELSE 'g_all' END AS vector, f1, yes_rate, n FROM m WHERE method <> 'view'),
    a AS (SELECT vector, subtype, sum(f1 * n) / sum(n) AS f1, sum(yes_rate * n) / sum(n) AS yes_rate FROM v GROUP BY ALL)
    SELECT vector, a.subtype, round(a.f1, 6) AS f1, round(a.f1 - b.f1, 6) AS f1_delta, CASE WHEN a.yes_rate > 0.65 OR a.yes_rate < 0.35 THEN 1 ELSE 0 END AS suspicious FROM a JOIN m b ON b.method = 'view' AND b.subtype = a.subtype""",
)
def d25_f1(t: Tables) -> DataFrame:
    """Vector by benchmark: F1, its change against the baseline, and yes rates out of range."""
    table = pinned(metrics.yes_no_metrics(t.preds, ["method", "subtype"]).select("method", "subtype", "n", F.round("f1", 6).alias("f1"), F.round("yes_rate", 6).alias("yes_rate")))
    m = F.col("method")
    vector = F.when(m == "click", "g_attr_clean").when(m == "error", F.concat(F.lit("d_"), "subtype", F.lit("_top"))).when(m == "purchase", "x_cat_y").otherwise("g_all")
    matrix = selection.f1_matrix(table.filter("method <> 'view'").withColumn("vector", vector), table.filter("method = 'view'"), "vector", "subtype")
    return matrix.withColumns({"f1": F.round("f1", 6), "f1_delta": F.round("f1_delta", 6), "suspicious": F.col("suspicious").cast("int")})


VERDICT_SQL = """m AS (SELECT subtype, answer, layer, head, d, avg(v) AS v FROM delta GROUP BY ALL),
    c AS (SELECT y.subtype, sum(y.v * n.v) / sqrt(sum(y.v * y.v) * sum(n.v * n.v)) AS cosine FROM m y JOIN m n USING (subtype, layer, head, d) WHERE y.answer = 'yes' AND n.answer = 'no' GROUP BY y.subtype),
    p AS (SELECT s.subtype, a.answer, s.pair_no, sum(CASE WHEN s.branch = 'pos' THEN s.score ELSE -s.score END) AS gap FROM scores s JOIN (SELECT DISTINCT pair_no, answer FROM acts) a USING (pair_no) GROUP BY ALL),
    g AS (SELECT subtype, avg(gap) FILTER (WHERE answer = 'yes') AS y, avg(gap) FILTER (WHERE answer = 'no') AS n FROM p GROUP BY subtype)"""


@query(
    "D33_direction_verdict",
    f"""WITH {VERDICT_SQL} SELECT subtype, CASE WHEN cosine > 0.3 THEN 'shared direction' WHEN cosine < -0.3 THEN 'opposed polarity' ELSE 'weakly aligned' END AS alignment,
      CASE WHEN y > 0 AND n < 0 THEN 'desired' WHEN y > 0 AND n > 0 THEN 'yes direction' WHEN abs(y) < 0.05 AND abs(n) < 0.05 THEN 'barely moves' ELSE 'mixed' END AS movement FROM c JOIN g USING (subtype)""",
)
def d33_verdict(t: Tables) -> DataFrame:
    """Do the directions of yes and no pairs agree, and how do the margins of each move?"""
    means = vec.mean_vectors(t.delta, ["subtype", "answer", *H]).select("subtype", "answer", *H, "vec")
    yes, no = (means.filter(F.col("answer") == a).select("subtype", *H, F.col("vec").alias(a)) for a in ("yes", "no"))
    y, n = F.col("yes"), F.col("no")
    sums = yes.join(no, ["subtype", *H]).groupBy("subtype").agg(F.sum(v.dot(y, n)).alias("yn"), F.sum(v.sq_norm(y)).alias("yy"), F.sum(v.sq_norm(n)).alias("nn"))
    scored = vec.row_scores(t.acts, pinned(vec.prototypes(t.acts)), ["pair_no", "subtype", "answer"])
    gap = F.col("score_pos") - F.col("score_neg")
    gaps = vec.paired_scores(scored, ["pair_no", "subtype", "answer"]).groupBy("subtype").agg(F.avg(F.when(F.col("answer") == "yes", gap)).alias("y"), F.avg(F.when(F.col("answer") == "no", gap)).alias("n"))
    verdict = selection.direction_verdict(v.ratio_or_zero(F.col("yn"), F.sqrt("yy") * F.sqrt("nn")), F.col("y"), F.col("n"))
    return sums.join(gaps, "subtype").select("subtype", verdict.alias("v")).select("subtype", "v.alignment", "v.movement")


@query(
    "G11_capped_directions",
    """WITH k AS (SELECT *, CASE subtype WHEN 'cnt' THEN 'attr' WHEN 'col' THEN 'attr' ELSE subtype END AS name FROM delta),
    c AS (SELECT name, pair_no, row_number() OVER (PARTITION BY name ORDER BY md5('42|' || pair_no), pair_no) AS r FROM (SELECT DISTINCT name, pair_no FROM k)),
    m AS (SELECT k.name, layer, head, d, avg(v) AS v FROM k JOIN c ON c.name = k.name AND c.pair_no = k.pair_no AND c.r <= 20 GROUP BY ALL),
    u AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY name, layer, head)) AS n FROM m)
    SELECT name, layer, head, d, round(CASE WHEN n > 1e-12 THEN v / n ELSE 0 END, 6) + 0.0 AS v FROM u UNION ALL SELECT 'none', layer, head, d, 0.0 FROM u WHERE name = 'cat'""",
)
def g11_capped(t: Tables) -> DataFrame:
    """At most 20 pairs a type, heads of norm 1, and a zero vector for a type without pairs."""
    kind = vec.name_map(F.col("subtype"), {"cat": "cat", "cnt": "attr", "col": "attr", "rel": "rel"})
    bank = pinned(vec.directions(t.delta, kind, cap=20, unit_heads=True))
    return items(vec.with_empty(bank, ["cat", "attr", "rel", "none"], DIM), "name", *H)


@query(
    "G12_bucket_directions",
    f"""WITH b AS (SELECT *, ['horizontal', 'vertical', 'depth', 'contact', 'interaction', 'semantic'][condition % 6 + 1] AS bucket FROM delta),
    g AS (SELECT unnest(list_filter(['rel_' || bucket, CASE WHEN bucket IN ('horizontal', 'vertical') THEN 'rel_position_2d' END, CASE WHEN bucket IN ('horizontal', 'vertical', 'depth') THEN 'rel_position' END,
      CASE WHEN bucket IN ('contact', 'interaction') THEN 'rel_contact_interaction' END], lambda x: x IS NOT NULL)) AS name, layer, head, d, v FROM b)
    SELECT name, layer, head, d, {R6.replace("v,", "avg(v),")} FROM g GROUP BY ALL""",
)
def g12_buckets(t: Tables) -> DataFrame:
    """Directions of relation buckets and of their unions; the bucket is inferred from the relation."""
    relation = F.get(F.array(*map(F.lit, ("left of", "above", "in front of", "touching", "holding", "made of"))), F.col("condition") % 6)
    bucket = text.metadata_relation_bucket(F.lit(None).cast("string"), F.lit(""), relation)
    return items(vec.grouped_directions(t.delta, vec.bucket_groups(bucket)), "name", *H)


@query(
    "G22_overlaps",
    """WITH k AS (SELECT name, layer, head, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, layer, head) AS r, 'norm' AS strategy FROM headscore
      UNION ALL SELECT name, layer, head, row_number() OVER (PARTITION BY name ORDER BY md5('5|' || name || '|' || layer || '|' || head), layer, head), 'random' FROM headscore),
    m AS (SELECT strategy, kk AS k, name, layer, head FROM k, (VALUES (2), (4)) x(kk) WHERE r <= kk),
    n AS (SELECT strategy, k, name, count(*) AS size FROM m GROUP BY ALL),
    s AS (SELECT x.strategy, x.k, x.name AS a, y.name AS b, count(*) AS shared FROM m x JOIN m y USING (strategy, k, layer, head) WHERE x.name < y.name GROUP BY ALL)
    SELECT p.strategy, CAST(p.k AS INTEGER) AS k, p.name AS a, q.name AS b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (p.size + q.size - coalesce(shared, 0)), 6) AS jaccard
    FROM n p JOIN n q ON p.strategy = q.strategy AND p.k = q.k AND p.name < q.name LEFT JOIN s ON s.strategy = p.strategy AND s.k = p.k AND s.a = p.name AND s.b = q.name""",
)
def g22_overlaps(t: Tables) -> DataFrame:
    """Shared heads of every two vectors among their k best, by norm and at random."""
    scores = pinned(vec.head_norms(pinned(directions(t).drop("n"))))
    ks = (2, 4)
    by_norm = vec.ranked_heads(scores, ["name"], max(ks)).select(F.lit("norm").alias("strategy"), "name", *H, "rank")
    at_random = vec.random_mask(scores, ["name"], max(ks), 5).select(F.lit("random").alias("strategy"), "name", *H, "rank")
    return rounded(sets.prefix_overlaps(by_norm.unionByName(at_random), ["strategy"], "name", H, ks))


NORMS = ("mean_source_norm", "left_norm", "right_norm", "unit_norm", "raw_mean_norm")


@query(
    "G23_norms",
    """WITH p AS (SELECT layer, head, d, max(v) FILTER (WHERE name = 'cat') AS a, max(v) FILTER (WHERE name = 'rel') AS b FROM dirs GROUP BY ALL),
    n AS (SELECT sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb, sqrt(sum((a + b) * (a + b))) / 2 AS nm FROM p),
    m AS (SELECT layer, head, d, 'raw_mean' AS mode, (a + b) / 2 AS m FROM p UNION ALL SELECT layer, head, d, 'unit_mean', (a / na + b / nb) / 2 FROM p, n),
    s AS (SELECT mode, sqrt(sum(m * m)) AS s FROM m GROUP BY mode),
    w AS (SELECT unnest(['mean_source_norm', 'left_norm', 'right_norm', 'unit_norm', 'raw_mean_norm']) AS target, unnest([(na + nb) / 2, na, nb, 1.0, nm]) AS want FROM n)
    SELECT mode, target, layer, head, d, round(m / s * want, 6) + 0.0 AS v FROM m JOIN s USING (mode), w""",
)
def g23_norms(t: Tables) -> DataFrame:
    bank = pinned(directions(t))
    cat, rel = bank.filter("name = 'cat'"), bank.filter("name = 'rel'")
    out = None
    for mode in ("raw_mean", "unit_mean"):
        for target in NORMS:
            one = vec.mixed(cat, rel, mode, target).select(F.lit(mode).alias("mode"), F.lit(target).alias("target"), *H, "vec")
            out = one if out is None else out.unionByName(one)
    return items(out, "mode", "target", *H)


@query(
    "G23_composed",
    """WITH p AS (SELECT layer, head, d, max(v) FILTER (WHERE name = 'cat') AS a, max(v) FILTER (WHERE name = 'rel') AS b FROM dirs GROUP BY ALL), n AS (SELECT sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM p),
    m AS (SELECT layer, head, d, 0.75 * a / na + 0.25 * b / nb AS m, na, nb FROM p, n), s AS (SELECT sqrt(sum(m * m)) AS s FROM m)
    SELECT layer, head, d, round(m / s * (na + nb) / 2, 6) + 0.0 AS v FROM m, s""",
)
def g23_composed(t: Tables) -> DataFrame:
    bank = pinned(directions(t))
    return items(vec.composed(bank.filter("name = 'cat'"), bank.filter("name = 'rel'"), 0.75, 0.25), *H)
