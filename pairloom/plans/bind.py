"""Domain tables as projections of the given tables, in Spark and as SQL views.

``Tables`` builds the DataFrames, ``VIEWS`` holds the same definitions in SQL; a query's SQL may name any
view and :func:`with_views` puts the needed definitions in front.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import text, vectors
from pairloom.operators import banks, facts
from pairloom.operators.ordering import dealt, global_rank
from pairloom.session import pinned

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
FACT_TABLES = ("lineitem", "documents")
# Vector layout of an embedding: 2 layers x 4 heads x 8 dimensions.
LAYERS, HEADS, DIM = 2, 4, 8
THINGS = {"ring": "cup", "bolt": "chair", "plate": "plate", "rod": "man", "anvil": "dog", "widget": "car", "gear": "bag", "gizmo": "person"}
TRAITS = {"blue": "blue", "red": "red", "cold": "wet", "new": "open", "hot": "round", "small": "long", "large": "metallic", "old": "standing"}
NAME_COLORS = {"blue": "blue", "red": "red", "hot": "orange", "cold": "white", "old": "brown"}

VIEWS = {
    "images": "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, 200.0::DOUBLE AS width, 200.0::DOUBLE AS height, o_orderpriority AS priority, o_custkey FROM orders",
    "ann": """
        SELECT CAST(l_orderkey AS VARCHAR) AS image_id,
               CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 1000000 + l_suppkey AS annotation_id,
               CAST(l_partkey % 150 AS DOUBLE) AS x, CAST((l_suppkey * 7) % 150 AS DOUBLE) AS y,
               l_quantity AS w, 1 + 500 * l_discount AS h, p_type AS category, p_name AS name, p_brand AS brand,
               l_returnflag = 'R' AS crowd,
               CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN 'blue' WHEN 'red' THEN 'red' WHEN 'hot' THEN 'orange'
                    WHEN 'cold' THEN 'white' WHEN 'old' THEN 'brown' END AS color,
               l_linenumber, l_orderkey
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "objs": """
        SELECT ann.*, (w * h) / (width * height) AS area_ratio, ann.image_id || '_' || annotation_id AS object_id
        FROM ann JOIN images USING (image_id) WHERE (w * h) / (width * height) >= 0.01""",
    "cnt": "SELECT image_id, category, count(*) AS n FROM objs GROUP BY ALL",
    "vocab": """
        SELECT p_type AS category, min(p_brand) AS semantic_group, substr(min(p_brand), 1, 7) AS supercategory,
               row_number() OVER (ORDER BY p_type) - 1 AS pos FROM part GROUP BY p_type""",
    "bank": """
        SELECT category, candidate, row_number() OVER (PARTITION BY category ORDER BY t, p) - 1 AS pos FROM (
          SELECT a.category, b.category AS candidate,
                 CASE WHEN a.semantic_group = b.semantic_group THEN 1 WHEN a.supercategory = b.supercategory THEN 2 ELSE 1000000 END AS t, b.pos AS p
          FROM vocab a JOIN vocab b ON a.category <> b.category) QUALIFY row_number() OVER (PARTITION BY category ORDER BY t, p) <= 10""",
    "tpl": """SELECT * FROM (VALUES
        {templates}) v(subtype, pos, template_id, q_template, r_template)""",
    "rel0": """
        SELECT a.image_id, a.annotation_id AS subject_ann, b.annotation_id AS object_ann, a.object_id AS subject_id, b.object_id AS object_id,
               a.category AS subject_category, b.category AS object_category,
               ((b.x + b.w / 2) - (a.x + a.w / 2)) / greatest((a.w + b.w) / 2, 1e-6) AS dx,
               ((b.y + b.h / 2) - (a.y + a.h / 2)) / greatest((a.h + b.h) / 2, 1e-6) AS dy,
               greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS inter,
               a.w * a.h + b.w * b.h AS areas
        FROM objs a JOIN objs b ON a.image_id = b.image_id AND a.annotation_id < b.annotation_id""",
    "rel1": """
        SELECT *, CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0.0 END AS iou FROM rel0""",
    "rels": """
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY subject_ann, object_ann) AS rel_index FROM (
          SELECT image_id, subject_ann, object_ann, subject_id, object_id, subject_category, object_category, dx, dy, iou,
                 CASE WHEN iou > 0.1 THEN NULL
                      WHEN abs(dx) >= 0.75 AND abs(dy) <= 1.0 THEN CASE WHEN dx > 0 THEN 'left of' ELSE 'right of' END
                      WHEN abs(dy) >= 0.75 AND abs(dx) <= 1.0 THEN CASE WHEN dy > 0 THEN 'above' ELSE 'below' END END AS predicate
          FROM rel1) WHERE predicate IS NOT NULL""",
    "facts": """
        SELECT 'coco_' || image_id || '_cat_' || annotation_id AS fact_id, image_id, 'cat' AS subtype, category AS subject_category,
               CAST(NULL AS VARCHAR) AS object_category, category AS positive_value, CAST(NULL AS INTEGER) AS positive_int, area_ratio FROM objs
        UNION ALL SELECT 'coco_' || image_id || '_col_' || annotation_id, image_id, 'col', category, NULL, color, NULL, NULL FROM objs
        UNION ALL SELECT 'coco_' || image_id || '_cnt_' || category, image_id, 'cnt', category, NULL, CAST(n AS VARCHAR), n, NULL FROM cnt
        UNION ALL SELECT 'coco_' || image_id || '_rel_' || rel_index, image_id, 'rel', subject_category, object_category, predicate, NULL, NULL FROM rels""",
    "catneg": """
        SELECT o.image_id, o.category, coalesce(min_by(b.candidate, b.pos) FILTER (WHERE v.n IS NULL), min_by(b.candidate, b.pos)) AS negative
        FROM (SELECT DISTINCT image_id, category FROM objs) o JOIN bank b ON o.category = b.category
        LEFT JOIN cnt v ON v.image_id = o.image_id AND v.category = b.candidate GROUP BY ALL""",
    "judged": """
        SELECT *, CASE WHEN subtype = 'cat' AND (coalesce(sn, 0) <> 1 OR coalesce(area_ratio, 0) < 0.01) THEN 'ambiguous_cat_anchor'
                       WHEN subtype = 'cnt' AND negative IS NULL THEN 'count_out_of_range'
                       WHEN subtype = 'col' AND coalesce(sn, 0) <> 1 THEN 'ambiguous_col_anchor'
                       WHEN subtype = 'col' AND coalesce(positive_value, '') = '' THEN 'missing_color'
                       WHEN subtype = 'rel' AND subject_category = object_category THEN 'same_category_relation'
                       WHEN subtype = 'rel' AND (coalesce(sn, 0) <> 1 OR coalesce(obn, 0) <> 1) THEN 'ambiguous_rel_anchor'
                       WHEN negative IS NULL THEN 'no_valid_negative' END AS drop_reason
        FROM (SELECT f.*, s.n AS sn, o.n AS obn,
                CASE subtype WHEN 'cat' THEN c.negative
                  WHEN 'cnt' THEN CASE WHEN positive_int BETWEEN 1 AND 4 THEN CAST(positive_int + 1 AS VARCHAR) WHEN positive_int = 5 THEN '4' END
                  WHEN 'col' THEN CASE WHEN positive_value = 'black' THEN 'white' WHEN positive_value IS NOT NULL THEN 'black' END
                  WHEN 'rel' THEN CASE positive_value WHEN 'left of' THEN 'right of' WHEN 'right of' THEN 'left of' WHEN 'above' THEN 'below' WHEN 'below' THEN 'above' END
                END AS negative
              FROM facts f LEFT JOIN cnt s ON s.image_id = f.image_id AND s.category = f.subject_category
              LEFT JOIN cnt o ON o.image_id = f.image_id AND o.category = f.object_category
              LEFT JOIN catneg c ON c.image_id = f.image_id AND c.category = f.subject_category)""",
    "kept": """
        SELECT * FROM judged WHERE drop_reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY image_id, subtype ORDER BY fact_id) <= CASE subtype WHEN 'rel' THEN 6 ELSE 4 END""",
    "pairs": """
        WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY image_id, fact_id) AS fact_rank FROM kept),
        joined AS (SELECT r.*, t.template_id, t.q_template, t.r_template,
            CASE WHEN subject_category LIKE '%s' OR subject_category LIKE '%x' OR subject_category LIKE '%z' OR subject_category LIKE '%ch' OR subject_category LIKE '%sh' THEN subject_category || 'es'
                 WHEN regexp_matches(subject_category, '[^aeiouAEIOU]y$') THEN regexp_replace(subject_category, 'y$', 'ies') ELSE subject_category || 's' END AS plural
          FROM ranked r JOIN tpl t ON t.subtype = r.subtype AND t.pos = (fact_rank - 1) % CASE r.subtype WHEN 'cat' THEN 4 ELSE 3 END)
        SELECT fact_id || '_' || template_id || '_pair' AS pair_id, fact_id, image_id, subtype, fact_rank, template_id,
               replace(replace(replace(replace(q_template, '{obj1}', coalesce(subject_category, '')), '{obj2}', coalesce(object_category, '')), '{obj}', subject_category), '{obj_pl}', plural) AS question,
               replace(replace(replace(replace(replace(replace(replace(r_template, '{label}', positive_value), '{count}', positive_value), '{color}', positive_value), '{rel}', positive_value),
                 '{obj1}', subject_category), '{obj2}', coalesce(object_category, '')), '{obj}', subject_category)
                 .replace('{obj_count}', CASE WHEN positive_value = '1' THEN subject_category ELSE plural END) AS response_pos,
               replace(replace(replace(replace(replace(replace(replace(r_template, '{label}', negative), '{count}', negative), '{color}', negative), '{rel}', negative),
                 '{obj1}', subject_category), '{obj2}', coalesce(object_category, '')), '{obj}', subject_category)
                 .replace('{obj_count}', CASE WHEN negative = '1' THEN subject_category ELSE plural END) AS response_neg,
               positive_value AS pos_label, negative AS neg_label,
               subject_category AS anchor_label,
               CASE WHEN subtype = 'rel' THEN subject_category || '|' || positive_value || '|' || object_category END AS rel_pattern
        FROM joined""",
    "bal": """
        SELECT * FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY subtype, CASE WHEN subtype = 'rel' THEN rel_pattern ELSE anchor_label END ORDER BY fact_rank)
                         <= CASE subtype WHEN 'rel' THEN 15 ELSE 80 END)
        QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY fact_rank) <= CASE subtype WHEN 'col' THEN 200 ELSE 500 END""",
    "preds": """
        SELECT CAST(user_id AS VARCHAR) || '-' || CAST(r AS VARCHAR) AS sample_id, event_type AS method, user_id % 4 AS subtype_no,
               ['cat_random', 'attr_color', 'attr_count', 'rel_spatial'][CAST(user_id % 4 + 1 AS INTEGER)] AS subtype,
               CASE WHEN (user_id + r) % 2 = 1 THEN 'yes' ELSE 'no' END AS label,
               CASE WHEN value >= 35 THEN 'yes' WHEN value < 3 THEN 'invalid' ELSE 'no' END AS pred,
               value AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS alpha, event_id, user_id
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events)""",
    "base": "SELECT * FROM preds WHERE method = 'view'",
    "vars": """
        SELECT p.*, b.pred AS base_pred, b.score AS base_score FROM preds p LEFT JOIN base b ON b.sample_id = p.sample_id AND b.subtype = p.subtype
        WHERE p.method <> 'view'""",
    "sg": """
        SELECT image_id, CAST(annotation_id AS VARCHAR) AS object_id, annotation_id, category, x, y, w, h, priority,
               CASE split_part(name, ' ', 2) WHEN 'ring' THEN 'cup' WHEN 'bolt' THEN 'chair' WHEN 'plate' THEN 'plate' WHEN 'rod' THEN 'man' WHEN 'anvil' THEN 'dog'
                 WHEN 'widget' THEN 'car' WHEN 'gear' THEN 'bag' ELSE 'person' END AS name,
               CASE split_part(name, ' ', 1) WHEN 'blue' THEN 'blue' WHEN 'red' THEN 'red' WHEN 'cold' THEN 'wet' WHEN 'new' THEN 'open' WHEN 'hot' THEN 'round'
                 WHEN 'small' THEN 'long' WHEN 'large' THEN 'metallic' ELSE 'standing' END AS trait, lower(category) AS kind
        FROM ann JOIN images USING (image_id)""",
    "edges": """
        SELECT image_id, object_id AS subject_id, ['on top of', 'to the left of', 'holding', 'sitting on', 'of'][CAST(substr(priority, 1, 1) AS INTEGER)] AS relation,
               CASE WHEN annotation_id = min(annotation_id) OVER (PARTITION BY image_id) THEN 'nowhere'
                    ELSE CAST(min(annotation_id) OVER (PARTITION BY image_id) AS VARCHAR) END AS target_id FROM sg""",
    "acts": """
        WITH flat AS (SELECT e.vec_id // 2 AS pair_no, CASE WHEN e.vec_id % 2 = 0 THEN 'pos' ELSE 'neg' END AS branch,
                 unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings e),
        lab AS (SELECT vec_id // 2 AS pair_no, label FROM embeddings WHERE vec_id % 2 = 0)
        SELECT flat.pair_no, ['cat', 'cnt', 'col', 'rel'][label % 4 + 1] AS subtype, CASE WHEN label < 5 THEN 'yes' ELSE 'no' END AS answer,
               label AS condition, branch, CAST(p // 32 AS INTEGER) AS layer, CAST((p // 8) % 4 AS INTEGER) AS head, CAST(p % 8 AS INTEGER) AS d, CAST(v AS DOUBLE) AS v
        FROM flat JOIN lab USING (pair_no)""",
    "delta": """
        SELECT pair_no, subtype, answer, condition, layer, head, d, max(v) FILTER (WHERE branch = 'pos') - max(v) FILTER (WHERE branch = 'neg') AS v
        FROM acts GROUP BY ALL""",
    "unit": """
        SELECT pair_no, subtype, branch, layer, head, d, CASE WHEN n > 1e-12 THEN v / n ELSE 0 END AS v FROM (
          SELECT *, sqrt(sum(v * v) OVER (PARTITION BY pair_no, branch, layer, head)) AS n FROM acts)""",
    "mu": """
        SELECT subtype, branch, layer, head, d, CASE WHEN n > 1e-12 THEN m / n ELSE 0 END AS v FROM (
          SELECT *, sqrt(sum(m * m) OVER (PARTITION BY subtype, branch, layer, head)) AS n FROM (
            SELECT subtype, branch, layer, head, d, avg(v) AS m FROM unit GROUP BY ALL))""",
    "axis": """
        SELECT subtype, layer, head, d, CASE WHEN n > 1e-12 THEN m / n ELSE 0 END AS v FROM (
          SELECT *, sqrt(sum(m * m) OVER (PARTITION BY subtype, layer, head)) AS n FROM (
            SELECT subtype, layer, head, d, max(v) FILTER (WHERE branch = 'pos') - max(v) FILTER (WHERE branch = 'neg') AS m FROM mu GROUP BY ALL))""",
    "scores": """
        SELECT u.pair_no, u.subtype, u.branch, sum(u.v * a.v) / 8 AS score FROM unit u JOIN axis a USING (subtype, layer, head, d) GROUP BY ALL""",
    "labeled": "SELECT subtype, CASE WHEN branch = 'pos' THEN 1 ELSE 0 END AS label, round(score, 9) AS score, pair_no FROM scores",
    "dirs": "SELECT subtype AS name, layer, head, d, avg(v) AS v FROM delta GROUP BY ALL",
    "headscore": "SELECT name, layer, head, sqrt(sum(v * v)) AS score FROM dirs GROUP BY ALL",
    "asked": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS obj,
          CASE (l_partkey + l_suppkey + l_linenumber) % 8
            WHEN 0 THEN 'Is there a ' || p_name || ' in the image?' WHEN 1 THEN 'How many ' || p_name || 's are there?'
            WHEN 2 THEN 'What color is the ' || p_name || '?' WHEN 3 THEN 'Is the ' || p_name || ' to the left of the ' || lower(p_type) || ' in the image?'
            WHEN 4 THEN 'Is there direct contact between the ' || p_name || ' and ' || lower(p_type) || '?' WHEN 5 THEN 'Is the ' || p_name || ' standing, not sitting'
            WHEN 6 THEN 'Are there any ' || p_name || '?' ELSE 'Describe ' || p_name || '.' END AS question,
          (l_partkey + l_suppkey + l_linenumber) % 8 AS kind, p_type, p_brand, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "said": """
        SELECT conv_id, turn, role, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Yes, ' || text WHEN 1 THEN 'No. ' || text WHEN 2 THEN 'I think yes: ' || text
          WHEN 3 THEN '"NO" - ' || text WHEN 4 THEN text ELSE 'Nothing here, true' END AS answer, CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END AS label FROM conversations""",
}


def _template_values() -> str:
    from pairloom.functions import fixed

    seen: dict[str, int] = {}
    rows = []
    for subtype, template_id, q, r in fixed.TEMPLATES:
        pos = seen.get(subtype, 0)
        seen[subtype] = pos + 1
        rows.append(f"('{subtype}', {pos}, '{template_id}', '{q}', '{r}')")
    return ", ".join(rows)


VIEWS["tpl"] = VIEWS["tpl"].replace("{templates}", _template_values())


def with_views(body: str) -> str:
    """Prefix ``body`` with the definitions of the views it names, dependencies first."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def spread(df: DataFrame) -> DataFrame:
    """A table with rows in fewer splits than there are cores, dealt out to all of them; any other table as it is.

    Splits are counted by the rows they hold: a file of few row groups is cut into many splits, most of them empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = min(df.rdd.getNumPartitions(), cores)
    if filled == cores:
        filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if filled < cores else df


class Tables:
    """The given tables and the domain tables bound to them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        self.__dict__[name] = spread(table) if name in FACT_TABLES else table
        return self.__dict__[name]

    @cached_property
    def images(self) -> DataFrame:
        side = F.lit(200.0)
        return self.orders.select(F.col("o_orderkey").cast("string").alias("image_id"), side.alias("width"), side.alias("height"), F.col("o_orderpriority").alias("priority"), "o_custkey")

    @cached_property
    def lines(self) -> DataFrame:
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def ann(self) -> DataFrame:
        box = F.struct(
            (F.col("l_partkey") % 150).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 150).cast("double").alias("y"),
            F.col("l_quantity").alias("w"), (F.lit(1) + F.lit(500) * F.col("l_discount")).alias("h"),
        )
        first = F.substring_index("p_name", " ", 1)
        return self.lines.select(
            F.col("l_orderkey").cast("string").alias("image_id"),
            (F.col("l_linenumber").cast("long") * 1000000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("annotation_id"),
            box.alias("box"),
            F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            (F.col("l_returnflag") == "R").alias("crowd"),
            text.lookup(first, NAME_COLORS, F.lit(None).cast("string")).alias("color"),
        )

    @cached_property
    def line_count(self) -> int:
        return self.spark.read.parquet(f"{self.dir}/lineitem.parquet").count()

    def by_image(self, df: DataFrame) -> DataFrame:
        """``df``, of one row a line item or less, dealt to shares by image."""
        return dealt(df, self.line_count, "image_id")

    @cached_property
    def objs(self) -> DataFrame:
        return facts.objects(self.images, self.by_image(self.ann))

    @cached_property
    def objs_table(self) -> DataFrame:
        """The objects, written once, for jobs that read them several times."""
        dealt_out = self.by_image(self.ann) is not self.ann
        return pinned(self.objs if dealt_out else self.objs.repartition("image_id"))

    @cached_property
    def cnt(self) -> DataFrame:
        return facts.category_counts(self.objs)

    @cached_property
    def vocab(self) -> DataFrame:
        grouped = self.part.groupBy(F.col("p_type").alias("category")).agg(F.min("p_brand").alias("semantic_group"))
        return grouped.withColumn("supercategory", F.substring("semantic_group", 1, 7)).withColumn("pos", F.col("category"))

    @cached_property
    def bank(self) -> DataFrame:
        return banks.candidate_pool(self.vocab)

    @cached_property
    def rels(self) -> DataFrame:
        return facts.numbered_relations(self.objs_table)

    @cached_property
    def facts(self) -> DataFrame:
        return facts.atomic_facts(self.objs_table, facts.category_counts(self.objs_table), self.rels)

    @cached_property
    def counts(self) -> DataFrame:
        """Category counts of every image as a map, from the written objects."""
        return facts.count_maps(facts.category_counts(self.objs_table))

    @cached_property
    def preds(self) -> DataFrame:
        """One row an event: the r-th of a user and type is that method's prediction for the user's r-th sample."""
        first = global_rank(self.events, ["user_id", "event_type"], ["event_id"], "r")
        value = F.col("value")
        names = F.array(*map(F.lit, ("cat_random", "attr_color", "attr_count", "rel_spatial")))
        return first.select(
            F.concat_ws("-", "user_id", "r").alias("sample_id"),
            F.col("event_type").alias("method"),
            F.get(names, (F.col("user_id") % 4).cast("int")).alias("subtype"),
            F.when((F.col("user_id") + F.col("r")) % 2 == 1, "yes").otherwise("no").alias("label"),
            F.when(value >= 35, "yes").when(value < 3, "invalid").otherwise("no").alias("pred"),
            value.alias("score"),
            (F.get_json_object("props", "$.k").cast("double") / 100).alias("alpha"),
            "event_id",
            "user_id",
        )

    @cached_property
    def base(self) -> DataFrame:
        return self.preds.filter("method = 'view'")

    @cached_property
    def vars(self) -> DataFrame:
        from pairloom.operators.joins import with_baseline

        return with_baseline(self.preds.filter("method <> 'view'"), self.base, ["subtype", "sample_id"])

    @cached_property
    def sg(self) -> DataFrame:
        """Scene-graph objects: one per annotation, with everyday names and attributes."""
        trait = text.lookup(F.substring_index("name", " ", 1), TRAITS)
        thing = text.lookup(F.substring_index("name", " ", -1), THINGS)
        return self.by_image(self.ann).join(self.images, "image_id").select(
            "image_id", F.col("annotation_id").cast("string").alias("object_id"), "annotation_id", thing.alias("name"), "category", "box", "priority",
            F.array(trait, F.lower("category")).alias("attributes"), "width", "height",
        )

    @cached_property
    def scenes(self) -> DataFrame:
        """Scene-graph objects with the relation of each: it points at the first one of its image; the first one points at nothing that exists."""
        names = F.array(*map(F.lit, ("on top of", "to the left of", "holding", "sitting on", "of")))
        first = F.min("annotation_id").over(Window.partitionBy("image_id")).cast("string")
        return self.sg.withColumn("first_id", first).withColumns({
            "relation": F.get(names, F.substring("priority", 1, 1).cast("int") - 1),
            "target_id": F.when(F.col("object_id") == F.col("first_id"), "nowhere").otherwise(F.col("first_id")),
        }).drop("first_id")

    @cached_property
    def scenes_table(self) -> DataFrame:
        """The scenes, written once, for jobs that read their objects and relations several times."""
        return pinned(self.scenes)

    @cached_property
    def edges_table(self) -> DataFrame:
        """The relations of the written scenes."""
        return self.scenes_table.select("image_id", F.col("object_id").alias("subject_id"), "relation", "target_id")

    @cached_property
    def edges(self) -> DataFrame:
        return self.scenes.select("image_id", F.col("object_id").alias("subject_id"), "relation", "target_id")

    @cached_property
    def acts(self) -> DataFrame:
        """Long vectors ``(pair_no, subtype, answer, condition, branch, layer, head, vec)``."""
        from pairloom.operators.vectors import unfold_heads

        e = self.embeddings
        lab = e.filter("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("pair_no"), F.col("label").alias("condition"))
        names = F.array(*map(F.lit, ("cat", "cnt", "col", "rel")))
        rows = e.select(
            F.floor(F.col("vec_id") / 2).alias("pair_no"), F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("branch"), F.col("embedding").alias("payload"),
        ).join(lab, "pair_no").withColumns({
            "subtype": F.get(names, F.col("condition") % 4), "answer": F.when(F.col("condition") < 5, "yes").otherwise("no"),
        })
        return unfold_heads(rows, "payload", HEADS, DIM)

    @cached_property
    def delta(self) -> DataFrame:
        """Positive minus negative vector of every pair and head."""
        from pairloom.operators.vectors import pair_deltas

        return pair_deltas(self.acts, ["pair_no", "subtype", "answer", "condition"])

    @cached_property
    def asked(self) -> DataFrame:
        """One question per line item."""
        kind = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 8
        name, ptype = F.col("p_name"), F.lower("p_type")

        def say(*parts: Column | str) -> Column:
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        question = (
            F.when(kind == 0, say("Is there a ", name, " in the image?")).when(kind == 1, say("How many ", name, "s are there?"))
            .when(kind == 2, say("What color is the ", name, "?")).when(kind == 3, say("Is the ", name, " to the left of the ", ptype, " in the image?"))
            .when(kind == 4, say("Is there direct contact between the ", name, " and ", ptype, "?")).when(kind == 5, say("Is the ", name, " standing, not sitting"))
            .when(kind == 6, say("Are there any ", name, "?")).otherwise(say("Describe ", name, "."))
        )
        return self.lines.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("obj"), question.alias("question"), kind.alias("kind"), "p_type", "p_brand", "l_returnflag"
        )

    @cached_property
    def said(self) -> DataFrame:
        """One generated answer per conversation turn."""
        k = (F.col("conv_id") + F.col("turn")) % 6
        answer = (
            F.when(k == 0, F.concat(F.lit("Yes, "), "text")).when(k == 1, F.concat(F.lit("No. "), "text")).when(k == 2, F.concat(F.lit("I think yes: "), "text"))
            .when(k == 3, F.concat(F.lit('"NO" - '), "text")).when(k == 4, F.col("text")).otherwise("Nothing here, true")
        )
        return self.conversations.select("conv_id", "turn", "role", answer.alias("answer"), F.when(F.col("conv_id") % 2 == 0, "yes").otherwise("no").alias("label"))


__all__ = ["Tables", "VIEWS", "with_views", "vectors"]
