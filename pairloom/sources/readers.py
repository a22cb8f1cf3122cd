"""Readers for line-delimited and nested JSON, annotation sets, scene graphs, delimited text, Parquet and run folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import text
from pairloom.operators.validate import ValidationError

LIST_KEYS = ("data", "samples", "questions", "annotations", "items", "results", "relationships")


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped.

    Lines are read once. ``strict`` makes the action that meets a line which is not an object of this schema fail with
    its file and begin; otherwise such lines are dropped and can be listed with :func:`bad_lines`.
    """
    s = schema_of(schema)
    if strict:
        lines, bad, parsed = _judged_lines(spark, path, s)
        refused = F.raise_error(F.concat_ws(": ", F.lit("not a JSON object"), "file", F.left("line", F.lit(80))))
        return lines.select(F.when(bad, refused).otherwise(parsed).alias("o")).select(*[F.col("o")[f.name].alias(f.name) for f in s.fields])
    return spark.read.schema(s).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(file, line) of the lines a strict read would refuse."""
    lines, bad, _ = _judged_lines(spark, path, schema_of(schema))
    return lines.filter(bad).select("file", "line")


def _judged_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, Column, Column]:
    """Lines with their file, whether a line is no object of the schema, and the object."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).filter("line <> ''")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines, ~F.col("line").startswith("{") | parsed["_corrupt"].isNotNull(), parsed


def _document_rows(doc: Column) -> Column:
    """ARRAY of JSON texts of the records of one document."""
    t = text.strip(doc)
    lines = F.filter(F.split(t, r"\r?\n"), lambda x: F.trim(x) != "")
    per_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    fields = F.from_json(t, "map<string,string>")
    listed: Column = F.lit(None).cast("array<string>")
    for key in reversed(LIST_KEYS):
        listed = F.when(F.coalesce(fields[key], F.lit("")).startswith("["), F.from_json(fields[key], "array<string>")).otherwise(listed)
    records = F.forall(F.map_values(fields), lambda v: v.startswith("{"))
    keyed = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit('{"_key":'), F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.when(e["value"] == "{}", "").otherwise(","), e["value"].substr(F.lit(2), F.length(e["value"]))))
    return (
        F.when(t.startswith("["), F.from_json(t, "array<string>")).when(per_line, lines).when(listed.isNotNull(), listed).when(records & (F.size(fields) > 0), keyed).otherwise(F.array(t))
    )


def read_json_documents(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "id") -> DataFrame:
    """Records of whole-file JSON documents.

    A list is taken as it is; an object gives the first list under ``LIST_KEYS``, else, when all its values are
    objects, those with their key as ``key``; a file that is line-delimited in truth is read line by line. A
    document is one row while it is opened, so it has to fit a task; a folder of them is read in parallel.
    """
    s = schema_of(schema)
    docs = spark.read.option("wholetext", True).text(path)
    each = docs.select(F.explode(_document_rows(F.col("value"))).alias("_json"))
    wide = T.StructType([*s.fields, T.StructField("_key", T.StringType())])
    rows = each.select(F.from_json("_json", wide).alias("r")).select("r.*")
    if key in s.names:
        rows = rows.withColumn(key, F.coalesce(F.col(key), F.col("_key").cast(s[key].dataType)))
    return rows.drop("_key")


ANNOTATION_SET = """
    images array<struct<id:bigint,file_name:string,width:double,height:double>>,
    annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int,segment_id:bigint>>,
    categories array<struct<id:bigint,name:string>>"""
SEGMENT_SET = "annotations array<struct<image_id:bigint,file_name:string,segments_info:array<struct<id:bigint,category_id:bigint,area:double,bbox:array<double>>>>>"


def box_of(bbox: Column) -> Column:
    """[x, y, w, h] as a box; null unless it has four numbers."""
    return F.when(F.size(bbox) == 4, F.struct(*[bbox[i].alias(c) for i, c in enumerate("xywh")]))


def read_annotation_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of annotation documents; images without annotations stay."""
    doc = spark.read.schema(ANNOTATION_SET).option("multiLine", True).json(path)
    images = doc.select(F.inline("images")).select(F.col("id").cast("string").alias("image_id"), "file_name", "width", "height").distinct()
    cats = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category")).distinct()
    anns = doc.select(F.inline("annotations")).select(
        F.col("image_id").cast("string").alias("image_id"), F.col("id").alias("annotation_id"), "category_id", box_of(F.col("bbox")).alias("box"), "area",
        (F.coalesce("iscrowd", F.lit(0)) != 0).alias("crowd"), "segment_id",
    )
    return {"images": images, "annotations": anns.join(cats, "category_id", "left"), "categories": cats}


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(SEGMENT_SET).option("multiLine", True).json(path)
    each = doc.select(F.inline("annotations")).select(F.col("image_id").cast("string").alias("image_id"), F.posexplode("segments_info").alias("pos", "s"))
    return each.select("image_id", "pos", F.col("s.id").alias("segment_id"), F.col("s.category_id").alias("category_id"), F.col("s.area").alias("area"), box_of(F.col("s.bbox")).alias("box"))


SCENE = "map<string,struct<width:double,height:double,objects:map<string,struct<name:string,attributes:array<string>,relations:array<struct<name:string,object:string>>,x:double,y:double,w:double,h:double>>>>"


def read_scene_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Objects and edges of scene-graph documents (image id -> objects -> relations)."""
    docs = spark.read.option("wholetext", True).text(path)
    scenes = docs.select(F.explode(F.from_json("value", SCENE)).alias("image_id", "scene"))
    each = scenes.select("image_id", F.col("scene.width").alias("width"), F.col("scene.height").alias("height"), F.explode("scene.objects").alias("object_id", "o"))
    box = F.struct(*[F.col(f"o.{c}").alias(c) for c in "xywh"])
    objects = each.select("image_id", "object_id", F.col("o.name").alias("name"), F.coalesce("o.attributes", F.array().cast("array<string>")).alias("attributes"), box.alias("box"), "width", "height")
    edges = each.select("image_id", F.col("object_id").alias("subject_id"), F.explode("o.relations").alias("r")).select("image_id", "subject_id", F.col("r.name").alias("relation"), F.col("r.object").alias("target_id"))
    return objects, edges


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV, or TSV when the path says so. The schema is given: nothing is inferred by reading twice.

    Files are split between tasks; ``multi_line`` allows line breaks inside quotes, and then every file is one task.
    """
    sep = sep or ("\t" if path.rstrip("/").endswith(".tsv") else ",")
    return spark.read.schema(schema_of(schema)).option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').csv(path)


def read_category_rows(spark: SparkSession, path: str, categories: Sequence[str], columns: Sequence[str], raw: Sequence[str] = ()) -> DataFrame:
    """Rows of some categories from Parquet, reading only the columns asked for.

    ``raw`` lists the spellings that occur; given, it is pushed down so that row groups without them are skipped.
    """
    df = spark.read.parquet(path)
    if raw:
        df = df.filter(F.col("category").isin(*raw))
    kept = [c for c in columns if c in df.columns]
    return df.filter(F.lower(F.trim("category")).isin(*[c.strip().lower() for c in categories])).select(*kept)


METRICS = """
    benchmark_name string, alpha double, num_samples bigint, accuracy_baseline double, accuracy_steered double, delta_accuracy double, f1_yes double,
    yes_rate_baseline double, yes_rate_steered double, wrong_to_right bigint, right_to_wrong bigint, changed_pred bigint,
    fixed_steering struct<alpha:double,num_samples:bigint,delta_accuracy:double,f1_steered:double,yes_rate_baseline:double,yes_rate_steered:double,wrong_to_right:bigint,right_to_wrong:bigint,changed_pred:bigint>,
    baseline struct<benchmark_name:string,accuracy:double,f1_yes:double,yes_rate:double,num_samples:bigint>, steered struct<accuracy:double,f1_yes:double,yes_rate:double>"""


def read_runs(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Metric files under a folder, one row each: run, benchmark, expert and alpha from the path where the file lacks them.

    Fields come from the top level, then from ``fixed_steering``, ``steered`` and ``baseline``.
    """
    raw = spark.read.schema(METRICS).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).json(path)
    file = F.col("_metadata.file_path")
    run_path = F.regexp_replace(file, "/[^/]*$", "")
    run = F.regexp_replace(F.substring_index(run_path, "/", -1), "^run=", "")
    parent = F.regexp_replace(F.try_element_at(F.split(run_path, "/"), F.lit(-2)), "^[a-z]+=", "")
    place = F.concat_ws("/", parent, run)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names])

    base, steered = first("accuracy_baseline", "baseline.accuracy"), first("accuracy_steered", "steered.accuracy")
    return raw.select(
        run.alias("run"), F.coalesce(F.col("benchmark_name"), F.col("baseline.benchmark_name"), text.benchmark_of_run(place)).alias("benchmark"), text.expert_of_run(run).alias("expert"),
        F.coalesce(F.col("alpha"), F.col("fixed_steering.alpha"), text.alpha_of_name(run)).alias("alpha"), base.alias("accuracy_baseline"), steered.alias("accuracy_steered"),
        F.coalesce(F.col("delta_accuracy"), F.col("fixed_steering.delta_accuracy"), steered - base).alias("delta_accuracy"),
        first("f1_yes", "fixed_steering.f1_steered", "steered.f1_yes").alias("f1_steered"),
        first("yes_rate_steered", "fixed_steering.yes_rate_steered", "steered.yes_rate").alias("yes_rate_steered"),
        first("wrong_to_right", "fixed_steering.wrong_to_right").alias("wrong_to_right"), first("right_to_wrong", "fixed_steering.right_to_wrong").alias("right_to_wrong"),
        first("num_samples", "fixed_steering.num_samples", "baseline.num_samples").alias("num_samples"),
    )


RUN_ALIASES = {
    "accuracy_baseline": ("accuracy_baseline", "acc_base"), "accuracy_steered": ("accuracy_steered", "acc_steer"), "delta_accuracy": ("delta_accuracy", "delta"),
    "f1_steered": ("f1_steered", "f1"), "yes_rate_steered": ("yes_rate_steered", "yes_steer"), "wrong_to_right": ("wrong_to_right", "w2r"),
    "right_to_wrong": ("right_to_wrong", "r2w"), "num_samples": ("num_samples", "n"),
}


def normalize_run_table(df: DataFrame) -> DataFrame:
    """Result tables with short column names, in the columns of :func:`read_runs`."""
    def first(names: Sequence[str]) -> Column:
        present = [F.when(F.col(n).cast("string") != "", F.col(n).cast("double")) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("double")

    cols = {k: first(ns) for k, ns in RUN_ALIASES.items()}
    named = [F.coalesce(*[F.col(n) for n in ns if n in df.columns], F.lit("")).alias(k) for k, ns in {"run": ("run", "setting"), "benchmark": ("benchmark", "dataset"), "expert": ("expert",)}.items()]
    delta = F.coalesce(cols["delta_accuracy"], cols["accuracy_steered"] - cols["accuracy_baseline"])
    return df.select(*named, first(("alpha",)).alias("alpha"), *[(delta if k == "delta_accuracy" else c).alias(k) for k, c in cols.items()])


def read_predictions(spark: SparkSession, path: str, schema: str | T.StructType, glob: str = "*.jsonl") -> DataFrame:
    """Prediction lines under a folder with the shard and file they come from."""
    raw = spark.read.schema(schema_of(schema)).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select("*", F.try_element_at(parts, F.lit(-2)).alias("shard"), F.element_at(parts, -1).alias("file"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size) of files without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))


def resolve_paths(rows: DataFrame, files: DataFrame, key: str, raw: str, roots: Sequence[str] = (), padded_id: str | None = None) -> DataFrame:
    """Add ``resolved``: the first that exists of the explicit path, root-joined paths, the 12-digit name, the base name.

    ``files(path, name)``. Candidates are joined with the listing by equality, then the best one is kept per row.
    """
    bare = F.regexp_replace("path", "^file:", "")
    known = files.select(bare.alias("candidate"), F.lit(True).alias("_hit"))
    by_name = files.groupBy("name").agg(F.min(bare).alias("_by_name"))
    value = F.coalesce(F.col(raw), F.lit(""))
    options = [F.when(value.startswith("/"), value), *[F.when(~value.startswith("/") & (value != ""), F.concat(F.lit(r.rstrip("/") + "/"), value)) for r in roots]]
    if padded_id is not None:
        options += [F.concat(F.lit(r.rstrip("/") + "/"), F.lpad(F.col(padded_id).cast("string"), 12, "0"), F.lit(".jpg")) for r in roots]
    listed = rows.select(key, F.posexplode(F.array(*options)).alias("_order", "candidate")).filter("candidate is not null")
    best = listed.join(known, "candidate").groupBy(key).agg(F.min_by("candidate", "_order").alias("_found"))
    named = rows.withColumn("name", F.substring_index(value, "/", -1)).join(by_name, "name", "left").join(best, key, "left")
    return named.withColumn("resolved", F.coalesce("_found", "_by_name")).drop("_found", "_by_name", "name")


def payload_catalogue(rows: DataFrame, category: str, payload: str, source_path: str, order: str) -> DataFrame:
    """Name, suffix, size and digest of binary payloads; rows without bytes carry a reason instead."""
    from pairloom.operators.ordering import global_rank
    from pairloom.session import pinned

    path = F.coalesce(F.col(source_path), F.lit(""))
    leaf = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    suffix = F.lower(F.regexp_extract(leaf, r"(\.[A-Za-z0-9]+)$", 1))
    stem = text.safe_name(F.regexp_replace(leaf, r"\.[^.]*$", ""), 80, "image")
    shaped = rows.select(
        F.col(order).alias("_order"), F.lower(F.trim(category)).alias("category"), stem.alias("stem"), F.when(suffix.isin(".jpg", ".jpeg", ".png", ".bmp", ".webp"), suffix).otherwise(".jpg").alias("suffix"),
        F.octet_length(payload).alias("size"), F.sha2(F.col(payload), 256).alias("digest"), F.when(F.col(payload).isNull(), "missing_image_bytes").alias("reason"),
    )
    ready = pinned(shaped)
    ranked = global_rank(ready.filter("reason is null"), ["category"], ["_order"], "_r")
    name = F.concat_ws("_", F.lit("img"), "category", F.lpad((F.col("_r") - 1).cast("string"), 5, "0"), "stem")
    return ranked.withColumn("name", F.concat(name, "suffix")).drop("_r").unionByName(ready.filter("reason is not null").withColumn("name", F.lit(None).cast("string")))
