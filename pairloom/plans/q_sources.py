"""Round trips through the readers and writers, and the two streams (sections A1-A14, I1, I2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import facts, joins, metrics
from pairloom.plans.bind import Tables
from pairloom.plans.q_metrics import rounded
from pairloom.plans.registry import query
from pairloom.session import fresh_path, pinned
from pairloom.sources import benchmarks, readers, sinks
from pairloom.streaming import incremental

CHUNK = 500


def documents_of(df: DataFrame, chunk, payload, path: str) -> str:
    """Write one JSON document per chunk, each in its own compressed file; one folder holds them all."""
    docs = df.groupBy(chunk.alias("chunk")).agg(payload.alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


def documents_needed(df: DataFrame, rows: int = 2000) -> int:
    """How many documents keep each near ``rows`` rows."""
    return max(1, df.count() // rows)


@query("A1_jsonl", "SELECT doc_id, text, lang, n_chars FROM documents")
def a1(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a1")
    sinks.write_table(t.documents, path, "json")
    return readers.read_jsonl(t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint")


@query("A1_bad_lines", "SELECT count(*) AS n, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'list' ELSE 'broken' END) AS kinds FROM documents WHERE doc_id % 50 = 0")
def a1_bad(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a1")
    good = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(F.col("doc_id") % 50 != 0, good).when(F.col("doc_id") % 3 == 0, "[1, 2]").otherwise('{"doc_id": ')
    t.documents.select(line.alias("value")).unionByName(t.benchmark.select(F.lit("").alias("value"))).write.text(path)
    found = readers.bad_lines(t.spark, path, "doc_id bigint, lang string")
    kind = F.when(F.col("line").startswith("["), "list").otherwise("broken")
    return found.agg(F.count("*").alias("n"), F.countDistinct(kind).alias("kinds"))


@query("A2_json_documents", "SELECT doc_id AS id, lang, n_chars FROM documents")
def a2(t: Tables) -> DataFrame:
    """Four document layouts by chunk: a list, a wrapped list, a map of records, and lines in a .json file."""
    path = fresh_path(t.spark, "a2")
    kind = F.floor(F.col("doc_id") / CHUNK) % 4
    record = F.struct(F.col("doc_id").alias("id"), "lang", "n_chars")
    rows = F.collect_list(record)
    keyed = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.struct("lang", "n_chars"))))
    lines = F.array_join(F.collect_list(F.to_json(record)), "\n")
    k = F.first(kind)
    payload = F.when(k == 0, F.to_json(rows)).when(k == 1, F.to_json(F.struct(F.lit("v1").alias("version"), rows.alias("samples")))).when(k == 2, F.to_json(keyed)).otherwise(lines)
    documents_of(t.documents, F.floor(F.col("doc_id") / CHUNK), payload, path)
    return readers.read_json_documents(t.spark, path, "id bigint, lang string, n_chars bigint")


@query("A3_annotation_set", "SELECT image_id, annotation_id, category, CASE WHEN crowd THEN 1 ELSE 0 END AS crowd, x, round(h, 6) AS h FROM ann")
def a3(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a3")
    names = joins.vocabulary_of(t.part, "p_type")
    number = F.array_position(F.array(*map(F.lit, names)), F.col("category"))
    box = F.array(*[F.col(f"box.{c}") for c in "xywh"])
    ann = F.struct(F.col("annotation_id").alias("id"), F.col("image_id").cast("long").alias("image_id"), number.alias("category_id"), box.alias("bbox"), F.col("crowd").cast("int").alias("iscrowd"))
    cats = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    chunk = F.pmod(F.xxhash64("annotation_id"), F.lit(documents_needed(t.lineitem)))
    images = F.collect_set(F.struct(F.col("image_id").cast("long").alias("id"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height")))
    documents_of(t.ann, chunk, F.to_json(F.struct(images.alias("images"), F.collect_list(ann).alias("annotations"), cats.alias("categories"))), path)
    got = readers.read_annotation_set(t.spark, path)
    return got["annotations"].select("image_id", "annotation_id", "category", F.col("crowd").cast("int").alias("crowd"), F.col("box.x").alias("x"), F.round("box.h", 6).alias("h"))


@query("A4_scene_graphs", "SELECT e.image_id, e.subject_id, s.name, e.relation, e.target_id FROM edges e JOIN sg s ON s.image_id = e.image_id AND s.object_id = e.subject_id")
def a4(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a4")
    rel = F.array(F.struct(F.col("relation").alias("name"), F.col("target_id").alias("object")))
    node = F.struct("object_id", F.struct("name", "attributes", "relations", "box.x", "box.y", "box.w", "box.h"))
    # An image with very many objects is spread over documents, each with a part of them.
    chunk = F.pmod(F.xxhash64("object_id"), F.lit(documents_needed(t.lineitem)))
    # Dealt by document once: its images and then the document itself are put together where the rows are.
    dealt = t.scenes.withColumns({"relations": rel, "part": chunk}).repartition("part")
    parts = dealt.groupBy("part", "image_id").agg(
        F.struct(F.first("width").alias("width"), F.first("height").alias("height"), F.map_from_entries(F.collect_list(node)).alias("objects")).alias("scene")
    )
    documents_of(parts, F.col("part"), F.to_json(F.map_from_entries(F.collect_list(F.struct("image_id", "scene")))), path)
    objects, edges = readers.read_scene_graphs(t.spark, path)
    names = objects.select("image_id", F.col("object_id").alias("subject_id"), "name")
    return edges.join(names, ["image_id", "subject_id"]).select("image_id", "subject_id", "name", "relation", "target_id")


@query("A6_delimited", "SELECT doc_id, md5(text) AS text, lang, source FROM documents")
def a6(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a6")
    sinks.write_table(t.documents, path, "csv")
    got = readers.read_delimited(t.spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", multi_line=True)
    return got.select("doc_id", F.md5("text").alias("text"), "lang", "source")


@query("A7_category_rows", "SELECT p_partkey, p_name FROM part WHERE p_type IN ('PROMO', 'LARGE')")
def a7(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a7")
    t.part.withColumnRenamed("p_type", "category").write.partitionBy("p_size").parquet(path)
    return readers.read_category_rows(t.spark, path, ["promo", " Large"], ["p_partkey", "p_name"], ["PROMO", "LARGE"])


RUNS_SQL = """m AS (SELECT subtype, method, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS acc, avg(CASE WHEN pred = 'yes' THEN 1.0 ELSE 0 END) AS rate FROM preds GROUP BY ALL)"""


@query(
    "A8_run_folders",
    f"""WITH {RUNS_SQL} SELECT v.method || '_cat_alpha0.5' AS run, v.subtype AS benchmark, 'cat' AS expert, 0.5::DOUBLE AS alpha, round(b.acc, 6) AS accuracy_baseline, round(v.acc, 6) AS accuracy_steered,
      round(v.acc - b.acc, 6) AS delta_accuracy, round(v.rate, 6) AS yes_rate_steered, v.n AS num_samples FROM m v JOIN m b ON b.subtype = v.subtype AND b.method = 'view' WHERE v.method <> 'view'""",
)
def a8(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a8")
    table = metrics.yes_no_metrics(t.preds, ["subtype", "method"])
    base = table.filter("method = 'view'").select("subtype", F.col("accuracy").alias("b"))
    runs = table.filter("method <> 'view'").join(base, "subtype").select(
        F.col("subtype").alias("benchmark"), F.concat("method", F.lit("_cat_alpha0.5")).alias("run"), F.struct(F.col("b").alias("accuracy"), F.col("n").alias("num_samples")).alias("baseline"),
        F.struct(F.col("accuracy").alias("accuracy")).alias("steered"), F.struct(F.col("yes_rate").alias("yes_rate_steered")).alias("fixed_steering"),
    )
    runs.write.partitionBy("benchmark", "run").json(path)
    got = readers.read_runs(t.spark, path)
    return rounded(got.select("run", "benchmark", "expert", "alpha", "accuracy_baseline", "accuracy_steered", "delta_accuracy", "yes_rate_steered", "num_samples"))


@query("A8_prediction_lines", "SELECT sample_id, subtype, label, pred, score, 'shard=' || method AS shard, 1 AS from_lines FROM preds")
def a8_lines(t: Tables) -> DataFrame:
    """Raw shards of prediction lines, with the shard and file of every line."""
    path = fresh_path(t.spark, "a8")
    t.preds.select("sample_id", "subtype", "label", "pred", "score", F.col("method").alias("shard")).write.partitionBy("shard").json(path)
    got = readers.read_predictions(t.spark, path, "sample_id string, subtype string, label string, pred string, score double", "*.json")
    return got.select("sample_id", "subtype", "label", "pred", "score", "shard", F.col("file").endswith(".json").cast("int").alias("from_lines"))


@query(
    "A8_run_tables",
    f"WITH {RUNS_SQL} SELECT method AS run, subtype AS benchmark, round(acc, 6) AS accuracy_steered, round(acc - 0.25, 6) AS delta_accuracy, CAST(n AS DOUBLE) AS num_samples FROM m",
)
def a8_tables(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a8")
    table = metrics.yes_no_metrics(t.preds, ["subtype", "method"]).select(F.col("method").alias("setting"), F.col("subtype").alias("dataset"), F.lit(0.25).alias("acc_base"), F.col("accuracy").alias("acc_steer"), "n")
    sinks.write_table(table, path, "csv")
    got = readers.normalize_run_table(readers.read_delimited(t.spark, path, "setting string, dataset string, acc_base double, acc_steer double, n double"))
    return rounded(got.select("run", "benchmark", "accuracy_steered", "delta_accuracy", "num_samples"))


@query(
    "A9_benchmark_manifest",
    """WITH a AS (SELECT 'MSCOCO' AS dataset, 'random' AS setting, label, sample_id FROM preds WHERE method = 'view' UNION ALL SELECT 'GQA', 'popular', label, sample_id FROM preds WHERE method = 'click'),
    l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY dataset, setting ORDER BY sample_id) <= 250) SELECT dataset, setting, label, count(*) AS n FROM l GROUP BY ALL""",
)
def a9(t: Tables) -> DataFrame:
    part = lambda m: t.preds.filter(F.col("method") == m).select("sample_id", F.upper("label").alias("gt_answer"), F.lit("Is it?").alias("query"))
    return benchmarks.manifest(benchmarks.load_benchmarks({("MSCOCO", "random"): part("view"), ("GQA", "popular"): part("click")}, limit=250))


@query("A10_path_catalogue", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang || '.txt' END AS resolved FROM documents")
def a10(t: Tables) -> DataFrame:
    """A listing of paths and rows that name them in four ways; the last way finds nothing."""
    files = t.documents.select("lang").distinct().select(F.concat(F.lit("/data/"), "lang", F.lit(".txt")).alias("path"), F.concat("lang", F.lit(".txt")).alias("name"))
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("/data/"), "lang", F.lit(".txt"))).when(k == 1, F.concat("lang", F.lit(".txt"))).when(k == 2, F.concat(F.lit("/old/place/"), "lang", F.lit(".txt"))).otherwise("gone.txt")
    )
    got = readers.resolve_paths(t.documents.select("doc_id", raw.alias("raw")), files, "doc_id", "raw", ["/data"])
    return got.select("doc_id", F.substring_index("resolved", "/", -1).alias("resolved"))


@query(
    "A11_payload_catalogue",
    """WITH p AS (SELECT page_id, lower(trim(substr(url, 8, 1))) AS category, CASE WHEN page_id % 9 = 0 THEN NULL ELSE html END AS html FROM pages)
    SELECT category, CASE WHEN html IS NOT NULL THEN strlen(html) END AS size, CASE WHEN html IS NOT NULL THEN 'img_' || category || '_' || lpad(CAST(row_number() OVER (PARTITION BY category, html IS NULL ORDER BY page_id) - 1 AS VARCHAR), 5, '0') || '_p_' || page_id || '.png' END AS name,
      CASE WHEN html IS NULL THEN 'missing_image_bytes' END AS reason FROM p""",
)
def a11(t: Tables) -> DataFrame:
    payload = F.when(F.col("page_id") % 9 != 0, F.encode("html", "UTF-8"))
    path = F.concat(F.lit("dir\\p "), F.col("page_id"), F.lit(".PNG"))
    rows = t.pages.select("page_id", F.substring("url", 8, 1).alias("category"), payload.alias("payload"), path.alias("path"))
    got = readers.payload_catalogue(rows, "category", "payload", "path", "page_id")
    return got.select("category", F.col("size").cast("long").alias("size"), "name", "reason")


@query("A12_partitioned_sink", "SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'val' END AS split, lang, count(*) AS n FROM documents GROUP BY ALL")
def a12(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "a12")
    rows = t.documents.withColumn("split", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val"))
    sinks.write_table(rows, path, "parquet", ["split", "lang"])
    return t.spark.read.parquet(path).groupBy("split", "lang").agg(F.count("*").alias("n"))


SIG = "sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}')"


@query(
    "A13_ordered_fingerprint",
    f"""WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, {SIG} AS g FROM documents), c AS (SELECT i // 300 AS c, sha256(string_agg(g, chr(10) ORDER BY i)) AS h FROM s GROUP BY 1)
    SELECT (SELECT count(*) FROM s) AS rows, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, chr(10) ORDER BY c)) END AS digest FROM c""",
)
def a13(t: Tables) -> DataFrame:
    return sinks.ordered_hash(t.documents, ["doc_id", "lang", "source"], ["doc_id"], 300)


@query("A13_first_rows", f"SELECT count(*) AS rows, sha256(string_agg(g, chr(10) ORDER BY doc_id)) AS digest FROM (SELECT doc_id, {SIG} AS g FROM documents ORDER BY doc_id LIMIT 20)")
def a13_first(t: Tables) -> DataFrame:
    return sinks.first_rows_hash(t.documents, ["doc_id", "lang", "source"], ["doc_id"])


@query(
    "A13_manifest",
    f"SELECT count(*) AS rows, count(DISTINCT lang) AS groups, CAST(sum(CAST(CAST('0x' || substr({SIG}, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest, 'doc_id,lang,source' AS columns FROM documents",
)
def a13_manifest(t: Tables) -> DataFrame:
    return sinks.manifest(t.documents, ["doc_id", "lang", "source"], "lang")


@query("A14_resume", "SELECT image_id, count(*) AS n FROM objs GROUP BY image_id")
def a14(t: Tables) -> DataFrame:
    """Two runs over growing input: the second adds only images the first did not write."""
    path = fresh_path(t.spark, "a14")
    counts = t.objs.groupBy("image_id").agg(F.count("*").alias("n"))
    sinks.resume_append(counts.filter("image_id < '5'"), path, "image_id")
    sinks.resume_append(counts, path, "image_id")
    return t.spark.read.parquet(path)


@query("I1_incremental_facts", "SELECT image_id, category, n FROM cnt")
def i1(t: Tables) -> DataFrame:
    """Annotations arrive in three runs, whole images at a time, some of them twice."""
    spark, base = t.spark, fresh_path(t.spark, "i1")
    arriving = pinned(t.objs.select("image_id", "annotation_id", "category"))
    part = F.pmod(F.xxhash64("image_id"), F.lit(3))
    for i in range(3):
        again = arriving.filter(part == 0) if i == 2 else arriving.limit(0)
        arriving.filter(part == i).unionByName(again).write.mode("append").parquet(f"{base}/in")
        stream = incremental.file_stream(spark, f"{base}/in", arriving.schema)
        incremental.incremental_facts(stream, lambda b: facts.category_counts(b.dropDuplicates(["image_id", "annotation_id"])), f"{base}/out", f"{base}/late", f"{base}/state")
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/epoch=*").select("image_id", "category", "n")


@query(
    "I1_late_rows",
    """SELECT image_id, category, count(*) FILTER (WHERE l_linenumber < 3) AS n, count(*) FILTER (WHERE l_linenumber >= 3 AND first < 3) AS late
       FROM (SELECT *, annotation_id // 1000000000000000 AS l_linenumber, min(annotation_id // 1000000000000000) OVER (PARTITION BY image_id) AS first FROM objs) WHERE first < 3 GROUP BY ALL""",
)
def i1_late(t: Tables) -> DataFrame:
    """The first two lines of an image arrive in a first run, the others later: those of known images are late, the rest is new."""
    spark, base = t.spark, fresh_path(t.spark, "i1")
    arriving = pinned(t.objs.select("image_id", "annotation_id", "category"))
    early = F.col("annotation_id") < 3000000000000000
    for part in (early, ~early):
        arriving.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = incremental.file_stream(spark, f"{base}/in", arriving.schema)
        incremental.incremental_facts(stream, facts.category_counts, f"{base}/out", f"{base}/late", f"{base}/state")
    made = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/epoch=*").filter("epoch = 0").select("image_id", "category", F.col("n").alias("_n"))
    late = spark.read.option("basePath", f"{base}/late").parquet(f"{base}/late/epoch=*").groupBy("image_id", "category").agg(F.count("*").alias("_late"))
    both = made.join(late, ["image_id", "category"], "full")
    return both.select("image_id", "category", *[F.coalesce(f"_{c}", F.lit(0)).cast("long").alias(c) for c in ("n", "late")])


@query(
    "I2_live_counters",
    """SELECT subtype, method, count(*) AS n, count(*) FILTER (WHERE label = 'yes' AND pred = 'yes') AS tp, count(*) FILTER (WHERE label = 'no' AND pred = 'no') AS tn, count(*) FILTER (WHERE label = 'no' AND pred <> 'no') AS fp,
       count(*) FILTER (WHERE label = 'yes' AND pred <> 'yes') AS fn, count(*) FILTER (WHERE pred = 'invalid') AS invalid, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM preds GROUP BY ALL""",
)
def i2(t: Tables) -> DataFrame:
    spark, base = t.spark, fresh_path(t.spark, "i2")
    rows = t.preds.select("subtype", "method", "sample_id", "label", "pred")
    rows.repartition(6, "sample_id").write.parquet(f"{base}/in")
    stream = incremental.file_stream(spark, f"{base}/in", rows.schema, files_per_trigger=1)
    incremental.live_counters(stream, ["subtype", "method"], f"{base}/out", f"{base}/state", compact=2)
    return rounded(incremental.latest_counters(spark, f"{base}/out", ["subtype", "method"]))
