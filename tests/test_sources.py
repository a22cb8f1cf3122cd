import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairloom.operators.validate import ValidationError
from pairloom.session import fresh_path
from pairloom.sources import benchmarks, readers, records, sinks
from pairloom.streaming import incremental


def write_lines(spark, *lines):
    path = fresh_path(spark, "t")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_strict_and_lenient_lines(spark):
    path = write_lines(spark, '{"a": 1}', "", "[1]", '{"a": 2}')
    with pytest.raises(Exception, match=r"not a JSON object: .*: \[1\]"):
        readers.read_jsonl(spark, path, "a int").collect()
    assert readers.bad_lines(spark, path, "a int").count() == 1
    good = write_lines(spark, '{"a": 1}', "", '{"a": 2}')
    assert sorted(r["a"] for r in readers.read_jsonl(spark, good, "a int").collect()) == [1, 2]


@pytest.mark.parametrize(
    "text",
    ['[{"id": "a", "v": 1}, {"id": "b", "v": 2}]', '{"x": 1, "questions": [{"id": "a", "v": 1}, {"id": "b", "v": 2}]}', '{"a": {"v": 1}, "b": {"v": 2}}', '{"id": "a", "v": 1}\n{"id": "b", "v": 2}'],
)
def test_document_layouts(spark, tmp_path, text):
    (tmp_path / "doc.json").write_text(text)
    got = readers.read_json_documents(spark, f"file:{tmp_path}/doc.json", "id string, v int")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("a", 1), ("b", 2)]


def test_annotation_sets_and_scene_graphs(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"images": [{"id": 1, "width": 100, "height": 100}, {"id": 2, "width": 9, "height": 9}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 6, "image_id": 1, "category_id": 9, "bbox": [1]}],'
        ' "categories": [{"id": 3, "name": "cat"}]}'
    )
    got = readers.read_annotation_set(spark, f"file:{tmp_path}/a.json")
    assert got["images"].count() == 2
    rows = {r["annotation_id"]: r for r in got["annotations"].collect()}
    assert rows[5]["category"] == "cat" and rows[5]["box"]["w"] == 3.0 and rows[6]["category"] is None and rows[6]["box"] is None
    (tmp_path / "s.json").write_text('{"7": {"width": 10, "height": 10, "objects": {"1": {"name": "man", "attributes": [], "relations": [{"name": "on", "object": "2"}], "x": 1, "y": 1, "w": 2, "h": 2}, "2": {"name": "mat"}}}}')
    objects, edges = readers.read_scene_graphs(spark, f"file:{tmp_path}/s.json")
    assert objects.count() == 2 and [tuple(r) for r in edges.collect()] == [("7", "1", "on", "2")]


def test_sinks_refuse_to_overwrite_and_resume(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    path = fresh_path(spark, "t")
    sinks.write_table(df, path, "parquet")
    with pytest.raises(AnalysisException):
        sinks.write_table(df, path, "parquet")
    sinks.resume_append(spark.range(15).select(F.col("id").cast("string").alias("k")), path, "k")
    sinks.resume_append(spark.range(15).select(F.col("id").cast("string").alias("k")), path, "k")
    assert spark.read.parquet(path).count() == 15


def test_hashes_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    for h in (lambda d: sinks.table_hash(d, ["id", "v"]), lambda d: sinks.ordered_hash(d, ["v"], ["id"], 100)):
        assert h(df.repartition(1)).first() == h(df.repartition(13)).first()
    swapped = df.withColumn("v", F.when(F.col("id") == 0, 5).otherwise(F.col("v")))
    assert sinks.ordered_hash(df, ["v"], ["id"], 100).first() != sinks.ordered_hash(swapped, ["v"], ["id"], 100).first()


def test_benchmark_rows(spark):
    df = spark.createDataFrame([("7", "", "Is it?", "YES"), ("8", "c", "", "no")], "question_id string, image string, query string, label string")
    got = benchmarks.normalize_samples(df).orderBy("sample_id").collect()
    assert (got[0]["sample_id"], got[0]["question"], got[0]["label"]) == ("7", "Is it?", "yes")
    with pytest.raises(ValidationError):
        benchmarks.normalize_samples(df, strict=True)


def test_path_resolution(spark):
    files = spark.createDataFrame([("file:/r/a.jpg", "a.jpg"), ("file:/r/000000000042.jpg", "000000000042.jpg"), ("file:/z/b.jpg", "b.jpg")], "path string, name string")
    rows = spark.createDataFrame([(1, "/r/a.jpg", 1), (2, "a.jpg", 2), (3, "", 42), (4, "old/b.jpg", 4), (5, "none.jpg", 5)], "k int, raw string, n int")
    got = {r["k"]: r["resolved"] for r in readers.resolve_paths(rows, files, "k", "raw", ["/r"], "n").collect()}
    assert got == {1: "/r/a.jpg", 2: "/r/a.jpg", 3: "/r/000000000042.jpg", 4: "/z/b.jpg", 5: None}


def test_relation_layouts(spark):
    flat = spark.createDataFrame([("1", "dog", "on", "mat")], "image_id string, subj string, rel string, to string")
    assert [tuple(r) for r in records.flatten_relations(flat=flat).collect()] == [("1", "dog", "on", "mat")]


def test_streams_equal_the_batch_and_do_not_repeat(spark):
    base = fresh_path(spark, "t")
    rows = spark.createDataFrame([(f"i{k % 4}", k) for k in range(12)], "image_id string, v int")
    for part in ("image_id < 'i2'", "image_id >= 'i2'", "image_id = 'i0'"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run = lambda: incremental.incremental_facts(incremental.file_stream(spark, f"{base}/in", rows.schema, files_per_trigger=1), lambda b: b.groupBy("image_id").agg(F.sum("v").alias("s")), f"{base}/out", f"{base}/seen", f"{base}/state")
    run()
    run()
    got = sorted((r["image_id"], r["s"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted((r["image_id"], r["s"]) for r in rows.groupBy("image_id").agg(F.sum("v").alias("s")).collect())


def test_documents_lie_compressed_in_one_folder(spark):
    import os

    from pyspark.sql import functions as F

    from pairloom.plans.q_sources import documents_of
    from pairloom.session import fresh_path

    path = fresh_path(spark, "docs")
    documents_of(spark.range(40).repartition(3), F.col("id") % 7, F.to_json(F.collect_list("id")), path)
    files = [f for f in os.listdir(path.removeprefix("file:")) if not f.startswith((".", "_"))]
    assert len(files) == 7 and all(f.endswith(".gz") for f in files)
    read = spark.read.option("wholetext", True).text(path)
    assert sorted(i for r in read.collect() for i in __import__("json").loads(r["value"])) == list(range(40))


def test_edges_of_a_scene_need_no_join_with_themselves(spark, sf_dir):
    from pyspark.sql import functions as F

    from pairloom.plans.bind import Tables

    t = Tables(spark, sf_dir)
    first = t.sg.groupBy("image_id").agg(F.min("annotation_id").cast("string").alias("first_id"))
    want = t.sg.join(first, "image_id").select("image_id", "object_id", F.when(F.col("object_id") == F.col("first_id"), "nowhere").otherwise(F.col("first_id")))
    got = t.scenes.select("image_id", "object_id", "target_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert t.scenes._jdf.queryExecution().executedPlan().toString().count("lineitem") <= t.sg._jdf.queryExecution().executedPlan().toString().count("lineitem")
