"""Shares by image, tables of few row groups, and what is written or sorted on the way."""

import re

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import builders, facts, ordering, sampling
from pairloom.plans import bind
from pairloom.plans.bind import Tables
from pairloom.plans.catalog import QUERIES


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["D2_image_profiles", "H14_C13_captions", "P7_bundle"])
def test_shares_by_image_grow_with_the_lines_and_keep_the_rows(spark, sf_dir, monkeypatch, name):
    whole = rows_of(QUERIES[name](spark, sf_dir))
    monkeypatch.setattr(ordering, "SHARE_ROWS", 500)
    t = Tables(spark, sf_dir)
    assert t.by_image(t.ann).rdd.getNumPartitions() == -(-t.line_count // 500) > 4
    assert rows_of(QUERIES[name](spark, sf_dir)) == whole


def test_few_rows_are_not_dealt(spark):
    df = spark.range(10)
    assert ordering.dealt(df, 10, "id") is df


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() > 4 and table.select(F.spark_partition_id()).distinct().count() == 1
        out = bind.spread(table)
        assert out.select(F.spark_partition_id()).distinct().count() == 4 and out.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_cleaning_by_ranges_is_cleaning_by_negation(spark):
    chars = [chr(c) for c in (*range(1, 0x300), 0x2003, 0x3000, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    texts = [f"a{c}{c}b c_{c}-9 " for c in chars]
    d = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(F.lower("t").alias("low"), text.clean(d, "phrase").alias("p"), text.clean(d, "text").alias("t"), text.clean(d, "query").alias("q")).collect()
    for r in got:
        low, space = r["low"], r"[ \t\n\x0B\f\r]"
        phrase = re.sub(space + "+", " ", re.sub(r"[^a-z0-9\- \t\n\x0B\f\r]+", "", low.replace("_", " "))).strip(" ")
        assert (r["p"], r["t"], r["q"]) == (phrase, re.sub(r"[^a-z0-9\-]+", " ", low).strip(" "), re.sub("[^a-z0-9]+", " ", low).strip(" "))
    assert "[^" not in text.NO_WORD + text.NO_WORD_OR_HYPHEN + text.NO_WORD_HYPHEN_OR_SPACE


def test_candidates_of_the_selection_have_no_texts(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(builders, "capped_selection", lambda pairs, *_: seen.setdefault("pairs", pairs))
    QUERIES["E3_capped_selection"](spark, sf_dir)
    assert "fact" not in seen["pairs"].columns and not any("lineitem" in f for f in seen["pairs"].inputFiles())


def test_first_rows_of_an_answer_are_taken_without_sorting_all(spark, capsys):
    df = spark.createDataFrame([(str(i), f"n{i % 7}", i) for i in range(200)], "image_id string, name string, k int")
    made = builders.row(row_id=builders.say("r_", F.col("image_id"), "_", F.col("name")), image_id=F.col("image_id"), answer=F.lit("yes"), subject=F.col("name"))
    few = builders._first_by_answer({"yes": (df, made)}, {"yes": 9}, 3)
    want = [r["row_id"] for r in df.select(builders.say("r_", F.col("image_id"), "_", F.col("name")).alias("row_id"), "image_id").orderBy(ordering.seeded_key(3, "image_id", "row_id")).limit(9).collect()]
    assert sorted(r["row_id"] for r in few.collect()) == sorted(want)
    few.explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
    monkey = builders.SMALL_SAMPLE
    try:
        builders.SMALL_SAMPLE = 0
        assert rows_of(builders._first_by_answer({"yes": (df, made)}, {"yes": 9}, 3)) == rows_of(few)
    finally:
        builders.SMALL_SAMPLE = monkey


@pytest.mark.parametrize("name", ["P5_spatial_rows", "P9_strategy_pairs"])
def test_items_are_read_once_and_written(spark, sf_dir, name):
    assert not any("lineitem" in f for f in QUERIES[name](spark, sf_dir).inputFiles())


def test_representatives_keep_one_of_equal_rows_and_no_null_keys(spark):
    box = (0.0, 0.0, 4.0, 4.0)
    rows = [("1", 1, "a", box), ("1", 1, "a", box), ("1", 2, "b", box), ("1", 3, None, box), (None, 4, "a", box), ("2", 5, "a", None), ("2", 6, "a", box)]
    df = spark.createDataFrame(rows, "image_id string, annotation_id long, category string, box struct<x:double,y:double,w:double,h:double>")
    got = {(r["image_id"], r["annotation_id"], r["n"]) for r in facts.representatives(df).collect()}
    assert got == {("1", 1, 2), ("1", 2, 1), ("2", 5, 2)}


def test_the_selection_writes_no_more_of_equal_candidates_than_it_can_take(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sampling, "pinned", lambda df: written.append(df.localCheckpoint()) or written[-1])
    rows = [(i, "s", "hot" if i % 3 else None, f"b{i % 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, subtype string, a string, b string")
    out = sampling.capped_selection(df, ["subtype"], {"a": 7, "b": 11}, 40, 5, ["id"])
    assert 0 < out.count() <= 22
    assert written[0].count() == 2 * 7 + 2 * 11


def test_boxes_meet_once_for_both_axes(spark, sf_dir, monkeypatch):
    sg = bind.Tables(spark, sf_dir).sg
    apart = builders.clean_box_pairs(sg, "horizontal").unionByName(builders.clean_box_pairs(sg, "vertical"))
    met = []
    paired = facts.paired
    monkeypatch.setattr(facts, "paired", lambda *a, **k: met.append(1) or paired(*a, **k))
    assert rows_of(builders.clean_box_pairs(sg, *builders.BOX_SUBTYPES)) == rows_of(apart)
    builders.clean_pairs(sg, bind.Tables(spark, sf_dir).edges)
    assert len(met) == 2


def test_contacts_are_found_among_all_edges(spark):
    rows = [("1", "a", "man"), ("1", "b", "bag"), ("1", "c", "dog"), ("1", "d", "chair"), ("1", "e", "cup"), ("2", "a", "man"), ("2", "a", "man")]
    objs = spark.createDataFrame(rows, "image_id string, object_id string, name string")
    edges = [("1", "a", "holding", "b"), ("1", "c", "sitting on", "d"), ("1", "a", "near", "b"), ("1", "e", "holding", "b"), ("1", "a", "holding", "zz"), ("2", "a", "holding", "a"), ("1", "a", None, "b")]
    pairs, dangling = builders.clean_contact_pairs(objs, spark.createDataFrame(edges, "image_id string, subject_id string, relation string, target_id string"))
    assert sorted(r["pair_id"] for r in pairs.collect()) == ["rel_holding_wearing_clean_1_a_b_holding", "rel_sitting_riding_clean_1_c_d_sitting_on"]
    assert dangling.first()[0] == 1


def test_phrases_are_cleaned_texts_whether_clean_already_or_not(spark):
    texts = ["", " ", "a", "a b", "a  b", " a b", "a b ", "a b\n", "a\tb", "A b", "a_b", "a-b c", "-", "a.b", "é a", "a b", "red metal 42", "\n", None, "a\x0bb", "ab "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.phrase(F.col("t")).alias("a"), text.clean(F.col("t"), "phrase").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


@pytest.mark.parametrize("name", ["P8_scene_questions", "P11_caption_rows"])
def test_questions_deal_and_write_no_boxes_and_find_a_bucket_once_a_relation(spark, sf_dir, monkeypatch, name):
    from pairloom.plans import q_builders

    written, judged = [], []
    pinned = q_builders.pinned
    monkeypatch.setattr(q_builders, "pinned", lambda df: written.append(df.columns) or pinned(df))
    once = facts.once
    monkeypatch.setattr(facts, "once", lambda df, value, name: judged.append((name, df.columns)) or once(df, value, name))
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert written[0] == ["image_id", "object_id", "name", "attributes", "relation", "target_id"]
    assert ("bucket", ["relation"]) in judged
