import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import geometry as geo
from pairloom.operators import facts

BOX = "box struct<x:double,y:double,w:double,h:double>"


def annotations(spark, rows):
    return spark.createDataFrame(rows, f"image_id string, annotation_id bigint, category string, {BOX}, crowd boolean, color string")


def images(spark, ids, side=100.0):
    return spark.createDataFrame([(i, side, side) for i in ids], "image_id string, width double, height double")


def test_relations_of_three_boxes(spark):
    rows = [("1", 1, "cat", (10.0, 10.0, 10.0, 10.0), False, None), ("1", 2, "dog", (35.0, 10.0, 10.0, 10.0), False, None), ("1", 3, "ball", (10.0, 35.0, 10.0, 10.0), False, None)]
    objs = facts.objects(images(spark, ["1"]), annotations(spark, rows))
    got = {(r["subject_category"], r["predicate"], r["object_category"]) for r in facts.relations(objs).collect()}
    assert {("cat", "left of", "dog"), ("cat", "above", "ball")} <= got


def test_counts_after_area_filter_and_facts(spark):
    rows = [
        ("101", 1, "cat", (10.0, 20.0, 20.0, 20.0), False, "red"), ("101", 2, "cat", (35.0, 20.0, 20.0, 20.0), False, None), ("101", 3, "dog", (70.0, 20.0, 20.0, 20.0), False, None),
        ("101", 4, "dog", (1.0, 1.0, 2.0, 2.0), False, None), ("102", 5, "cat", (45.0, 10.0, 20.0, 20.0), False, None),
    ]
    objs = facts.objects(images(spark, ["101", "102"]), annotations(spark, rows))
    out = facts.atomic_facts(objs, facts.category_counts(objs), facts.numbered_relations(objs))
    got = {r["fact_id"]: r for r in out.collect()}
    assert got["coco_101_cnt_cat"]["positive_int"] == 2
    assert "coco_101_cat_4" not in got and got["coco_101_col_2"]["positive_value"] is None
    assert {f"coco_101_rel_{i}" for i in range(1, 4)} == {k for k in got if "_rel_" in k}


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("block", [3, 10_000])
def test_pairs_of_a_hot_image_equal_brute_force(spark, monkeypatch, ordered, block):
    monkeypatch.setattr(facts, "BLOCK", block)
    rng = random.Random(3)
    rows = [("hot" if i < 40 else f"i{i % 5}", i, rng.choice("ab"), (float(rng.randrange(90)), float(rng.randrange(90)), 10.0, 10.0), False, None) for i in range(60)]
    df = annotations(spark, rows)
    rule = lambda a, b: geo.relation_by_offset(a["box"], b["box"], 20.0).isNotNull()
    got = sorted((r[0], r[1], r[2]) for r in facts.paired(df, rule, ["box"], ordered).select("image_id", "a.annotation_id", "b.annotation_id").collect())

    def related(p, q):
        dx, dy = abs(p[3][0] - q[3][0]), abs(p[3][1] - q[3][1])
        return (dx >= 20 and dx >= dy * 1.5) or (dy >= 20 and dy >= dx * 1.5)

    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and (p[1] != q[1] if ordered else p[1] < q[1]) and related(p, q))
    assert got == want


def test_numbering_is_the_same_for_a_hot_image(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("1" if i < 25 else "2", i, rng.choice("abc"), (float(rng.randrange(90)), float(rng.randrange(90)), 8.0, 8.0), False, None) for i in range(40)]
    objs = facts.objects(images(spark, ["1", "2"]), annotations(spark, rows), 0.0)
    read = lambda: {(r["image_id"], r["subject_ann"], r["object_ann"]): r["rel_index"] for r in facts.numbered_relations(objs).collect()}
    plain = read()
    monkeypatch.setattr(facts, "BLOCK", 4)
    assert read() == plain and plain


def test_representatives_prefer_unique_instances(spark):
    rows = [("1", 1, "a", (0.0, 0.0, 5.0, 5.0), False, None), ("1", 2, "b", (0.0, 0.0, 6.0, 5.0), False, None), ("1", 3, "c", (0.0, 0.0, 9.0, 9.0), False, None), ("1", 4, "c", (0.0, 0.0, 3.0, 3.0), False, None),
            ("2", 5, "c", (0.0, 0.0, 3.0, 3.0), False, None), ("2", 6, "c", (0.0, 0.0, 9.0, 9.0), False, None), ("2", 7, "a", (0.0, 0.0, 3.0, 3.0), False, None)]
    got = {(r["image_id"], r["annotation_id"]) for r in facts.representatives(annotations(spark, rows)).collect()}
    assert got == {("1", 1), ("1", 2), ("2", 6), ("2", 7)}


def test_segment_choice_and_colors(spark):
    anns = spark.createDataFrame([("1", 1, 7, (0.0, 0.0, 10.0, 10.0), 100.0, None), ("1", 2, 7, (0.0, 0.0, 10.0, 10.0), 100.0, 22)], f"image_id string, annotation_id bigint, category int, {BOX}, area double, segment_id bigint")
    segs = spark.createDataFrame([("1", 7, 11, (1.0, 1.0, 10.0, 10.0), 100.0, 0), ("1", 7, 22, (50.0, 50.0, 10.0, 10.0), 100.0, 1)], f"image_id string, category int, segment_id bigint, {BOX}, area double, pos int")
    got = {r["annotation_id"]: r["segment_id"] for r in facts.best_segment(anns, segs).collect()}
    assert got == {1: 11, 2: 22}
    px = spark.createDataFrame([("1", i, 250, 10, 10) for i in range(4)] + [("2", i, 9, 9, 9) for i in range(3)], "image_id string, pos int, r int, g int, b int")
    mask = spark.createDataFrame([("1", i, 5) for i in range(4)] + [("2", i, 6) for i in range(2)], "image_id string, pos int, segment_id int")
    assert {(r["image_id"], r["segment_id"], r["color"]) for r in facts.segment_colors(px, mask).collect()} == {("1", 5, "red")}


def test_segment_id_round_trip(spark):
    row = spark.range(70_000, 70_001).select(geo.segment_to_rgb(F.col("id")).alias("c"), "id").select(geo.rgb_to_segment(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"), "id").first()
    assert row["back"] == row["id"]
