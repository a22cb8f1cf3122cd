from collections import Counter

from pyspark.sql import functions as F

from pairloom.operators import builders, joins, profile
from pairloom.plans.bind import Tables

SG = "image_id string, object_id string, name string, attributes array<string>, box struct<x:double,y:double,w:double,h:double>, width double, height double"


def scene(spark):
    box = (1.0, 1.0, 2.0, 2.0)
    objs = [("1", "a", "man", ["standing", "red"], (0.0, 0.0, 10.0, 10.0), 100.0, 100.0), ("1", "b", "chair", ["wood"], (80.0, 0.0, 10.0, 10.0), 100.0, 100.0), ("1", "c", "thing", [], box, 100.0, 100.0),
            ("2", "d", "chair", ["red"], box, 100.0, 100.0), ("2", "e", "chair", ["red"], box, 100.0, 100.0), ("3", "f", "chair", ["blue"], box, 100.0, 100.0)]
    edges = [("1", "a", "sitting", "b"), ("1", "b", "of", "a"), ("1", "a", "holding", "zz")]
    return spark.createDataFrame(objs, SG), spark.createDataFrame(edges, "image_id string, subject_id string, relation string, target_id string")


def test_clean_minimal_pairs(spark):
    objs, edges = scene(spark)
    rows = {r["pair_id"]: r for r in builders.clean_pairs(objs, edges).collect()}
    kinds = Counter(r["subtype"] for r in rows.values())
    assert kinds["attr_material_clean"] == 1 and kinds["attr_action_single_clean"] == 1 and kinds["rel_sitting_riding_clean"] == 1 and kinds["rel_left_right_clean"] == 2
    red = rows["attr_color_clean_2_d_red_blue"]
    assert red["true_question"] == "Is the chair red?" and red["false_key"] == '["attr_color_clean","chair","red","blue","blue"]'
    count = rows["attr_count_clean_2_chair_2_3"]
    assert count["fact"] == "There are two chairs in the image." and count["base_scene"] == "The image contains chairs."
    wood = next(r for r in rows.values() if r["subtype"] == "attr_material_clean")
    assert wood["fact"] == "The chair is made of wood." and wood["counterfact"] == "The chair is made of metal."
    assert builders.clean_contact_pairs(objs, edges)[1].first()[0] == 1
    flat = builders.flatten(builders.clean_count_pairs(objs)).collect()
    assert Counter(r["answer"] for r in flat) == {"yes": 3, "no": 3} or len({r["answer"] for r in flat}) == 2


def test_scene_questions_are_unique_and_clean(spark):
    objs, edges = scene(spark)
    kept, triples, skipped = builders.clean_scene(objs, edges)
    assert kept.count() == 5 and {r["reason"]: r["n"] for r in skipped.collect()} == {"bad_object_name": 1, "bad_relation": 1}
    rows = builders.scene_questions(objs, edges, {"yes": 50, "no": 50}, 1).collect()
    assert len({r["row_id"] for r in rows}) == len(rows)
    asked = Counter((r["image_id"], r["question"], r["answer"], r["trusted_text"]) for r in rows)
    assert max(asked.values()) == 1
    present = {(r["image_id"], r["subject"]) for r in rows if r["subtype"] == "cat_present"}
    absent = {(r["image_id"], r["subject"]) for r in rows if r["subtype"] == "cat_absent"}
    assert not present & absent


def test_selected_pairs_respect_shares(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chosen = builders.selected_pairs(builders.clean_pairs(t.sg, t.edges), 80).collect()
    by = Counter(r["subtype"] for r in chosen)
    assert max(by.values()) <= 40
    for c, share in (("b_object", 6), ("b_subject", 6), ("b_value", 12), ("b_predicate", 18)):
        used = Counter((r["subtype"], r[c]) for r in chosen if r[c] is not None)
        assert max(used.values()) <= share


def test_spatial_rows_come_in_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = builders.spatial_rows(t.ann.join(t.images.select("image_id", "width", "height"), "image_id"), 4).collect()
    per = Counter(r["image_id"] for r in rows)
    assert rows and all(n % 2 == 0 and n <= 4 for n in per.values())
    assert Counter(r["answer"] for r in rows)["yes"] * 2 == len(rows)


def test_captions_are_bounded_and_ordered(spark):
    rows = spark.createDataFrame([("1", "rel", 1, "B on A."), ("1", "cat", 2, "There is A"), ("1", "cat", 3, "There is A."), ("1", "attr", 4, "A is red.")], "image_id string, type string, o int, fact string")
    assert profile.captions(rows, "o", 2).first()["caption"] == "There is A. A is red. Additional annotated visual facts are present."
    assert profile.captions(rows, "o", 9).first()["caption"] == "There is A. A is red. B on A."
    cache = spark.createDataFrame([("1", "cached")], "image_id string, caption string")
    hit = joins.enriched(rows.select("image_id").distinct(), profile.captions(rows, "o"), cache).first()
    assert hit["caption"] == "cached" and hit["cache_hit"]


def test_hardness_rank(spark):
    present = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "c"]), ("3", ["a", "c"]), ("4", ["a"]), ("5", ["d"])], "image_id string, present array<string>")
    from pairloom.operators.sampling import negative_hardness

    negs = spark.createDataFrame([("r1", "4", "c"), ("r2", "4", "d")], "row_id string, image_id string, negative string")
    got = {r["row_id"]: (r["rank"], r["count"]) for r in negative_hardness(negs, present.withColumn("present", F.sort_array("present"))).collect()}
    assert got == {"r1": (1, 2), "r2": (3, 0)}
