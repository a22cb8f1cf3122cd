import pytest
from pyspark.sql import functions as F

from pairloom.functions import text


def values(spark, make, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_plurals(spark):
    assert values(spark, text.plural, "person", "chair", "motorcycle", "bus", "city", "key", "sheep") == ["people", "chairs", "motorcycles", "buses", "cities", "keys", "sheep"]
    assert values(spark, text.clean_singular, "people", "cities", "watches", "glass", "cars", "bus") == ["person", "city", "watch", "glass", "car", "bus"]
    assert values(spark, text.clean_plural, "people", "watch") == ["people", "watches"]


def test_rule_router(spark):
    got = values(spark, text.rule_route, "How many dogs are there?", "Is the cat left of the dog?", "Is there a dog?", "What color is it?", "Describe.")
    assert got == [["attr"], ["rel"], ["cat"], ["attr"], ["cat", "attr", "rel"]]
    assert values(spark, lambda c: text.rule_route(c, "force_rel", ("cat", "rel_left")), "x") == [["rel_left"]]
    with pytest.raises(ValueError):
        text.rule_route(F.col("x"), "magic")


def test_weighted_router(spark):
    rows = values(spark, text.router_weights, "Is there a dog?", "Is there a red dog on the left?", "Hm.")
    assert [[w["label"] for w in r] for r in rows] == [["cat"], ["attr_color", "rel_spatial"], ["unknown"]]
    assert rows[1][0]["weight"] == 0.5
    assert values(spark, lambda c: text.router_primary(text.router_weights(c)), "Is there a red dog on the left?") == ["rel_spatial"]


def test_label_modes(spark):
    inputs = ("Yes", " y ", "nothing", "0", "maybe", None)
    assert values(spark, lambda c: text.yes_no(c), *inputs) == ["yes", "yes", "no", "no", None, None]
    assert values(spark, lambda c: text.yes_no(c, "prefix_invalid"), *inputs) == ["yes", "invalid", "no", "invalid", "invalid", "invalid"]
    assert values(spark, lambda c: text.yes_no(c, "dotted", F.lit("cat_absent")), "maybe", "yes. it is", "yesterday") == ["no", "yes", "no"]


def test_answer_parsers(spark):
    answers = ("Yes, it is.", "I say no: yes", "nothing yes", "** NO", "éyes no", "")
    assert values(spark, lambda c: text.parse_answer(c, "earliest"), *answers) == ["yes", "no", "yes", "no", "no", "invalid"]
    assert values(spark, lambda c: text.parse_answer(c, "first_word"), *answers) == ["yes", "invalid", "invalid", "no", "invalid", "invalid"]
    assert values(spark, lambda c: text.parse_answer(c, "contains", F.lit("no")), *answers) == ["yes", "no", "no", "no", "no", "yes"]


def test_questions(spark):
    assert values(spark, text.object_of_question, "Is there a red dog in the image?", "Are there any cats?", "What is it?") == ["red dog", "cats", ""]
    rel = values(spark, text.relation_of_question, "Is the man to the left of the dog in the image?", "Is there direct contact between the cup and table?", "Huh?")
    assert [tuple(r) if r else None for r in rel] == [("man", "left_of", "dog"), ("cup", "direct_contact", "table"), None]
    assert values(spark, text.image_id_of_path, "a/COCO_val_000123.jpg", "x/y.z.png") == ["000123", "y.z"]


def test_entities_and_relations(spark):
    assert values(spark, lambda c: text.clean(c, "entity"), " The  red-dog! ", "an  Owl", "thea") == ["red-dog", "owl", "thea"]
    assert values(spark, text.comparable_entity, "the Berries", "a class", "dogs") == ["berry", "class", "dog"]
    assert values(spark, lambda c: text.relation_key(c, "record"), "To the LEFT of", "jumping over", "on top of") == ["left_of", "jumping_over", "above"]


def test_run_names(spark):
    got = values(spark, text.vector_and_alpha, "a__plus__b_alpham0p5", "baseline", "other")
    assert [tuple(r) for r in got] == [("a+b", -0.5), ("", None), ("other", None)]
    assert values(spark, text.expert_of_run, "run_attr_res_alpha1", "x-rel", "none") == ["attr_res", "rel", ""]


def test_prompts_and_risks(spark):
    assert values(spark, text.question_risks, "Is it not yes") == [["question_contains_yes_or_no", "not_question_mark_terminated", "negation_word"]]
    assert values(spark, lambda c: text.strip_answer_prefix(c), "Yes. A dog.", "No way.") == ["A dog.", "No way."]
    assert values(spark, lambda c: text.no_object_sentence(F.split(c, ",")), "a", "a,b,c") == ["There is no a in the image.", "There is no a, b, or c in the image."]
