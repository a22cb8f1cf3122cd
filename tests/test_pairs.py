import random
from collections import Counter

from pyspark.sql import functions as F

from pairloom.functions import fixed
from pairloom.operators import banks, pairs
from pairloom.plans.bind import Tables

FACT = (
    "fact_id string, image_id string, subtype string, subject_id string, subject_category string, object_id string, object_category string, positive_value string, positive_int int, "
    "annotation_id bigint, area_ratio double"
)


def fact(i, image, subtype, subject, obj=None, value=None, n=None):
    return (f"coco_{image}_{subtype}_{i}", image, subtype, None, subject, None, obj, value, n, i, 0.5)


def test_drop_reasons(spark):
    facts = spark.createDataFrame([
        fact(1, "1", "cat", "cat", value="cat"), fact(2, "1", "cat", "dog", value="dog"), fact(3, "1", "col", "dog", value=None), fact(4, "1", "cnt", "cat", value="9", n=9),
        fact(5, "1", "rel", "dog", "dog", "above"), fact(6, "1", "rel", "dog", "cat", "above"), fact(7, "1", "rel", "dog", "cow", "above"), fact(8, "1", "cat", "elk", value="elk"),
    ], FACT)
    counts = spark.createDataFrame([("1", {"cat": 2, "dog": 1, "cow": 1, "elk": 1})], "image_id string, counts map<string,bigint>")
    bank = spark.createDataFrame([("cat", ["dog", "cow"]), ("dog", ["cat", "cow", "pig"])], "category string, candidates array<string>")
    got = {r["annotation_id"]: (r["drop_reason"], r["negative"]) for r in pairs.judged_facts(facts, counts, bank).collect()}
    assert got[1][0] == "ambiguous_cat_anchor" and got[2] == (None, "pig")
    assert got[3][0] == "missing_color" and got[4][0] == "count_out_of_range" and got[5][0] == "same_category_relation"
    assert got[6][0] == "ambiguous_rel_anchor" and got[7] == (None, "below") and got[8][0] == "no_valid_negative"


def test_first_admissible_falls_back_to_any_other(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"], "a")], "c array<string>, v array<string>, own string")
    assert df.select(banks.first_admissible(F.col("c"), F.col("v"), F.col("own"))).first()[0] == "b"


def test_cap_keeps_the_first_and_counts_the_rest(spark):
    facts = spark.createDataFrame([fact(i, "1", "cat", "x", value="x") for i in (1, 2, 3)], FACT)
    caps = {"cat": 1, "cnt": 1, "col": 1, "rel": 1}
    assert [r["fact_id"] for r in pairs.capped(facts, caps).collect()] == ["coco_1_cat_1"]
    assert [tuple(r) for r in pairs.capped_away(facts, caps).collect()] == [("cat", "capped_cat_per_image", 2)]


def test_balance_equals_the_sequential_loop(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["cat", "rel"]), rng.choice(["a", "b", "c", None]), rng.choice(["p", "q", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "fact_rank bigint, subtype string, anchor_label string, rel_pattern string")
    got = {r[0] for r in pairs.balanced(df, {"cat": 60, "rel": 40}, per_label=25, per_pattern=12).select("fact_rank").collect()}
    want = set()
    for subtype, target, cap in (("cat", 60, 25), ("rel", 40, 12)):
        used, kept = Counter(), 0
        for i, s, anchor, pattern in rows:
            key = (pattern if subtype == "rel" else anchor) or ""
            if s != subtype or kept >= target or (key and used[key] >= cap):
                continue
            used[key] += bool(key)
            want.add(i)
            kept += 1
    assert got == want


def test_rendered_answers_differ_in_the_target_only(spark, sf_dir):
    from pairloom.plans.q_pairs import stages

    s = stages(Tables(spark, sf_dir))
    rows = s["unbalanced"].filter("subtype <> 'cnt'").limit(300).collect()
    assert rows
    for r in rows:
        assert r["response_pos"] != r["response_neg"]
        assert r["response_pos"].replace(r["pos_label"], "_", 1) == r["response_neg"].replace(r["neg_label"], "_", 1) or r["subtype"] == "rel"
        assert "{" not in r["question"] + r["response_pos"] + r["response_neg"]
    kept = s["kept"].groupBy("image_id", "subtype").count()
    assert kept.filter("count > 6").count() == 0


def test_templates_are_valid_and_violations_are_found(spark):
    bank = banks.template_bank(spark)
    assert banks.template_violations(bank).count() == 0
    assert bank.groupBy("subtype").count().count() == len(fixed.TEMPLATE_SLOTS)
    bad = spark.createDataFrame([("cat", 0, "t", "web", "What {x}?", "It is."), ("cat", 1, "t", "template", "What?", "A {label}.")], bank.schema)
    rules = Counter(r["rule"] for r in banks.template_violations(bad).collect())
    assert rules == {"text_source": 1, "illegal_placeholders": 1, "missing_placeholders": 1, "target_slot": 1, "duplicate_id": 1}
    old = spark.createDataFrame([("cnt", 0, "t", "template", "How many {obj_pl}?", "There are {count} {obj_pl} in the scene.")], bank.schema)
    assert banks.upgrade_templates(old).first()["r_template"] == "The scene contains {count} {obj_count}."


def test_candidate_pool_order(spark):
    vocab = spark.createDataFrame([("a", "g1", "s1", 0), ("b", "g2", "s1", 1), ("c", "g1", "s1", 2), ("d", "g3", "s2", 3), ("e", "g4", "s3", 4)], "category string, semantic_group string, supercategory string, pos int")
    seeds = spark.createDataFrame([("a", "e", 0)], "category string, candidate string, pos int")
    far = spark.createDataFrame([("g1", "g3", 0)], "semantic_group string, other_group string, pos int")
    rows = banks.candidate_pool(vocab, 10, seeds, far).filter("category = 'a'").orderBy("pos").collect()
    assert [r["candidate"] for r in rows] == ["e", "c", "b", "d"]


def test_stages_write_once_what_the_caps_leave(spark, sf_dir, monkeypatch):
    """Judged and rendered facts are not written for who reads them once, and what is written has the columns of a pair."""
    from pairloom.plans.q_pairs import stages

    wrote = []
    own = pairs.pinned
    monkeypatch.setattr(pairs, "pinned", lambda df: wrote.append(df.columns) or own(df))
    s = stages(Tables(spark, sf_dir))
    facts_written = [c for c in wrote if "fact_id" in c]
    assert facts_written == [[*pairs.FACT, "negative"]]
    whole = stages(Tables(spark, sf_dir), written=True)
    for name in ("judged", "unbalanced"):
        assert s[name].exceptAll(whole[name]).count() == 0 and whole[name].exceptAll(s[name]).count() == 0
