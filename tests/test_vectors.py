import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import vectors as v
from pairloom.operators import decompose, sets, vectors

ACT = "pair_no int, subtype string, branch string, layer int, head int, vec array<double>"


def planted(spark, n=10):
    """Ten pairs, two layers, three heads; head (0, 1) separates the branches by far the best."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        for b, sign in (("pos", 1.0), ("neg", -1.0)):
            for layer in range(2):
                for head in range(3):
                    x = rng.normal(0, 1.0, 4)
                    x[0] += 2 * sign
                    if (layer, head) == (0, 1):
                        x[1] += 40 * sign
                    rows.append((i, "cat" if i < n // 2 else "cnt", b, layer, head, x.tolist()))
    return spark.createDataFrame(rows, ACT)


def test_scalar_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(v.norm(v.normalize(F.col("a"))).alias("one"), v.normalize(F.col("z")).alias("z"), v.cosine(F.col("a"), F.col("z")).alias("c"), v.distance(F.col("a"), F.col("z")).alias("d")).first()
    assert r["one"] == pytest.approx(1.0) and r["z"] == [0.0, 0.0] and r["c"] == 0.0 and r["d"] == 5.0
    assert df.select(v.not_finite(F.array(F.lit(1.0), F.lit(float("nan"))))).first()[0]


def test_planted_head_ranks_first_and_prototypes_separate(spark):
    acts = planted(spark)
    protos = vectors.prototypes(acts)
    assert protos.filter("low").count() == protos.count()
    ranked = vectors.ranked_heads(vectors.head_scores(acts, protos), ["subtype"], 1).collect()
    assert {(r["layer"], r["head"]) for r in ranked} == {(0, 1)}
    scores = vectors.row_scores(acts, protos, ["pair_no", "subtype"])
    real = {r["subtype"]: r for r in vectors.evaluation(scores, ["subtype"], "pair_no").collect()}
    assert all(r["pairwise_acc"] >= 0.99 and r["auroc"] == 1.0 for r in real.values())
    mixed = vectors.prototypes(vectors.shuffled_labels(acts, "pair_no", 1))
    control = vectors.evaluation(vectors.row_scores(acts, mixed, ["pair_no", "subtype"]), ["subtype"], "pair_no").collect()
    assert min(r["pairwise_acc"] for r in control) < 1.0


def test_frozen_thresholds_are_used(spark):
    acts = planted(spark)
    scores = vectors.row_scores(acts, vectors.prototypes(acts), ["pair_no", "subtype"])
    given = spark.createDataFrame([("cat", 5.0), ("cnt", 5.0)], "subtype string, threshold double")
    out = vectors.evaluation(scores, ["subtype"], "pair_no", given).collect()
    assert {r["threshold"] for r in out} == {5.0} and {r["accuracy"] for r in out} == {0.5}


def test_directions_by_type(spark):
    rows = [(i, s, "pos", 0, 0, [float(x)] * 4) for i, (s, x) in enumerate([("cat", 1), ("cat", 1), ("cnt", 2), ("col", 2), ("cnt", 2), ("rel", 3)])]
    rows += [(i, s, "neg", 0, 0, [0.0] * 4) for i, s, *_ in rows]
    kind = vectors.name_map(F.col("subtype"), {"cat": "cat", "cnt": "attr", "col": "attr", "rel": "rel"})
    deltas = vectors.pair_deltas(spark.createDataFrame(rows, ACT), ["pair_no", "subtype"])
    got = {r["name"]: (r["n"], r["vec"][0]) for r in vectors.directions(deltas, kind).collect()}
    assert got == {"cat": (2, 1.0), "attr": (3, 2.0), "rel": (1, 3.0)}
    assert {r["n"] for r in vectors.directions(deltas, kind, cap=1).collect()} == {1}


def random_deltas(spark, n=30, layers=2, heads=2, dim=3):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (n, layers * heads * dim)) + np.arange(layers * heads * dim) * 0.3
    names = ["cat", "attr", "rel"]
    rows = [(i, names[i % 3], p // heads, p % heads, x[i, p * dim : (p + 1) * dim].tolist()) for i in range(n) for p in range(layers * heads)]
    return x, spark.createDataFrame(rows, "pair_no int, subtype string, layer int, head int, vec array<double>")


def flat(df, name=None):
    rows = sorted((r["layer"], r["head"], r["vec"]) for r in df.collect() if name is None or r["name"] == name)
    return np.concatenate([r[2] for r in rows])


def test_denoised_mean_equals_numpy(spark):
    x, deltas = random_deltas(spark)
    got, energy = decompose.denoised(deltas, "pair_no", 2, 3, 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(unit, full_matrices=False)
    assert np.allclose(flat(got), vt[:2].T @ (vt[:2] @ unit.mean(0)), atol=1e-6)
    assert np.allclose(energy, (s[:2] ** 2) / (unit**2).sum(), atol=1e-6)


def test_shared_private_equals_numpy(spark):
    x, deltas = random_deltas(spark)
    raw = np.stack([x[i::3].mean(0) for i in range(3)])
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(raw, full_matrices=False)
    parts = decompose.shared_private(deltas, "subtype", "pair_no", "type_mean_svd", 1)
    for i, name in enumerate(["cat", "attr", "rel"]):
        rest = raw[i] - vt[0] * (vt[0] @ raw[i])
        assert np.allclose(flat(parts["residual"], name), rest / np.linalg.norm(rest), atol=1e-6)
    shared = flat(parts["subspace"])
    assert abs(shared @ vt[0]) == pytest.approx(1.0) and shared @ raw.mean(0) > 0


def test_projection_is_gone(spark):
    x, deltas = random_deltas(spark)
    bank = vectors.directions(deltas, F.col("subtype"))
    basis = deltas.filter("pair_no = 0").select("layer", "head", "vec")
    clean, stats = vectors.remove_projection(bank, basis)
    for name in ("cat", "attr", "rel"):
        assert abs(flat(clean, name) @ x[0]) < 1e-8
    assert all(abs(r["clean_cosine"]) < 1e-8 for r in stats.collect())


def test_mixtures(spark):
    x, deltas = random_deltas(spark)
    a, b = (deltas.filter(f"pair_no = {i}") for i in (0, 1))
    na, nb = np.linalg.norm(x[0]), np.linalg.norm(x[1])
    want = x[0] / na + x[1] / nb
    assert np.allclose(flat(vectors.mixed(a, b, "unit_mean", "unit_norm")), want / np.linalg.norm(want), atol=1e-8)
    combo = 2 * x[0] / na + x[1] / nb
    assert np.allclose(flat(vectors.composed(a, b, 2.0, 1.0)), combo / np.linalg.norm(combo) * (na + nb) / 2, atol=1e-8)


def test_empty_types_become_zero_vectors(spark):
    _, deltas = random_deltas(spark)
    bank = vectors.directions(deltas.filter("subtype = 'cat'"), F.col("subtype"))
    full = vectors.with_empty(bank, ["cat", "rel"], 3)
    assert flat(full, "rel").tolist() == [0.0] * 12


def test_overlap_of_a_set_with_itself(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "name string, item int")
    got = {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in sets.overlap(df, "name", ["item"]).collect()}
    assert got[("a", "a")] == (2, 1.0) and got[("a", "b")] == (1, pytest.approx(1 / 3)) and got[("a", "c")] == (0, 0.0) and len(got) == 9


def test_ranking_keeps_all_heads(spark):
    heads = spark.createDataFrame([("t", layer, head, float((layer * 37 + head * 11) % 101)) for layer in range(32) for head in range(32)], "subtype string, layer int, head int, score double")
    ranks = [r["rank"] for r in vectors.ranked_heads(heads, ["subtype"], None).collect()]
    assert sorted(ranks) == list(range(1, 1025))


def test_modes_keep_all_values(spark):
    from pairloom.operators import profile

    df = spark.createDataFrame([("k", f"v{i}") for i in range(1500)] + [("k", "v7")], "given string, value string")
    rows = profile.conditional_modes(df, "given", "value").collect()
    assert len(rows) == 1500 and {r["value"]: r["rank"] for r in rows}["v7"] == 1


def test_denoised_mean_of_every_subtype(spark, sf_dir):
    from pairloom.plans.bind import Tables
    from pairloom.plans.q_vectors import g18

    t = Tables(spark, sf_dir)
    got = {r["subtype"] for r in g18(t).select("subtype").distinct().collect()}
    assert got == {r["subtype"] for r in t.delta.select("subtype").distinct().collect()} and len(got) == 4
