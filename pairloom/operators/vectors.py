"""Vector tables: prototypes, directions, separation scores, projections and overlaps.

Long layout: ``acts(pair, subtype, branch, layer, head, vec)`` and ``bank(name, layer, head, vec)``. Layer and
head are keys, so joins and group means spread over heads as well as over pairs; only the items of one head are
an array. Scalars over a whole vector are sums over its heads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import vectors as v
from pairloom.operators.ordering import global_rank, seeded_flip, seeded_key, top_k
from pairloom.session import pinned

HEAD = ["layer", "head"]


def unfold_heads(df: DataFrame, payload: str, heads: int, dim: int) -> DataFrame:
    """A flat payload of layers x heads x dim as one row per head."""
    place = F.explode(F.sequence(F.lit(0), F.floor(F.size(payload) / dim).cast("int") - 1))
    rest = [c for c in df.columns if c != payload]
    return df.withColumn("_k", place).select(
        *rest, F.floor(F.col("_k") / heads).cast("int").alias("layer"), (F.col("_k") % heads).alias("head"),
        F.slice(F.col(payload), F.col("_k") * dim + 1, dim).cast("array<double>").alias("vec"),
    )


def unfold_nested(df: DataFrame, payload: str) -> DataFrame:
    """A nested [layer][head][dim] payload as one row per head."""
    rest = [c for c in df.columns if c != payload]
    layers = df.select(*rest, F.posexplode(payload).alias("layer", "_heads"))
    return layers.select(*rest, "layer", F.posexplode("_heads").alias("head", "vec"))


def pair_deltas(acts: DataFrame, keys: Sequence[str], positive: str = "pos", negative: str = "neg") -> DataFrame:
    """Positive minus negative branch per pair and head."""

    def side(name: str) -> Column:
        return F.first(F.when(F.col("branch") == name, F.col("vec")), ignorenulls=True)

    both = acts.groupBy(*keys, *HEAD).agg(side(positive).alias("_a"), side(negative).alias("_b"))
    return both.filter("_a is not null and _b is not null").select(*keys, *HEAD, v.sub(F.col("_a"), F.col("_b")).alias("vec"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per group, combined before the shuffle; ``n`` is the group size."""
    asv = array_to_vector(F.col(vec).cast("array<double>"))
    agg = df.groupBy(*keys).agg(Summarizer.mean(asv).alias("_m"), F.count("*").alias("n"))
    return agg.select(*keys, vector_to_array("_m").alias("vec"), "n")


def prototypes(acts: DataFrame, normalize_inputs: bool = True, low_count: int = 100) -> DataFrame:
    """Per (subtype, head): unit means of both branches and the unit contrast axis.

    ``normalize_inputs=False`` is the variant that averages the raw vectors. ``low`` marks small groups.
    """
    ready = acts.withColumn("vec", v.normalize(F.col("vec"))) if normalize_inputs else acts
    means = mean_vectors(ready, ["subtype", "branch", *HEAD])

    def side(name: str) -> Column:
        return F.first(F.when(F.col("branch") == name, F.col("_u")), ignorenulls=True)

    n = F.first(F.when(F.col("branch") == "pos", F.col("n")), ignorenulls=True)
    both = means.withColumn("_u", v.normalize(F.col("vec"))).groupBy("subtype", *HEAD).agg(side("pos").alias("mu_pos"), side("neg").alias("mu_neg"), n.alias("n"))
    return both.withColumns({"axis": v.normalize(v.sub(F.col("mu_pos"), F.col("mu_neg"))), "low": F.col("n") < low_count})


def shuffled_labels(acts: DataFrame, pair: str, seed: int = 42) -> DataFrame:
    """Control: swap the branches of about half of the pairs, decided per pair."""
    other = F.when(F.col("branch") == "pos", "neg").otherwise("pos")
    return acts.withColumn("branch", F.when(seeded_flip(seed, pair), other).otherwise(F.col("branch")))


def head_scores(acts: DataFrame, protos: DataFrame, mode: str = "cosine") -> DataFrame:
    """Separation score per (subtype, head).

    ``cosine``: sep = 1 - mu+ . mu-, dispersion = mean of 1 - z . mu. ``euclidean``: distances to the plain
    means of the unit vectors.
    """
    unit = acts.withColumn("vec", v.normalize(F.col("vec")))
    if mode == "euclidean":
        means = mean_vectors(unit, ["subtype", "branch", *HEAD])
        spread = unit.join(means.withColumnRenamed("vec", "mu").drop("n"), ["subtype", "branch", *HEAD])
        disp = spread.groupBy("subtype", *HEAD).agg(*_branch_mean(v.distance(F.col("vec"), F.col("mu"))))
        pos = means.filter("branch = 'pos'").withColumnRenamed("vec", "p").drop("branch", "n")
        neg = means.filter("branch = 'neg'").withColumnRenamed("vec", "q").drop("branch", "n")
        sep = pos.join(neg, ["subtype", *HEAD]).select("subtype", *HEAD, v.distance(F.col("p"), F.col("q")).alias("sep"))
        spread_sum = F.greatest(F.col("disp_pos") + F.col("disp_neg"), F.lit(1e-8))
        return disp.join(sep, ["subtype", *HEAD]).withColumn("score", F.col("sep") / spread_sum)
    joined = unit.join(protos.select("subtype", *HEAD, "mu_pos", "mu_neg"), ["subtype", *HEAD])
    own = F.when(F.col("branch") == "pos", v.dot(F.col("vec"), F.col("mu_pos"))).otherwise(v.dot(F.col("vec"), F.col("mu_neg")))
    disp = joined.groupBy("subtype", *HEAD).agg(*_branch_mean(1.0 - own), F.first(1.0 - v.dot(F.col("mu_pos"), F.col("mu_neg"))).alias("sep"))
    return disp.withColumn("score", F.col("sep") / (F.col("disp_pos") + F.col("disp_neg") + 1e-8))


def _branch_mean(value: Column) -> list[Column]:
    return [F.avg(F.when(F.col("branch") == b, value)).alias(f"disp_{b}") for b in ("pos", "neg")]


def ranked_heads(scores: DataFrame, keys: Sequence[str], k: int | None, by: Sequence[str] = ("score",)) -> DataFrame:
    """The k best heads of every group, all of them with None: ``by`` descending, then layer and head. Scores compare at 9 digits."""
    if k is None:
        named = {f"_by{i}": -F.round(c, 9) for i, c in enumerate(by)}
        return global_rank(pinned(scores.withColumns(named)), keys, [*named, "layer", "head"], "rank").drop(*named)
    return top_k(scores, keys, [*[-F.round(c, 9) for c in by], "layer", "head"], k)


def row_scores(acts: DataFrame, protos: DataFrame, keys: Sequence[str], score: str = "axis", mask: DataFrame | None = None, on: Sequence[str] = ("subtype", *HEAD)) -> DataFrame:
    """Mean similarity of each (row, branch) to its prototype over all or the masked heads.

    ``axis``: to the contrast axis. ``two_proto``: to mu+ minus to mu-.
    """
    unit = acts.withColumn("vec", v.normalize(F.col("vec")))
    joined = unit.join(protos, list(on))
    if mask is not None:
        joined = joined.join(mask, [c for c in mask.columns if c in joined.columns], "left_semi")
    z = F.col("vec")
    part = v.dot(z, F.col("axis")) if score == "axis" else v.dot(z, F.col("mu_pos")) - v.dot(z, F.col("mu_neg"))
    return joined.groupBy(*keys, "branch").agg(F.avg(part).alias("score"))


def paired_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of both branches side by side."""

    def side(name: str) -> Column:
        return F.max(F.when(F.col("branch") == name, F.col("score")))

    return scores.groupBy(*keys).agg(side("pos").alias("score_pos"), side("neg").alias("score_neg"))


def as_labels(scores: DataFrame) -> DataFrame:
    """Branch as a binary label, scores at 9 digits so that ties do not depend on summation order."""
    return scores.withColumns({"label": F.when(F.col("branch") == "pos", 1).otherwise(0), "score": F.round("score", 9)})


def evaluation(scores: DataFrame, keys: Sequence[str], pair: str, thresholds: DataFrame | None = None) -> DataFrame:
    """Pairwise accuracy, gap, AUROC, average precision, threshold and its accuracy per group.

    ``thresholds(*keys, threshold)`` freezes thresholds tuned elsewhere; otherwise they are tuned here.
    """
    from pairloom.operators import metrics, rankmetrics

    keys = list(keys)
    sides = metrics.candidate_summary(paired_scores(scores, [*keys, pair]), keys).select(*keys, "num_pairs", "pairwise_acc", F.col("mean_margin").alias("mean_gap"))
    labels = as_labels(scores)
    steps = rankmetrics.score_steps(labels, keys)
    tuned = thresholds if thresholds is not None else rankmetrics.best_threshold(steps, keys).select(*keys, "threshold")
    at = metrics.threshold_metrics(labels.join(tuned, keys), [*keys, "threshold"], F.col("threshold")).select(*keys, "threshold", "accuracy", "f1")
    return sides.join(rankmetrics.auroc(steps, keys), keys).join(rankmetrics.average_precision(steps, keys), keys).join(at, keys)


def prefix_scores(acts: DataFrame, protos: DataFrame, ranked: DataFrame, keys: Sequence[str], ks: Sequence[int], score: str = "axis") -> DataFrame:
    """(keys, branch, scores): the mean similarity over the k best heads for every k of ``ks`` at once, as one array a row.

    ``ranked(subtype, layer, head, rank)`` orders the heads. A head adds its share to every k from its rank on, so all k come from one
    scan of the vectors. Where there are fewer than k heads, their number divides.
    """
    from pairloom.operators.resampling import array_sum

    best = ranked.filter(F.col("rank") <= max(ks))
    sizes = best.groupBy("subtype").agg(F.count("*").alias("_heads"))
    chosen = pinned(protos.join(best.select("subtype", *HEAD, "rank"), ["subtype", *HEAD]).join(sizes, "subtype"))
    joined = acts.withColumn("vec", v.normalize(F.col("vec"))).join(chosen, ["subtype", *HEAD])
    z = F.col("vec")
    part = v.dot(z, F.col("axis")) if score == "axis" else v.dot(z, F.col("mu_pos")) - v.dot(z, F.col("mu_neg"))
    shares = [F.when(F.col("rank") <= k, F.col("_part") / F.least(F.lit(k), F.col("_heads"))).otherwise(0.0) for k in ks]
    return joined.withColumn("_part", part).groupBy(*keys, "branch").agg(array_sum(F.array(*shares)).alias("scores"))


def paired_prefixes(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prefix scores of both branches side by side; pairs that miss one are left out."""

    def side(name: str) -> Column:
        return F.first(F.when(F.col("branch") == name, F.col("scores")), ignorenulls=True)

    return scores.groupBy(*keys).agg(side("pos").alias("scores_pos"), side("neg").alias("scores_neg")).filter("scores_pos IS NOT NULL AND scores_neg IS NOT NULL")


def best_prefix(scores: DataFrame, keys: Sequence[str], pair: str, ks: Sequence[int]) -> DataFrame:
    """(keys, k, place, accuracies): the first k with the highest pairwise accuracy, and the accuracies of all."""
    wins = F.zip_with("scores_pos", "scores_neg", lambda p, n: F.when(F.round(p, 9) > F.round(n, 9), 1.0).otherwise(0.0))
    means = paired_prefixes(scores, [*keys, pair]).groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(wins))).alias("accuracies"))
    rounded = F.transform("accuracies", lambda a: F.round(a, 9))
    place = F.array_position(rounded, F.array_max(rounded)).cast("int")
    return means.select(*keys, F.get(F.array(*map(F.lit, ks)), place - 1).alias("k"), place.alias("place"), "accuracies")


def frozen_test(scores: DataFrame, keys: Sequence[str], pair: str, split: str, ks: Sequence[int], tune: str = "val", test: str = "test") -> DataFrame:
    """k and threshold chosen on ``tune``, applied unchanged to ``test``: :func:`evaluation` there, with k and its accuracy on ``tune``.

    ``scores`` are :func:`prefix_scores` with the split as a column. Groups that miss one of the splits are left out.
    """
    from pairloom.operators import rankmetrics

    keys = list(keys)
    tuning = scores.filter(F.col(split) == tune)
    chosen = pinned(best_prefix(tuning, keys, pair, ks).select(*keys, "k", "place", F.get("accuracies", F.col("place") - 1).alias("tuned_acc")))

    def at_k(rows: DataFrame) -> DataFrame:
        return rows.join(chosen.select(*keys, "place"), keys).select(*keys, pair, "branch", F.get("scores", F.col("place") - 1).alias("score"))

    steps = rankmetrics.score_steps(as_labels(at_k(tuning)), keys)
    frozen = pinned(rankmetrics.best_threshold(steps, keys).select(*keys, "threshold"))
    tested = pinned(at_k(scores.filter(F.col(split) == test)))
    return evaluation(tested, keys, pair, frozen).join(chosen.drop("place"), keys)


def macro_average(table: DataFrame, name: str, metrics: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``table`` with one row more, ``macro`` in column ``name``: plain averages of the metrics and sums over its rows, other columns null."""
    total = table.agg(*[F.avg(m).alias(m) for m in metrics], *[F.sum(s).alias(s) for s in sums])
    return table.unionByName(total.withColumn(name, F.lit("macro")), allowMissingColumns=True)


def directions(deltas: DataFrame, name: Column, cap: int = 0, pair: str = "pair_no", seed: int = 42, unit_heads: bool = False) -> DataFrame:
    """Mean difference vector per name; ``cap`` keeps that many pairs per name by seeded order."""
    named = deltas.withColumn("name", name).filter("name is not null")
    if cap:
        chosen = top_k(named.select("name", pair).distinct(), ["name"], [seeded_key(seed, pair), F.col(pair)], cap).drop("rank")
        named = named.join(chosen, ["name", pair], "left_semi")
    out = mean_vectors(named, ["name", *HEAD])
    return out.withColumn("vec", v.normalize(F.col("vec"))) if unit_heads else out


def with_empty(bank: DataFrame, names: Sequence[str], dim: int) -> DataFrame:
    """Add a zero vector for every name that has none."""
    heads = bank.select(*HEAD).distinct().withColumn("name", F.explode(F.array(*map(F.lit, names))))
    missing = heads.join(bank, ["name", *HEAD], "left_anti")
    zero = F.array_repeat(F.lit(0.0), dim)
    return bank.select("name", *HEAD, "vec").unionByName(missing.select("name", *HEAD, zero.alias("vec")))


def head_norms(bank: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    return bank.select(*keys, *HEAD, v.norm(F.col("vec")).alias("score"))


def norm_summary(bank: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Flat norm and mean, largest and smallest head norm per vector."""
    n = v.norm(F.col("vec"))
    return bank.groupBy(*keys).agg(F.sqrt(F.sum(v.sq_norm(F.col("vec")))).alias("flat_norm"), F.avg(n).alias("mean"), F.max(n).alias("max"), F.min(n).alias("min"))


def grouped_directions(rows: DataFrame, groups: Column) -> DataFrame:
    """Mean vector of every group key a row belongs to; ``groups`` is an ARRAY<STRING> of keys."""
    return mean_vectors(rows.withColumn("name", F.explode(groups)), ["name", *HEAD])


def relation_groups(relation: Column) -> Column:
    """Group keys of a relation: all, its own, and its axis."""
    own = {"left_of": "rel_left", "right_of": "rel_right", "above": "rel_above", "below": "rel_below"}
    single = F.when(F.lit(False), "")
    for key, name in own.items():
        single = single.when(relation == key, name)
    axis = F.when(relation.isin("left_of", "right_of"), "rel_horizontal").when(relation.isin("above", "below"), "rel_vertical")
    return F.array_compact(F.array(F.lit("rel_all"), single, axis))


def bucket_groups(bucket: Column) -> Column:
    """Group keys of a relation bucket: its own and the unions it belongs to."""
    plane, place = bucket.isin("horizontal", "vertical"), bucket.isin("horizontal", "vertical", "depth")
    return F.array_compact(F.array(
        F.when(F.coalesce(bucket, F.lit("")) != "", F.concat(F.lit("rel_"), bucket)), F.when(plane, "rel_position_2d"), F.when(place, "rel_position"),
        F.when(bucket.isin("contact", "interaction"), "rel_contact_interaction"),
    ))


def unit_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale every whole vector (all heads of the keys) to flat norm 1."""
    total = df.groupBy(*keys).agg(F.sqrt(F.sum(v.sq_norm(F.col("vec")))).alias("_n"))
    scaled = df.join(total, list(keys)).withColumn("vec", v.scale(F.col("vec"), F.when(F.col("_n") > v.EPS, 1.0 / F.col("_n")).otherwise(0.0)))
    return scaled.drop("_n")


def condition_balanced(deltas: DataFrame, keys: Sequence[str], condition: str, unit_conditions: bool = False) -> DataFrame:
    """Mean over conditions of the mean inside each condition, so a condition with very many rows weighs as one."""
    inner = mean_vectors(deltas, [*keys, condition, *HEAD]).drop("n")
    if unit_conditions:
        inner = unit_rows(inner, [*keys, condition])
    return mean_vectors(inner, [*keys, *HEAD])


def condition_sizes(rows: DataFrame, keys: Sequence[str], condition: str, pair: str) -> DataFrame:
    """Number of conditions and their smallest, mean and largest size."""
    sizes = rows.select(*keys, condition, pair).distinct().groupBy(*keys, condition).agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.count("*").alias("conditions"), F.min("n").alias("size_min"), F.avg("n").alias("size_mean"), F.max("n").alias("size_max")
    )


def energy(deltas: DataFrame, keys: Sequence[str], condition: str | None = None) -> DataFrame:
    """Root mean square of the head norm; with a condition, the mean over conditions of that."""
    sq = v.sq_norm(F.col("vec"))
    if condition is None:
        return deltas.groupBy(*keys, *HEAD).agg(F.sqrt(F.avg(sq)).alias("score"))
    inner = deltas.groupBy(*keys, condition, *HEAD).agg(F.sqrt(F.avg(sq)).alias("_e"))
    return inner.groupBy(*keys, *HEAD).agg(F.avg("_e").alias("score"))


def answer_direction(deltas: DataFrame, answer: str = "answer") -> DataFrame:
    """Mean of the yes rows minus mean of the no rows, per head."""
    means = mean_vectors(deltas.filter(F.col(answer).isin("yes", "no")), [answer, *HEAD])

    def side(name: str) -> Column:
        return F.first(F.when(F.col(answer) == name, F.col("vec")), ignorenulls=True)

    both = means.groupBy(*HEAD).agg(side("yes").alias("_y"), side("no").alias("_n"))
    return both.select(*HEAD, v.sub(F.col("_y"), F.col("_n")).alias("vec"))


def remove_projection(bank: DataFrame, basis: DataFrame, keys: Sequence[str] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """Vectors without their part along ``basis(layer, head, vec)``, and what that changed.

    The second table has raw and clean cosine with the basis and the norms of projection and rest over the raw norm.
    """
    keys = list(keys)
    joined = bank.select(*keys, *HEAD, "vec").join(basis.select(*HEAD, F.col("vec").alias("_b")), HEAD)
    sums = joined.groupBy(*keys).agg(
        F.sum(v.dot(F.col("vec"), F.col("_b"))).alias("vb"), F.sum(v.sq_norm(F.col("_b"))).alias("bb"), F.sum(v.sq_norm(F.col("vec"))).alias("vv")
    )
    factor = F.when(F.col("bb") > v.EPS**2, -F.col("vb") / F.col("bb")).otherwise(0.0)
    clean = joined.join(sums, keys).select(*keys, *HEAD, v.axpy(F.col("vec"), factor, F.col("_b")).alias("vec"))
    after = clean.join(basis.select(*HEAD, F.col("vec").alias("_b")), HEAD).groupBy(*keys).agg(
        F.sum(v.dot(F.col("vec"), F.col("_b"))).alias("cb"), F.sum(v.sq_norm(F.col("vec"))).alias("cc")
    )
    b, raw, rest = F.sqrt("bb"), F.sqrt("vv"), F.sqrt("cc")
    stats = sums.join(after, keys).select(
        *keys, v.ratio_or_zero(F.col("vb"), b * raw).alias("raw_cosine"), v.ratio_or_zero(F.col("cb"), b * rest).alias("clean_cosine"),
        v.ratio_or_zero(F.abs("vb"), b * raw).alias("projection_ratio"), v.ratio_or_zero(rest, raw).alias("rest_ratio"),
    )
    return clean, stats


def cosine_matrix(bank: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Flat cosine of every two vectors of a bank, optionally over masked heads only."""
    rows = bank.select("name", *HEAD, "vec")
    if mask is not None:
        rows = rows.join(mask.select(*HEAD).distinct(), HEAD, "left_semi")
    a, b = rows.withColumnsRenamed({"name": "a", "vec": "va"}), rows.withColumnsRenamed({"name": "b", "vec": "vb"})
    sums = a.join(b, HEAD).groupBy("a", "b").agg(
        F.sum(v.dot(F.col("va"), F.col("vb"))).alias("ab"), F.sum(v.sq_norm(F.col("va"))).alias("aa"), F.sum(v.sq_norm(F.col("vb"))).alias("bb")
    )
    return sums.select("a", "b", v.ratio_or_zero(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("cosine"))


def mean_of_others(bank: DataFrame) -> DataFrame:
    """For every name the mean vector of all other names, from one sum over names per head."""
    rows = bank.select("name", *HEAD, "vec")
    total = mean_vectors(rows, HEAD).withColumnsRenamed({"vec": "_mean", "n": "_n"})
    # (n * mean - own) / (n - 1)
    others = v.axpy(v.scale(F.col("_mean"), F.col("_n").cast("double")), F.lit(-1.0), F.col("vec"))
    return rows.join(total, HEAD).select("name", *HEAD, v.scale(others, F.when(F.col("_n") > 1, 1.0 / (F.col("_n") - 1)).otherwise(0.0)).alias("others"))


def contrast_families(bank: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """``(family, lambda, name, layer, head, vec)``: raw minus lambda times the mean of the others, plain and on unit heads."""
    unit = bank.select("name", *HEAD, v.normalize(F.col("vec")).alias("vec"))
    parts = []
    for family, rows in (("contrast", bank.select("name", *HEAD, "vec")), ("headnorm_contrast", unit)):
        joined = rows.join(mean_of_others(rows), ["name", *HEAD]).withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas))))
        parts.append(joined.select(F.lit(family).alias("family"), "lambda", "name", *HEAD, v.axpy(F.col("vec"), -F.col("lambda"), F.col("others")).alias("vec")))
    return parts[0].unionByName(parts[1])


def score_maps(bank: DataFrame, seed: int = 42) -> DataFrame:
    """Per (name, head): norm, specificity, contrast norm, gated ratio, hybrid, shared and random scores.

    A bank has few names, so the head-wise comparison of names is an aggregate per head, not a matter of scale.
    """
    from pairloom.operators.rankmetrics import exact_quantiles

    rows = bank.select("name", *HEAD, "vec").withColumn("norm", v.norm(F.col("vec")))
    a, b = rows, rows.select(F.col("name").alias("other"), *HEAD, F.col("vec").alias("ov"), F.col("norm").alias("on"))
    cos = v.dot(F.col("vec"), F.col("ov")) / F.greatest(F.col("norm") * F.col("on"), F.lit(1e-12))
    against = a.join(b, HEAD).filter("name <> other").groupBy("name", *HEAD).agg(F.max(cos).alias("max_cos"), F.avg("on").alias("other_norm"))
    flat = cosine_matrix(bank).filter("a <> b").groupBy(F.col("a").alias("name")).agg(F.avg("cosine").alias("flat_cos"))
    median = exact_quantiles(rows.select("name", "norm"), ["name"], "norm", [0.5])
    shared = rows.groupBy(*HEAD).agg(F.avg("norm").alias("shared"))
    joined = rows.join(against, ["name", *HEAD]).join(mean_of_others(bank), ["name", *HEAD]).join(flat, "name").join(median, "name").join(shared, HEAD)
    return joined.select(
        "name", *HEAD, "norm", (F.col("norm") * (1.0 - F.col("max_cos"))).alias("specificity"), v.norm(v.sub(F.col("vec"), F.col("others"))).alias("contrast_norm"),
        F.when(F.col("norm") >= F.col("q50"), F.col("norm") / F.greatest("other_norm", F.lit(1e-12))).otherwise(0.0).alias("ratio"),
        (F.col("norm") * F.greatest(F.col("flat_cos") - F.col("max_cos"), F.lit(0.0))).alias("hybrid"), "shared",
        seeded_key(seed, *HEAD).alias("random"),
    )


def mixed(left: DataFrame, right: DataFrame, mode: str = "raw_mean", target: str = "mean_source_norm") -> DataFrame:
    """Mixture of two vectors ``(layer, head, vec)``, rescaled to one of five flat norms."""
    joined = left.select(*HEAD, F.col("vec").alias("a")).join(right.select(*HEAD, F.col("vec").alias("b")), HEAD)
    sums = joined.agg(
        F.sqrt(F.sum(v.sq_norm(F.col("a")))).alias("na"), F.sqrt(F.sum(v.sq_norm(F.col("b")))).alias("nb"),
        F.sqrt(F.sum(v.sq_norm(v.add(F.col("a"), F.col("b"))))).alias("ns"), F.sum(v.dot(F.col("a"), F.col("b"))).alias("ab"),
    ).first()
    na, nb, total, ab = (float(sums[c] or 0.0) for c in ("na", "nb", "ns", "ab"))
    wanted = {"mean_source_norm": (na + nb) / 2, "left_norm": na, "right_norm": nb, "unit_norm": 1.0, "raw_mean_norm": total / 2}[target]
    ka, kb = (0.5, 0.5) if mode == "raw_mean" else (0.5 / max(na, 1e-12), 0.5 / max(nb, 1e-12))
    size = max(ka * ka * na * na + kb * kb * nb * nb + 2 * ka * kb * ab, 0.0) ** 0.5
    scale = wanted / max(size, 1e-12)
    return joined.select(*HEAD, v.axpy(v.scale(F.col("a"), ka * scale), kb * scale, F.col("b")).alias("vec"))


def composed(left: DataFrame, right: DataFrame, mix_left: float, mix_right: float) -> DataFrame:
    """Weighted sum of two unit vectors, scaled to the mean of their norms (to the one that is not zero)."""
    joined = left.select(*HEAD, F.col("vec").alias("a")).join(right.select(*HEAD, F.col("vec").alias("b")), HEAD)
    s = joined.agg(F.sqrt(F.sum(v.sq_norm(F.col("a")))).alias("na"), F.sqrt(F.sum(v.sq_norm(F.col("b")))).alias("nb"), F.sum(v.dot(F.col("a"), F.col("b"))).alias("ab")).first()
    na, nb, ab = (float(s[c] or 0.0) for c in ("na", "nb", "ab"))
    ka, kb = (mix_left / na if na > 0 else 0.0), (mix_right / nb if nb > 0 else 0.0)
    size = max(ka * ka * na * na + kb * kb * nb * nb + 2 * ka * kb * ab, 0.0) ** 0.5
    wanted = (na + nb) / 2 if na > 0 and nb > 0 else max(na, nb)
    scale = wanted / max(size, 1e-12)
    return joined.select(*HEAD, v.axpy(v.scale(F.col("a"), ka * scale), kb * scale, F.col("b")).alias("vec"))


def alignment(deltas: DataFrame, bank: DataFrame, keys: Sequence[str], mask: DataFrame | None = None) -> DataFrame:
    """Dot and cosine of every row with every vector of a bank: a join on heads, summed per (row, vector)."""
    named = bank.select("name", *HEAD, F.col("vec").alias("_w"))
    if mask is not None:
        named = named.join(mask, ["name", *HEAD], "left_semi")
    sums = deltas.join(named, HEAD).groupBy(*keys, "name").agg(
        F.sum(v.dot(F.col("vec"), F.col("_w"))).alias("dot"), F.sum(v.sq_norm(F.col("vec"))).alias("aa"), F.sum(v.sq_norm(F.col("_w"))).alias("bb")
    )
    return sums.select(*keys, "name", "dot", v.ratio_or_zero(F.col("dot"), F.sqrt("aa") * F.sqrt("bb")).alias("cosine"))


def alignment_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("dot") > 0, 1.0).otherwise(0.0)).alias("positive_rate"), F.avg("dot").alias("mean_dot"), F.avg("cosine").alias("mean_cos")
    )


def random_mask(heads: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """k heads per group in seeded order."""
    return top_k(heads, keys, [seeded_key(seed, *keys, *HEAD), "layer", "head"], k)


def layer_matched_mask(heads: DataFrame, reference: DataFrame, seed: int) -> DataFrame:
    """As many random heads in each layer as the reference mask has there."""
    wanted = reference.groupBy("layer").agg(F.count("*").alias("_want"))
    w = Window.partitionBy("layer").orderBy(seeded_key(seed, *HEAD), "head")
    # heads is the layer x head grid of a model: its size does not depend on the data.
    return heads.join(wanted, "layer").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= _want").drop("_want")


def random_sweep(heads: DataFrame, keys: Sequence[str], k: int, repeats: int, seed: int) -> DataFrame:
    """``repeats`` independent random masks of k heads."""
    spread = heads.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return top_k(spread, [*keys, "repeat"], [seeded_key(seed, *keys, "repeat", *HEAD), "layer", "head"], k)


def routed_sums(rows: DataFrame, route: Column, bank: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the vectors every row is routed to. Rows with the same route share one sum, joined back by route."""
    routes = rows.withColumn("_route", F.array_sort(route))
    kinds = routes.select("_route").distinct().withColumn("name", F.explode("_route"))
    summed = mean_vectors(kinds.join(bank.select("name", *HEAD, "vec"), "name"), ["_route", *HEAD])
    total = summed.select("_route", *HEAD, v.scale(F.col("vec"), F.col("n").cast("double")).alias("vec"))
    return routes.select(*keys, "_route").join(total, "_route").select(*keys, F.array_join("_route", "+").alias("route"), *HEAD, "vec")


def name_map(subtype: Column, table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[subtype]
