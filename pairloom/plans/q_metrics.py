"""Evaluation of predictions (sections C6, C7, C10, C16, D10-D28, D33, D34)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import joins, metrics, profile, rankmetrics, selection
from pairloom.operators.ordering import seeded_flip
from pairloom.plans.bind import Tables
from pairloom.plans.registry import query


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named (or all double) columns at the edge of a query."""
    chosen = names or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in chosen})


CONFUSION = """
    SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE label IN ('yes', 'no')) AS labeled,
      count(*) FILTER (WHERE label = 'yes' AND pred = 'yes') AS tp, count(*) FILTER (WHERE label = 'no' AND pred = 'no') AS tn,
      count(*) FILTER (WHERE label = 'no' AND {fp}) AS fp, count(*) FILTER (WHERE label = 'yes' AND pred <> 'yes') AS fn,
      count(*) FILTER (WHERE {invalid}) AS invalid, count(*) FILTER (WHERE pred = 'yes') AS py, count(*) FILTER (WHERE label IN ('yes', 'no') AND pred = 'yes') AS lpy,
      count(*) FILTER (WHERE label = 'yes') AS ly FROM {source} GROUP BY ALL"""
PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""


def metrics_sql(keys: str, source: str, mode: str, extra: str = "") -> str:
    fp = "pred = 'yes'" if mode == "labeled" else "pred <> 'no'"
    invalid = "NOT (label IN ('yes', 'no') AND pred IN ('yes', 'no'))" if mode == "strict_shard" else "pred NOT IN ('yes', 'no')"
    total = "labeled" if mode in ("labeled", "balanced") else "n"
    rate = "lpy / labeled" if mode == "balanced" else "py / n"
    return f"""WITH c AS ({CONFUSION.format(keys=keys, fp=fp, invalid=invalid, source=source)}), d AS (SELECT *, {PRF} FROM c)
    SELECT {keys}, n, labeled, tp, tn, fp, fn, invalid, round((tp + tn) / nullif({total}, 0), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round({rate}, 6) AS yes_rate{extra} FROM d"""


@query("D10_metrics_labeled", metrics_sql("method, subtype", "preds", "labeled"))
def d10(t: Tables) -> DataFrame:
    return rounded(metrics.yes_no_metrics(t.preds, ["method", "subtype"], "labeled"))


@query("D11_metrics_strict", metrics_sql("method, subtype", "preds", "strict_shard"))
def d11(t: Tables) -> DataFrame:
    return rounded(metrics.yes_no_metrics(t.preds, ["method", "subtype"], "strict_shard"))


@query(
    "D12_metrics_balanced",
    metrics_sql(
        "method, subtype", "preds", "balanced",
        """, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity,
      round((r + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy,
      round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc,
      round(ly / labeled, 6) AS all_yes_accuracy, round(1 - ly / labeled, 6) AS all_no_accuracy""",
    ),
)
def d12(t: Tables) -> DataFrame:
    return rounded(metrics.yes_no_metrics(t.preds, ["method", "subtype"], "balanced"))


@query(
    "D13_group_accuracy",
    """SELECT method, coalesce(nullif(CASE WHEN subtype = 'rel_spatial' THEN '' ELSE subtype END, ''), 'unknown') AS subtype, count(*) AS n,
       round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN pred = 'yes' THEN 1.0 ELSE 0 END), 6) AS yes_rate FROM preds GROUP BY ALL""",
)
def d13(t: Tables) -> DataFrame:
    blank = t.preds.withColumn("subtype", F.when(F.col("subtype") == "rel_spatial", "").otherwise(F.col("subtype")))
    return rounded(metrics.group_accuracy(blank, ["method"], "subtype"))


FLIPS = """
    SELECT method, subtype, count(*) AS n, count(*) FILTER (WHERE pred <> bp) AS changed,
      count(*) FILTER (WHERE pred <> bp AND pred = label) AS wrong_to_right, count(*) FILTER (WHERE pred <> bp AND bp = label) AS right_to_wrong,
      count(*) FILTER (WHERE pred <> bp AND pred <> label AND bp <> label) AS wrong_to_wrong,
      count(*) FILTER (WHERE bp = 'yes' AND pred = 'no') AS yes_to_no, count(*) FILTER (WHERE bp = 'no' AND pred = 'yes') AS no_to_yes,
      count(*) FILTER (WHERE pred <> bp AND pred = label AND label = 'yes') AS fixed_yes, count(*) FILTER (WHERE pred <> bp AND pred = label AND label = 'no') AS fixed_no,
      count(*) FILTER (WHERE pred <> bp AND bp = label AND label = 'yes') AS broken_yes, count(*) FILTER (WHERE pred <> bp AND bp = label AND label = 'no') AS broken_no
    FROM ({source}) GROUP BY ALL"""


@query("D14_flips", FLIPS.format(source="SELECT *, coalesce(base_pred, 'invalid') AS bp FROM vars"))
def d14(t: Tables) -> DataFrame:
    return metrics.flips(t.vars, ["method", "subtype"])


@query("C7_flips_skip_missing", FLIPS.format(source="SELECT *, base_pred AS bp FROM vars WHERE base_pred IS NOT NULL"))
def c7(t: Tables) -> DataFrame:
    joined = joins.with_baseline(t.preds.filter("method <> 'view'"), t.base, ["subtype", "sample_id"], "skip")
    return metrics.flips(joined, ["method", "subtype"])


@query(
    "D14_changed_cases",
    """SELECT sample_id, method, subtype, label, pred, coalesce(base_pred, 'invalid') AS base_pred,
       CASE WHEN pred = label THEN 'wrong_to_right' WHEN coalesce(base_pred, 'invalid') = label THEN 'right_to_wrong' ELSE 'changed_wrong_to_wrong' END AS change_type
       FROM vars WHERE pred <> coalesce(base_pred, 'invalid')""",
)
def changed_cases(t: Tables) -> DataFrame:
    kind = metrics.change_type(F.col("pred"), F.col("base_pred"), F.col("label"))
    return t.vars.withColumn("change_type", kind).filter("change_type is not null").select("sample_id", "method", "subtype", "label", "pred", "base_pred", "change_type")


@query(
    "D15_margin_summary",
    """WITH d AS (SELECT *, score - base_score AS delta, score - 35 AS margin FROM vars WHERE base_score IS NOT NULL)
    SELECT method, round(coalesce(avg(delta), 0), 6) AS mean_delta, round(coalesce(avg(delta) FILTER (WHERE label = 'yes'), 0), 6) AS mean_delta_yes,
      round(coalesce(avg(delta) FILTER (WHERE label = 'no'), 0), 6) AS mean_delta_no, count(*) FILTER (WHERE delta > 0) AS n_pos, count(*) FILTER (WHERE delta < 0) AS n_neg,
      count(*) FILTER (WHERE delta = 0) AS n_zero, round(avg(CASE WHEN (margin >= 0) = (label = 'yes') THEN 1.0 ELSE 0 END), 6) AS margin_accuracy FROM d GROUP BY method""",
)
def d15(t: Tables) -> DataFrame:
    rows = t.vars.filter("base_score is not null")
    return rounded(metrics.margin_summary(rows, ["method"], F.col("score") - F.col("base_score"), F.col("score") - 35))


@query(
    "D16_candidate_summary",
    """SELECT method, subtype, count(*) AS num_pairs, count(*) FILTER (WHERE score > base_score) AS wins, count(*) FILTER (WHERE score = base_score) AS ties,
       count(*) FILTER (WHERE score < base_score) AS losses, round(avg(CASE WHEN score > base_score THEN 1.0 ELSE 0 END), 6) AS pairwise_acc, round(avg(score - base_score), 6) AS mean_margin
       FROM vars WHERE base_score IS NOT NULL GROUP BY ALL""",
)
def d16(t: Tables) -> DataFrame:
    return rounded(metrics.candidate_summary(t.vars.filter("base_score is not null"), ["method", "subtype"], "score", "base_score"))


def scored(t: Tables) -> DataFrame:
    """Every prediction as a scored binary row."""
    return t.preds.select("method", "subtype", "sample_id", F.when(F.col("label") == "yes", 1).otherwise(0).alias("label"), "score")


@query(
    "D17_threshold_metrics",
    """WITH s AS (SELECT method, th AS threshold, label = 'yes' AS y, score >= th AS hit FROM preds, (VALUES (10.0::DOUBLE), (35.0), (90.0)) v(th)),
    c AS (SELECT method, threshold, count(*) AS n, count(*) FILTER (WHERE y AND hit) AS tp, count(*) FILTER (WHERE NOT y AND NOT hit) AS tn,
      count(*) FILTER (WHERE NOT y AND hit) AS fp, count(*) FILTER (WHERE y AND NOT hit) AS fn FROM s GROUP BY ALL), d AS (SELECT *, """ + PRF + """ FROM c)
    SELECT method, threshold, n, tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy, round((r + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy,
      round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM d""",
)
def d17(t: Tables) -> DataFrame:
    return rounded(metrics.swept_thresholds(scored(t), ["method"], [10.0, 35.0, 90.0]))


@query(
    "D18_auroc",
    """WITH r AS (SELECT method, label, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS rk FROM preds),
    a AS (SELECT method, sum(rk) FILTER (WHERE label = 'yes') AS rs, count(*) FILTER (WHERE label = 'yes') AS p, count(*) FILTER (WHERE label = 'no') AS m FROM r GROUP BY method)
    SELECT method, round((rs - p * (p + 1) / 2) / (p * m), 6) AS auroc FROM a""",
)
def d18(t: Tables) -> DataFrame:
    return rounded(rankmetrics.auroc(rankmetrics.score_steps(scored(t), ["method"]), ["method"]))


@query(
    "D19_average_precision",
    """WITH r AS (SELECT method, label, row_number() OVER w AS rk, count(*) FILTER (WHERE label = 'yes') OVER (w ROWS UNBOUNDED PRECEDING) AS hits
      FROM preds WINDOW w AS (PARTITION BY method ORDER BY score DESC, CASE WHEN label = 'yes' THEN 0 ELSE 1 END, event_id))
    SELECT method, round(sum(hits / rk) FILTER (WHERE label = 'yes') / count(*) FILTER (WHERE label = 'yes'), 6) AS average_precision FROM r GROUP BY method""",
)
def d19(t: Tables) -> DataFrame:
    return rounded(rankmetrics.average_precision(rankmetrics.score_steps(scored(t), ["method"]), ["method"]))


BEST_THRESHOLD = """d AS (SELECT {k}, score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS m FROM s GROUP BY ALL),
    w AS (SELECT *, lag(score) OVER o AS prev, max(score) OVER (PARTITION BY {k}) AS top, coalesce(sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp,
      coalesce(sum(m) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bm, sum(p) OVER (PARTITION BY {k}) AS tp, sum(m) OVER (PARTITION BY {k}) AS tm
      FROM d WINDOW o AS (PARTITION BY {k} ORDER BY score)),
    c AS (SELECT {k}, CASE WHEN prev IS NULL THEN score - 1e-6 ELSE (prev + score) / 2 END AS threshold,
            (CASE WHEN tp > 0 THEN (tp - bp) / tp ELSE 0 END + CASE WHEN tm > 0 THEN bm / tm ELSE 0 END) / 2 AS gain FROM w
          UNION ALL SELECT {k}, top + 1e-6, CASE WHEN tm > 0 THEN 0.5 ELSE 0 END FROM w WHERE score = top)
    SELECT {k}, round(arg_max(threshold, (gain, -threshold)), 6) AS threshold, round(max(gain), 6) AS balanced_accuracy FROM c GROUP BY ALL"""


@query("D20_best_threshold", "WITH s AS (SELECT method, subtype, label = 'yes' AS y, score FROM preds), " + BEST_THRESHOLD.format(k="method, subtype"))
def d20(t: Tables) -> DataFrame:
    keys = ["method", "subtype"]
    return rounded(rankmetrics.best_threshold(rankmetrics.score_steps(scored(t), keys), keys))


def poisson_sql(u: str) -> str:
    """The Poisson(1) draw at ``u``: how many of its cumulative probabilities ``u`` reaches."""
    total, term, k, cuts = 0.0, 2.718281828459045**-1, 0, []
    while 1 - total > 2.0**-32:
        total += term
        cuts.append(repr(total))
        k += 1
        term /= k
    return f"len(list_filter([{', '.join(cuts)}]::DOUBLE[], lambda c: c <= {u}))"


@query(
    "D21_bootstrap_interval",
    f"""WITH r AS (SELECT method, sample_id, CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END AS win FROM preds),
    u AS (SELECT method, b, win, CAST('0x' || substr(md5('42|' || sample_id || '|' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM r, range(200) x(b)),
    w AS (SELECT method, b, win, {poisson_sql('u')} AS w FROM u),
    e AS (SELECT method, b, sum(w * win) / sum(w) AS estimate FROM w GROUP BY method, b HAVING sum(w) > 0),
    o AS (SELECT method, estimate, row_number() OVER (PARTITION BY method ORDER BY estimate, b) AS rk, count(*) OVER (PARTITION BY method) AS n FROM e)
    SELECT method, round(m.mean, 6) AS mean, round(max(estimate) FILTER (WHERE rk = floor((n - 1) * 0.025) + 1), 6) AS lower_95, round(max(estimate) FILTER (WHERE rk = floor((n - 1) * 0.975) + 1), 6) AS upper_95
    FROM o JOIN (SELECT method, avg(win) AS mean FROM r GROUP BY method) m USING (method) GROUP BY method, m.mean""",
)
def d21(t: Tables) -> DataFrame:
    win = F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)
    return rounded(rankmetrics.bootstrap_interval(t.preds, ["method"], win, "sample_id", replicates=200))


@query(
    "D22_describe",
    """SELECT method, count(score) AS count, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, round(stddev_pop(score), 6) AS std,
       round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.9), 6) AS q90 FROM preds GROUP BY method""",
)
def d22(t: Tables) -> DataFrame:
    return rounded(rankmetrics.describe(t.preds, ["method"], "score"))


RUNS = """
    SELECT subtype, method, alpha, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN pred = 'yes' THEN 1.0 ELSE 0 END) AS yes_rate,
      count(*) FILTER (WHERE pred <> bp AND pred = label) AS wrong_to_right, count(*) FILTER (WHERE pred <> bp AND bp = label) AS right_to_wrong, count(*) FILTER (WHERE pred <> bp) AS changed
    FROM (SELECT *, coalesce(base_pred, 'invalid') AS bp FROM vars) GROUP BY ALL"""


def runs(t: Tables) -> DataFrame:
    """One row per (subtype, method, alpha): accuracy, yes-rate and flips."""
    keys = ["subtype", "method", "alpha"]
    hit = F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy")
    rate = F.avg(F.when(F.col("pred") == "yes", 1.0).otherwise(0.0)).alias("yes_rate")
    kind = metrics.change_type(F.col("pred"), F.col("base_pred"), F.col("label"))
    return t.vars.groupBy(*keys).agg(
        F.count("*").alias("n"), hit, rate, F.count_if(kind == "wrong_to_right").alias("wrong_to_right"),
        F.count_if(kind == "right_to_wrong").alias("right_to_wrong"), F.count_if(kind.isNotNull()).alias("changed"),
    )


@query(
    "D23_weighted_average",
    f"""WITH r AS ({RUNS}) SELECT method, alpha, round(sum(accuracy * n) / sum(n), 6) AS accuracy, round(sum(yes_rate * n) / sum(n), 6) AS yes_rate,
    CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""",
)
def d23(t: Tables) -> DataFrame:
    return rounded(selection.weighted_average(runs(t), ["method", "alpha"], "n", ["accuracy", "yes_rate"], ["changed"]), "accuracy", "yes_rate")


@query(
    "D24_best_of",
    f"""WITH r AS ({RUNS}) SELECT subtype, method, round(alpha, 6) AS alpha, round(accuracy, 6) AS accuracy, n FROM r
    QUALIFY row_number() OVER (PARTITION BY subtype, method ORDER BY round(accuracy, 9) DESC, n DESC, alpha) = 1""",
)
def d24(t: Tables) -> DataFrame:
    best = selection.best_of(runs(t), ["subtype", "method"], [F.round("accuracy", 9), F.col("n"), -F.col("alpha")])
    return rounded(best.select("subtype", "method", "alpha", "accuracy", "n"))


@query(
    "D25_match_matrix",
    f"""WITH r AS ({RUNS}), v AS (SELECT subtype, CASE method WHEN 'click' THEN 'g_attr_clean' WHEN 'error' THEN 'd_' || subtype || '_top' WHEN 'purchase' THEN 'x_cat_y' ELSE 'g_all' END AS vector, accuracy, yes_rate, n FROM r),
    a AS (SELECT vector, subtype, sum(accuracy * n) / sum(n) AS accuracy, sum(yes_rate * n) / sum(n) AS yes_rate FROM v GROUP BY ALL)
    SELECT vector, subtype, CASE WHEN vector LIKE 'g\\_all%' ESCAPE '\\' THEN 'global' WHEN vector LIKE 'g\\_attr%' ESCAPE '\\' AND subtype LIKE 'attr\\_%' ESCAPE '\\' THEN 'type_matched'
      WHEN contains(vector, 'd_' || subtype || '_') THEN 'subtype_matched' WHEN subtype LIKE 'cat\\_%' ESCAPE '\\' AND contains(vector, '_cat_') THEN 'type_matched'
      WHEN subtype LIKE 'attr\\_%' ESCAPE '\\' AND contains(vector, '_attr_') THEN 'type_matched' WHEN subtype LIKE 'rel\\_%' ESCAPE '\\' AND contains(vector, '_rel_') THEN 'type_matched'
      ELSE 'mismatched' END AS match, round(accuracy, 6) AS accuracy, CASE WHEN yes_rate > 0.65 OR yes_rate < 0.35 THEN 1 ELSE 0 END AS suspicious FROM a""",
)
def d25(t: Tables) -> DataFrame:
    m = F.col("method")
    vector = (
        F.when(m == "click", "g_attr_clean").when(m == "error", F.concat(F.lit("d_"), "subtype", F.lit("_top"))).when(m == "purchase", "x_cat_y").otherwise("g_all")
    )
    named = runs(t).withColumn("vector", vector)
    avg = selection.weighted_average(named, ["vector", "subtype"], "n", ["accuracy", "yes_rate"])
    return avg.select(
        "vector", "subtype", selection.match_label(F.col("vector"), F.col("subtype")).alias("match"), F.round("accuracy", 6).alias("accuracy"),
        F.when(selection.suspicious_yes_rate(F.col("yes_rate")), 1).otherwise(0).alias("suspicious"),
    )


@query(
    "D25_score_matrix",
    """SELECT method, round(max(a) FILTER (WHERE subtype = 'cat_random'), 6) AS cat_random, round(max(a) FILTER (WHERE subtype = 'attr_color'), 6) AS attr_color,
       round(max(a) FILTER (WHERE subtype = 'attr_count'), 6) AS attr_count, round(max(a) FILTER (WHERE subtype = 'rel_spatial'), 6) AS rel_spatial
       FROM (SELECT method, subtype, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS a FROM preds GROUP BY ALL) GROUP BY method""",
)
def d25_matrix(t: Tables) -> DataFrame:
    table = metrics.yes_no_metrics(t.preds, ["method", "subtype"])
    return rounded(selection.score_matrix(table, "method", "subtype", ["cat_random", "attr_color", "attr_count", "rel_spatial"], "accuracy"))


@query(
    "D26_sweep_trend",
    """WITH a AS (SELECT method, subtype, floor(alpha * 5) AS step, avg(CASE WHEN pred = 'yes' THEN 1.0 ELSE 0 END) AS rate FROM vars GROUP BY ALL),
    s AS (SELECT method, subtype, rate - lag(rate) OVER (PARTITION BY method, subtype ORDER BY step) AS d FROM a)
    SELECT method, subtype, count(*) AS points, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN bool_or(d > 1e-9) AND bool_or(d < -1e-9) THEN 'mixed'
      WHEN bool_or(d < -1e-9) THEN 'decreasing' WHEN bool_or(d > 1e-9) THEN 'increasing' ELSE 'flat' END AS trend FROM s GROUP BY ALL""",
)
def d26(t: Tables) -> DataFrame:
    step = F.floor(F.col("alpha") * 5).alias("step")
    points = t.vars.groupBy("method", "subtype", step).agg(F.avg(F.when(F.col("pred") == "yes", 1.0).otherwise(0.0)).alias("rate"))
    return selection.sweep_trend(points, ["method", "subtype"], "step", "rate")


@query(
    "D28_parser_comparison",
    r"""WITH c AS (SELECT role, label, lower(answer) AS t FROM said),
    p AS (
      SELECT role, label, 'token' AS parser, coalesce(CASE WHEN w IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN w IN ('no', 'n', 'false', '0') THEN 'no' END, 'invalid') AS pred
        FROM (SELECT *, list_filter(string_split(regexp_replace(t, '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x IN ('yes', 'y', 'true', '1', 'no', 'n', 'false', '0'))[1] AS w FROM c)
      UNION ALL SELECT role, label, 'earliest', coalesce(nullif(regexp_extract(t, '(?:^|[^\p{L}\p{N}_])(yes|no)(?:$|[^\p{L}\p{N}_])', 1), ''), 'invalid') FROM c
      UNION ALL SELECT role, label, 'first_word', CASE WHEN w IN ('yes', 'no') THEN w ELSE 'invalid' END FROM (SELECT *, regexp_extract(t, '^[\s"''`*(\[]*([a-z]+)', 1) AS w FROM c)
      UNION ALL SELECT role, label, 'contains', CASE WHEN label = 'yes' THEN CASE WHEN contains(t, 'yes') THEN 'yes' ELSE 'no' END ELSE CASE WHEN contains(t, 'no') THEN 'no' ELSE 'yes' END END FROM c)
    SELECT role, parser, count(*) AS n, count(*) FILTER (WHERE label = pred) AS correct, count(*) FILTER (WHERE pred = 'invalid') AS invalid FROM p GROUP BY ALL""",
)
def d28(t: Tables) -> DataFrame:
    table = metrics.parser_comparison(t.said, ["role"], "answer")
    return table.select("role", "parser", "n", (F.col("tp") + F.col("tn")).alias("correct"), "invalid")


@query(
    "D28_top_outputs",
    r"""SELECT role, answer, count(*) AS n FROM (SELECT role, regexp_replace(answer, '^[\s\v]+|[\s\v]+$', '', 'g') AS answer FROM said) GROUP BY role, answer
    QUALIFY row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, answer) <= 30""",
)
def top_outputs(t: Tables) -> DataFrame:
    whole = F.regexp_replace("answer", r"^\s+|\s+$", "").alias("answer")
    return profile.top_values(t.said.select("role", whole), ["role"], "answer", 30).select("role", "answer", "n")


@query(
    "D33_sweep_tags",
    f"""WITH r AS ({RUNS}), b AS (SELECT subtype, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS ba FROM base GROUP BY subtype),
    d AS (SELECT r.*, accuracy - ba AS delta_f1, accuracy - ba AS delta_acc, right_to_wrong - wrong_to_right AS delta_fp, wrong_to_right - right_to_wrong AS delta_fn FROM r JOIN b USING (subtype)),
    g AS (SELECT method, subtype, arg_max(yes_rate, alpha) - arg_min(yes_rate, alpha) AS shift, arg_max(delta_fp, (delta_f1, -alpha)) AS fp, arg_max(delta_fn, (delta_f1, -alpha)) AS fn, max(delta_f1) AS best,
      sum(wrong_to_right) AS fixed, sum(right_to_wrong) AS broken, avg(changed / n) AS share, count(*) FILTER (WHERE delta_f1 > 0 OR delta_acc > 0) AS gains FROM d GROUP BY ALL)
    SELECT method, subtype, round(shift, 6) AS shift, gains, coalesce(nullif(concat_ws(', ', CASE WHEN fixed > broken AND share <= 0.1 THEN 'precise correction' END, CASE WHEN shift > 0.05 OR fp > 3 THEN 'yes-shift risk' END,
      CASE WHEN shift < -0.05 OR fn > 3 THEN 'no-shift risk' END, CASE WHEN gains <= 1 AND best > 0 THEN 'unstable single-point gain' END), ''), 'weak/no stable effect') AS tags FROM g""",
)
def d33(t: Tables) -> DataFrame:
    base = t.base.groupBy("subtype").agg(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)).alias("ba"))
    gain = F.col("accuracy") - F.col("ba")
    points = runs(t).join(base, "subtype").withColumns({
        "delta_f1": gain, "delta_acc": gain, "delta_fp": F.col("right_to_wrong") - F.col("wrong_to_right"), "delta_fn": F.col("wrong_to_right") - F.col("right_to_wrong"),
    })
    return selection.sweep_tags(points, ["method", "subtype"])


@query(
    "D34_validation_selection",
    """WITH s AS (SELECT subtype, CASE WHEN md5('7|' || sample_id) < '8' THEN 'val' ELSE 'test' END AS split, method, floor(alpha * 4) AS k, score, base_score FROM vars WHERE base_score IS NOT NULL),
    g AS (SELECT subtype, split, method, CAST(k AS BIGINT) AS k, count(*) AS num_pairs, avg(CASE WHEN score > base_score THEN 1.0 ELSE 0 END) AS pairwise_acc, avg(score - base_score) AS mean_margin FROM s GROUP BY ALL),
    v AS (SELECT * FROM g WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY subtype, method ORDER BY round(pairwise_acc, 9) DESC, round(mean_margin, 9) DESC, k) = 1)
    SELECT g.subtype, g.method, g.k, g.num_pairs, round(g.pairwise_acc, 6) AS pairwise_acc, round(g.mean_margin, 6) AS mean_margin FROM g JOIN v ON g.subtype = v.subtype AND g.method = v.method AND g.k = v.k WHERE g.split = 'test'""",
)
def d34(t: Tables) -> DataFrame:
    from pairloom.operators.ordering import seeded_key

    split = F.when(seeded_key(7, "sample_id") < "8", "val").otherwise("test")
    rows = t.vars.filter("base_score is not null").withColumns({"split": split, "k": F.floor(F.col("alpha") * 4).cast("long")})
    table = metrics.candidate_summary(rows, ["subtype", "split", "method", "k"], "score", "base_score")
    graded = table.withColumns({"pairwise_acc": F.round("pairwise_acc", 9), "mean_margin": F.round("mean_margin", 9), "alpha": F.lit(0.0), "sign": F.lit(1)})
    best = selection.select_on_validation(graded, ["subtype", "method"], ["k"])
    return rounded(best.select("subtype", "method", "k", "num_pairs", "pairwise_acc", "mean_margin"))


@query(
    "C6_attach_attributes",
    "SELECT p.sample_id, p.method, p.pred, coalesce(c.c_mktsegment, '') AS segment, coalesce(c.c_nationkey, -1) AS nation FROM preds p LEFT JOIN customer c ON c.c_custkey = p.user_id * 3",
)
def c6(t: Tables) -> DataFrame:
    raw = t.customer.select(F.col("c_custkey").alias("_id"), "c_mktsegment", "c_nationkey")
    joined = t.preds.join(raw, F.col("user_id") * 3 == F.col("_id"), "left")
    return joined.select("sample_id", "method", "pred", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"))


@query(
    "C10_run_comparison",
    """WITH m AS (SELECT subtype, method, count(*) AS n, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS acc FROM preds GROUP BY ALL)
    SELECT v.subtype, v.method, v.n, b.n AS base_n, round(v.acc - b.acc, 6) AS acc_diff, CASE WHEN v.n = b.n THEN 1 ELSE 0 END AS same_n FROM m v JOIN m b ON b.subtype = v.subtype AND b.method = 'view' WHERE v.method <> 'view'""",
)
def c10(t: Tables) -> DataFrame:
    table = metrics.yes_no_metrics(t.preds, ["subtype", "method"])
    base = table.filter("method = 'view'").select("subtype", F.col("n").alias("base_n"), F.col("accuracy").alias("base_acc"))
    joined = table.filter("method <> 'view'").join(base, "subtype")
    return joined.select(
        "subtype", "method", "n", "base_n", F.round(F.col("accuracy") - F.col("base_acc"), 6).alias("acc_diff"), F.when(F.col("n") == F.col("base_n"), 1).otherwise(0).alias("same_n")
    )


@query(
    "C16_experiment_grid",
    """WITH s AS (SELECT DISTINCT subtype, CASE WHEN subtype LIKE 'attr%' THEN 'attr' WHEN subtype LIKE 'rel%' THEN 'rel' ELSE split_part(subtype, '_', 1) END AS k FROM preds),
    m(subtype, other) AS (VALUES ('attr_color', 'attr_count'), ('attr_color', 'nowhere'), ('attr_count', 'rel_spatial'), ('rel_spatial', 'cat_random'))
    SELECT subtype || '__g_all__g_all_norm' AS name, subtype, 'g_all_clean' AS direction_key, 'mask_g_all_norm_top64' AS mask_key, 'g_all_baseline' AS match_type FROM s
    UNION ALL SELECT subtype || '__g_' || k || '_clean__mask_g_' || k || '_norm_top64', subtype, 'g_' || k || '_clean', 'mask_g_' || k || '_norm_top64', 'g_type_baseline' FROM s
    UNION ALL SELECT subtype || '__g_' || k || '_clean__mask_s_' || subtype || '_energy_top64', subtype, 'g_' || k || '_clean', 'mask_s_' || subtype || '_energy_top64', 'matched_energy' FROM s
    UNION ALL SELECT subtype || '__g_all_clean__mask_s_' || subtype || '_energy_top64', subtype, 'g_all_clean', 'mask_s_' || subtype || '_energy_top64', 'matched_energy_g_all' FROM s
    UNION ALL SELECT subtype || '__s_' || subtype || '_clean__mask_s_' || subtype || '_energy_top64', subtype, 's_' || subtype || '_clean', 'mask_s_' || subtype || '_energy_top64', 's_direction_ablation' FROM s
    UNION ALL SELECT s.subtype || '__g_' || s.k || '_clean__mismatch_' || other, s.subtype, 'g_' || s.k || '_clean', 'mask_s_' || other || '_energy_top64', 'mismatched_energy' FROM s JOIN m USING (subtype) WHERE other IN (SELECT subtype FROM s)
    UNION ALL SELECT subtype || '__g_' || k || '_clean__random_seed' || seed, subtype, 'g_' || k || '_clean', 'random_mask_top64_seed' || seed, 'random_mask' FROM s, (VALUES (1), (2)) v(seed)""",
)
def c16(t: Tables) -> DataFrame:
    table = joins.mismatch_table(t.spark, {"attr_color": ("attr_count", "nowhere"), "attr_count": ("rel_spatial",), "rel_spatial": ("cat_random",)})
    return joins.experiment_grid(t.preds.select("subtype").distinct(), table, [1, 2], own_direction=True)


@query(
    "D27_router_confusion",
    r"""WITH q AS (SELECT kind, trim(regexp_replace(regexp_replace(replace(lower(question), '-', ' '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM asked),
    f AS (SELECT kind, regexp_matches(t, '(^|[^a-z0-9_])(is|are)\s+there($|[^a-z0-9_])') AS ex, contains(t, 'how many') OR regexp_matches(t, '(^|\s)(number|total|count|one|two|three|four|five|six)($|\s)') AS c,
      regexp_matches(t, '(^|\s)(red|blue|green|yellow|black|white|gray|grey|brown|orange|color|colour)($|\s)') AS o, regexp_matches(t, '(^|\s)(sitting|standing|running|lying|holding|wearing|riding|carrying)($|\s)') AS a,
      regexp_matches(t, '(^|\s)(left|right|above|below|top|bottom)($|\s)') AS s, contains(t, 'direct contact') OR contains(t, 'touch') AS k FROM q),
    p AS (SELECT *, CASE WHEN k THEN 'rel_contact_missing' WHEN s THEN 'rel_spatial' WHEN c THEN 'attr_count' WHEN o THEN 'attr_color' WHEN a THEN 'attr_action_state' WHEN ex THEN 'cat' ELSE 'unknown' END AS predicted,
      (k::INT + s::INT + c::INT + o::INT + (a AND NOT k AND NOT s)::INT + (ex AND NOT (c OR o OR a OR s OR k))::INT) AS hits FROM f)
    SELECT ['cat', 'attr_count', 'attr_color', 'rel_spatial', 'rel_contact_missing', 'attr_action_state', 'cat', 'unknown'][CAST(kind + 1 AS INTEGER)] AS expected, predicted, count(*) AS n, round(avg(1 / greatest(hits, 1)), 6) AS mean_share FROM p GROUP BY ALL""",
)
def d27(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("cat", "attr_count", "attr_color", "rel_spatial", "rel_contact_missing", "attr_action_state", "cat", "unknown")))
    w = text.router_weights(F.col("question"))
    rows = t.asked.select(F.get(names, F.col("kind").cast("int")).alias("expected"), w.alias("w"))
    shown = rows.select("expected", text.router_primary(F.col("w")).alias("predicted"), F.get("w", F.lit(0))["weight"].alias("share"))
    return shown.groupBy("expected", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean_share"))


__all__ = ["seeded_flip", "rounded", "scored", "runs"]


@query(
    "D10_output_length",
    r"""WITH p AS (SELECT role, label, coalesce(nullif(regexp_extract(lower(answer), '(?:^|[^\p{L}\p{N}_])(yes|no)(?:$|[^\p{L}\p{N}_])', 1), ''), 'invalid') AS pred,
      CASE WHEN trim(answer, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(string_split_regex(trim(answer, chr(32) || chr(9) || chr(10) || chr(13)), '\s+')) END AS w FROM said)
    SELECT role, count(*) AS n, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(w), 6) AS avg_output_words FROM p GROUP BY role""",
)
def d10_output(t: Tables) -> DataFrame:
    parsed = t.said.withColumn("pred", text.parse_answer(F.col("answer"), "earliest"))
    return rounded(metrics.yes_no_metrics(parsed, ["role"], "labeled", output="answer").select("role", "n", "accuracy", "avg_output_words"))


@query(
    "D25_mask_match",
    """SELECT method, CASE method WHEN 'click' THEN 'matched_energy' WHEN 'error' THEN 'random_mask' WHEN 'purchase' THEN 'g_all_baseline' WHEN 'signup' THEN 'g_type_baseline' ELSE 'mismatched_energy' END AS match, count(*) AS n FROM preds GROUP BY ALL""",
)
def d25_masks(t: Tables) -> DataFrame:
    m, s = F.col("method"), F.col("subtype")
    kind = text.subtype_type(s)
    mask = (
        F.when(m == "click", F.concat(F.lit("mask_s_"), s, F.lit("_energy_top64"))).when(m == "error", "random_mask_top64_seed1").when(m == "purchase", "mask_g_all_norm_top64")
        .when(m == "signup", F.concat(F.lit("mask_g_"), kind, F.lit("_norm_top64"))).otherwise("mask_s_elsewhere_energy_top64")
    )
    return t.preds.groupBy("method", selection.mask_match(mask, s, kind, F.lit("")).alias("match")).agg(F.count("*").alias("n"))


@query(
    "D26_shift_tags",
    """WITH g AS (SELECT method, subtype, avg(CASE WHEN pred = 'yes' THEN 1.0 ELSE 0 END) - avg(CASE WHEN bp = 'yes' THEN 1.0 ELSE 0 END) AS dy, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) - avg(CASE WHEN bp = label THEN 1.0 ELSE 0 END) AS da,
      count(*) FILTER (WHERE pred <> bp AND pred = label) AS fixed, count(*) FILTER (WHERE pred <> bp AND bp = label) AS broken FROM (SELECT *, coalesce(base_pred, 'invalid') AS bp FROM vars) GROUP BY ALL)
    SELECT method, subtype, round(dy, 6) + 0.0 AS shift, coalesce(nullif(concat_ws(',', CASE WHEN dy > 0.02 THEN 'yes-shift' END, CASE WHEN dy < -0.02 THEN 'no-shift' END, CASE WHEN da > 0 AND fixed > broken THEN 'precise-correction' END), ''), 'neutral/mixed') AS tags FROM g""",
)
def d26_tags(t: Tables) -> DataFrame:
    keys = ["method", "subtype"]
    mean = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    table = metrics.flips(t.vars, keys).join(
        t.vars.groupBy(*keys).agg((mean("pred", "yes") - mean("base_pred", "yes")).alias("dy"), (mean("pred", F.col("label")) - mean("base_pred", F.col("label"))).alias("da")), keys
    )
    tags = selection.shift_tags(F.col("dy"), F.col("da"), F.col("wrong_to_right"), F.col("right_to_wrong"))
    return table.select(*keys, (F.round("dy", 6) + F.lit(0.0)).alias("shift"), tags.alias("tags"))
