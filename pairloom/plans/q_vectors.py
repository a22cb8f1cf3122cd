"""Vector tables (sections A16, B15, B16, C15, D32, E15, E16, E21, F1, F5, G1-G26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import vectors as v
from pairloom.operators import decompose, ordering, rankmetrics, resampling, selection, sets, validate
from pairloom.operators import vectors as vec
from pairloom.plans.bind import DIM, HEADS, Tables
from pairloom.plans.q_metrics import BEST_THRESHOLD, poisson_sql, rounded
from pairloom.plans.registry import query
from pairloom.session import pinned

H = vec.HEAD


def items(df: DataFrame, *keys: str, col: str = "vec") -> DataFrame:
    """One row per array item, rounded."""
    return df.select(*keys, F.posexplode(col).alias("d", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6) + F.lit(0.0))


def directions(t: Tables) -> DataFrame:
    return vec.directions(t.delta, F.col("subtype"))


def protos(t: Tables) -> DataFrame:
    """Written once: Spark then knows their size and broadcasts them to the activations only while they are small."""
    return pinned(vec.prototypes(t.acts))


R6 = "round(v, 6) + 0.0 AS v"


@query("A16_unfold_heads", f"SELECT pair_no, subtype, branch, layer, head, d, {R6} FROM acts")
def a16(t: Tables) -> DataFrame:
    return items(t.acts, "pair_no", "subtype", "branch", "layer", "head")


@query(
    "A16_unfold_nested",
    f"SELECT pair_no, branch, layer, head, d, {R6} FROM acts WHERE subtype = 'rel'",
)
def a16_nested(t: Tables) -> DataFrame:
    """The nested layout: the same payload as [layer][head][dim]."""
    def block(offset, size, n):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("embedding", offset + i * size + 1, size))

    nested = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: block(i * (HEADS * DIM), DIM, HEADS))
    lab = t.embeddings.filter("vec_id % 2 = 0 and label % 4 = 3").select(F.floor(F.col("vec_id") / 2).alias("pair_no"))
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / 2).alias("pair_no"), F.when(F.col("vec_id") % 2 == 0, "pos").otherwise("neg").alias("branch"), nested.alias("payload")
    ).join(lab, "pair_no", "left_semi")
    return items(vec.unfold_nested(rows, "payload"), "pair_no", "branch", "layer", "head")


@query("B15_layer_selection", f"SELECT pair_no, branch, layer, head, d, {R6} FROM acts WHERE layer IN (1)")
def b15(t: Tables) -> DataFrame:
    return items(validate.select_layers(t.acts, "1-1"), "pair_no", "branch", "layer", "head")


@query(
    "B16_finite_check",
    "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR x > 0.45)) > 0",
)
def b16(t: Tables) -> DataFrame:
    # Values above 0.45 stand in for the infinite ones, so that the check has something to find.
    marked = t.embeddings.withColumn("embedding", F.transform("embedding", lambda x: F.when(x > F.lit(0.45).cast("float"), F.lit(float("inf")).cast("float")).otherwise(x)))
    return marked.filter(v.not_finite(F.col("embedding"))).select("vec_id", "label")


@query(
    "G1_array_algebra",
    """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
    s AS (SELECT vec_id, list_sum([x[i]::DOUBLE * y[i] for i in range(1, 65)]) AS dot, sqrt(list_sum([x[i]::DOUBLE * x[i] for i in range(1, 65)])) AS nx,
      sqrt(list_sum([y[i]::DOUBLE * y[i] for i in range(1, 65)])) AS ny, sqrt(list_sum([(x[i]::DOUBLE - y[i]) * (x[i]::DOUBLE - y[i]) for i in range(1, 65)])) AS dist FROM p)
    SELECT vec_id, round(dot, 6) AS dot, round(nx, 6) AS norm, round(dot / (nx * ny), 6) AS cosine, round(dist, 6) AS distance FROM s""",
)
def g1(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    j = t.embeddings.filter("vec_id % 2 = 0").join(b, "vec_id")
    x, y = F.col("embedding"), F.col("y")
    return rounded(j.select("vec_id", v.dot(x, y).alias("dot"), v.norm(x).alias("norm"), v.cosine(x, y).alias("cosine"), v.distance(x, y).alias("distance")))


@query("G2_group_mean", "SELECT subtype, branch, layer, head, d, round(avg(v), 6) + 0.0 AS v FROM acts GROUP BY ALL")
def g2(t: Tables) -> DataFrame:
    return items(vec.mean_vectors(t.acts, ["subtype", "branch", *H]), "subtype", "branch", *H)


@query(
    "G3_prototypes",
    """SELECT subtype, layer, head, d, round(max(v) FILTER (WHERE k = 'pos'), 6) + 0.0 AS mu_pos, round(max(v) FILTER (WHERE k = 'neg'), 6) + 0.0 AS mu_neg, round(max(v) FILTER (WHERE k = 'axis'), 6) + 0.0 AS axis
       FROM (SELECT subtype, layer, head, d, branch AS k, v FROM mu UNION ALL SELECT subtype, layer, head, d, 'axis', v FROM axis) GROUP BY ALL""",
)
def g3(t: Tables) -> DataFrame:
    zipped = F.arrays_zip("mu_pos", "mu_neg", "axis")
    rows = protos(t).select("subtype", *H, F.posexplode(zipped).alias("d", "z"))
    return rows.select("subtype", *H, "d", *[(F.round(f"z.{c}", 6) + F.lit(0.0)).alias(c) for c in ("mu_pos", "mu_neg", "axis")])


@query(
    "G4_shuffled_control",
    """WITH s AS (SELECT subtype, layer, head, d, CASE WHEN CAST('0x' || substr(md5('42|' || pair_no), 1, 4) AS INTEGER) % 2 = 1 THEN CASE WHEN branch = 'pos' THEN 'neg' ELSE 'pos' END ELSE branch END AS branch, v FROM unit),
    m AS (SELECT subtype, branch, layer, head, d, avg(v) AS m FROM s GROUP BY ALL)
    SELECT subtype, branch, layer, head, d, round(CASE WHEN n > 1e-12 THEN m / n ELSE 0 END, 6) + 0.0 AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY subtype, branch, layer, head)) AS n FROM m)""",
)
def g4(t: Tables) -> DataFrame:
    p = vec.prototypes(vec.shuffled_labels(t.acts, "pair_no", 42))
    both = p.select("subtype", *H, F.inline(F.array(F.struct(F.lit("pos").alias("branch"), F.col("mu_pos").alias("vec")), F.struct(F.lit("neg").alias("branch"), F.col("mu_neg").alias("vec")))))
    return items(both, "subtype", "branch", *H)


COS_SCORES = """
    disp AS (SELECT subtype, layer, head, branch, avg(1 - dot) AS disp FROM (SELECT u.subtype, u.layer, u.head, u.branch, u.pair_no, sum(u.v * m.v) AS dot FROM unit u JOIN mu m USING (subtype, branch, layer, head, d) GROUP BY ALL) GROUP BY ALL),
    sep AS (SELECT p.subtype, p.layer, p.head, 1 - sum(p.v * q.v) AS sep FROM mu p JOIN mu q USING (subtype, layer, head, d) WHERE p.branch = 'pos' AND q.branch = 'neg' GROUP BY ALL),
    hs AS (SELECT subtype, layer, head, sep, a.disp AS disp_pos, b.disp AS disp_neg, sep / (a.disp + b.disp + 1e-8) AS score FROM sep JOIN disp a USING (subtype, layer, head) JOIN disp b USING (subtype, layer, head) WHERE a.branch = 'pos' AND b.branch = 'neg')"""


@query(
    "G5_head_scores",
    "WITH " + COS_SCORES + " SELECT subtype, layer, head, round(score, 6) AS score, round(sep, 6) AS sep, round(disp_pos, 6) AS disp_pos, round(disp_neg, 6) AS disp_neg, row_number() OVER (PARTITION BY subtype ORDER BY round(score, 9) DESC, round(sep, 9) DESC, layer, head) AS rank FROM hs",
)
def g5(t: Tables) -> DataFrame:
    scores = vec.head_scores(t.acts, protos(t))
    return rounded(vec.ranked_heads(scores, ["subtype"], None, ("score", "sep")).select("subtype", *H, "score", "sep", "disp_pos", "disp_neg", "rank"))


@query(
    "G5_head_scores_euclidean",
    """WITH m AS (SELECT subtype, branch, layer, head, d, avg(v) AS v FROM unit GROUP BY ALL),
    dd AS (SELECT subtype, layer, head, branch, avg(x) AS disp FROM (SELECT u.subtype, u.layer, u.head, u.branch, u.pair_no, sqrt(sum((u.v - m.v) * (u.v - m.v))) AS x FROM unit u JOIN m USING (subtype, branch, layer, head, d) GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT p.subtype, p.layer, p.head, sqrt(sum((p.v - q.v) * (p.v - q.v))) AS sep FROM m p JOIN m q USING (subtype, layer, head, d) WHERE p.branch = 'pos' AND q.branch = 'neg' GROUP BY ALL)
    SELECT s.subtype, s.layer, s.head, round(sep, 6) AS sep, round(sep / greatest(a.disp + b.disp, 1e-8), 6) AS score FROM s JOIN dd a USING (subtype, layer, head) JOIN dd b USING (subtype, layer, head) WHERE a.branch = 'pos' AND b.branch = 'neg'""",
)
def g5_euclid(t: Tables) -> DataFrame:
    return rounded(vec.head_scores(t.acts, protos(t), "euclidean").select("subtype", *H, "sep", "score"))


@query("G6_row_scores", "SELECT pair_no, subtype, branch, round(score, 6) + 0.0 AS score FROM scores")
def g6(t: Tables) -> DataFrame:
    s = vec.row_scores(t.acts, protos(t), ["pair_no", "subtype"])
    return s.withColumn("score", F.round("score", 6) + F.lit(0.0))


G7_SQL = """
    r AS (SELECT subtype, label, rank() OVER (PARTITION BY subtype ORDER BY score) + (count(*) OVER (PARTITION BY subtype, score) - 1) / 2 AS rk FROM labeled),
    auc AS (SELECT subtype, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auroc FROM r GROUP BY subtype),
    ord AS (SELECT subtype, label, row_number() OVER w AS rk, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM labeled WINDOW w AS (PARTITION BY subtype ORDER BY score DESC, label DESC, pair_no)),
    ap AS (SELECT subtype, sum(hits / rk) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 1) AS average_precision FROM ord GROUP BY subtype),
    pr AS (SELECT subtype, count(*) AS num_pairs, avg(CASE WHEN p > q THEN 1.0 ELSE 0 END) AS pairwise_acc, avg(p - q) AS mean_gap FROM
      (SELECT subtype, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM scores GROUP BY ALL) GROUP BY subtype)"""


@query(
    "G7_prototype_evaluation",
    "WITH " + G7_SQL + ", s AS (SELECT subtype, label = 1 AS y, score FROM labeled), bt AS (WITH " + BEST_THRESHOLD.format(k="subtype").replace("round(arg_max(threshold, (gain, -threshold)), 6)", "arg_max(threshold, (gain, -threshold))") + """)
    SELECT pr.subtype, num_pairs, round(pairwise_acc, 6) AS pairwise_acc, round(mean_gap, 6) AS mean_gap, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(bt.threshold, 6) AS threshold,
      (SELECT round(avg(CASE WHEN (l.score >= bt.threshold) = (l.label = 1) THEN 1.0 ELSE 0 END), 6) FROM labeled l WHERE l.subtype = pr.subtype) AS accuracy
    FROM pr JOIN auc USING (subtype) JOIN ap USING (subtype) JOIN bt USING (subtype)""",
)
def g7(t: Tables) -> DataFrame:
    scores = pinned(vec.row_scores(t.acts, protos(t), ["pair_no", "subtype"]))
    return rounded(vec.evaluation(scores, ["subtype"], "pair_no").drop("f1"))


REPLICATES = 200
INTERVAL_SQL = f"""
    pw AS (SELECT subtype, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM scores GROUP BY ALL),
    draws AS (SELECT subtype, pair_no, b, p > q AS win, {poisson_sql("u")} AS w FROM
      (SELECT *, CAST('0x' || substr(md5('42|' || pair_no || '|' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM pw, range({REPLICATES}) x(b))),
    copies AS (SELECT l.subtype, d.b, l.label, l.score, unnest(range(d.w)) FROM labeled l JOIN draws d USING (subtype, pair_no)),
    ranks AS (SELECT subtype, b, label, rank() OVER (PARTITION BY subtype, b ORDER BY score) + (count(*) OVER (PARTITION BY subtype, b, score) - 1) / 2 AS rk FROM copies),
    sizes AS (SELECT subtype, b, sum(rk) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS n FROM ranks GROUP BY ALL),
    hit AS (SELECT subtype, b, label, row_number() OVER w AS rk, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM copies WINDOW w AS (PARTITION BY subtype, b ORDER BY score DESC, label DESC)),
    est AS (
      SELECT 'pairwise_acc' AS metric, subtype, sum(w) FILTER (WHERE win) / sum(w) AS e FROM (SELECT subtype, b, win, w FROM draws) GROUP BY subtype, b HAVING sum(w) > 0
      UNION ALL SELECT 'auroc', subtype, (s - n * (n + 1) / 2) / (n * n) FROM sizes
      UNION ALL SELECT 'average_precision', subtype, sum(hits / rk) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 1) FROM hit GROUP BY subtype, b),
    ends AS (SELECT subtype, metric, e, row_number() OVER (PARTITION BY subtype, metric ORDER BY e) AS r, count(*) OVER (PARTITION BY subtype, metric) AS n FROM est),
    ci AS (SELECT subtype, """ + ", ".join(
    f"round(max(e) FILTER (WHERE metric = '{m}' AND r = floor((n - 1) * {q}) + 1), 6) AS {m}_{end}_95" for m in ("pairwise_acc", "auroc", "average_precision") for end, q in (("lower", 0.025), ("upper", 0.975))
) + " FROM ends GROUP BY subtype)"


@query(
    "G7_intervals",
    "WITH " + G7_SQL + "," + INTERVAL_SQL + """
    SELECT subtype, num_pairs, round(pairwise_acc, 6) AS pairwise_acc, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, ci.* EXCLUDE (subtype)
    FROM pr JOIN auc USING (subtype) JOIN ap USING (subtype) JOIN ci USING (subtype)""",
)
def g7_intervals(t: Tables) -> DataFrame:
    scores = pinned(vec.row_scores(t.acts, protos(t), ["pair_no", "subtype"]))
    plain = vec.evaluation(scores, ["subtype"], "pair_no").select("subtype", "num_pairs", "pairwise_acc", "auroc", "average_precision")
    return rounded(plain.join(resampling.pair_intervals(vec.paired_scores(scores, ["subtype", "pair_no"]), ["subtype"], "pair_no", replicates=REPLICATES), "subtype"))


@query(
    "G7_macro_average",
    "WITH " + G7_SQL + ", s AS (SELECT subtype, label = 1 AS y, score FROM labeled), bt AS (WITH " + BEST_THRESHOLD.format(k="subtype").replace("round(arg_max(threshold, (gain, -threshold)), 6)", "arg_max(threshold, (gain, -threshold))") + """),
    cut AS (SELECT subtype, avg(CASE WHEN hit = y THEN 1.0 ELSE 0 END) AS accuracy, 2 * count(*) FILTER (WHERE hit AND y) / nullif(count(*) FILTER (WHERE hit) + count(*) FILTER (WHERE y), 0) AS f1
      FROM (SELECT subtype, y, score >= threshold AS hit FROM s JOIN bt USING (subtype)) GROUP BY subtype),
    m AS (SELECT pr.subtype, num_pairs, pairwise_acc, auroc, average_precision, accuracy, coalesce(f1, 0) AS f1 FROM pr JOIN auc USING (subtype) JOIN ap USING (subtype) JOIN cut USING (subtype))
    SELECT subtype, num_pairs, round(pairwise_acc, 6) AS pairwise_acc, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM m
    UNION ALL SELECT 'macro', CAST(sum(num_pairs) AS BIGINT), round(avg(pairwise_acc), 6), round(avg(auroc), 6), round(avg(average_precision), 6), round(avg(accuracy), 6), round(avg(f1), 6) FROM m""",
)
def g7_macro(t: Tables) -> DataFrame:
    scores = pinned(vec.row_scores(t.acts, protos(t), ["pair_no", "subtype"]))
    metrics = ["pairwise_acc", "auroc", "average_precision", "accuracy", "f1"]
    table = pinned(vec.evaluation(scores, ["subtype"], "pair_no").select("subtype", "num_pairs", *metrics))
    return rounded(vec.macro_average(table, "subtype", metrics, ["num_pairs"]))


@query(
    "G8_cross_matrix",
    """WITH x AS (SELECT a.subtype AS prototype, u.subtype, u.pair_no, u.branch, round(sum(u.v * a.v) / 8, 9) AS score FROM unit u JOIN axis a USING (layer, head, d) GROUP BY ALL),
    pr AS (SELECT prototype, subtype, avg(CASE WHEN p > q THEN 1.0 ELSE 0 END) AS pairwise_acc FROM (SELECT prototype, subtype, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM x GROUP BY ALL) GROUP BY ALL),
    r AS (SELECT prototype, subtype, branch, rank() OVER (PARTITION BY prototype, subtype ORDER BY score) + (count(*) OVER (PARTITION BY prototype, subtype, score) - 1) / 2 AS rk FROM x),
    a AS (SELECT prototype, subtype, sum(rk) FILTER (WHERE branch = 'pos') AS s, count(*) FILTER (WHERE branch = 'pos') AS p, count(*) FILTER (WHERE branch = 'neg') AS m FROM r GROUP BY ALL)
    SELECT prototype, subtype, round(pairwise_acc, 6) AS pairwise_acc, round((s - p * (p + 1) / 2) / (p * m), 6) AS auroc FROM pr JOIN a USING (prototype, subtype)""",
)
def g8(t: Tables) -> DataFrame:
    from pairloom.operators import metrics

    named = protos(t).withColumnRenamed("subtype", "prototype").select("prototype", *H, "axis")
    scores = vec.row_scores(t.acts, named, ["prototype", "subtype", "pair_no"], on=H).withColumn("score", F.round("score", 9))
    scores = pinned(scores)
    keys = ["prototype", "subtype"]
    pairs = metrics.candidate_summary(vec.paired_scores(scores, [*keys, "pair_no"]), keys).select(*keys, "pairwise_acc")
    return rounded(pairs.join(rankmetrics.auroc(rankmetrics.score_steps(vec.as_labels(scores), keys), keys), keys))


@query(
    "C15_cross_scores",
    "SELECT d.pair_no, n.name, round(sum(d.v * n.v), 6) + 0.0 AS dot FROM delta d JOIN dirs n USING (layer, head, d) GROUP BY ALL",
)
def c15(t: Tables) -> DataFrame:
    return vec.alignment(t.delta, directions(t), ["pair_no"]).select("pair_no", "name", (F.round("dot", 6) + F.lit(0.0)).alias("dot"))


@query(
    "G9_topk_sweep",
    "WITH " + COS_SCORES + """, rk AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY round(score, 9) DESC, round(sep, 9) DESC, layer, head) AS rank FROM hs),
    x AS (SELECT kk.k, u.subtype, u.pair_no, u.branch, sum(u.v * a.v / kk.k) AS score FROM unit u JOIN axis a USING (subtype, layer, head, d) JOIN rk USING (subtype, layer, head) JOIN (VALUES (1), (2), (4), (8)) kk(k) ON rk.rank <= kk.k GROUP BY ALL)
    SELECT CAST(k AS INTEGER) AS k, subtype, count(*) AS num_pairs, round(avg(CASE WHEN round(p, 9) > round(q, 9) THEN 1.0 ELSE 0 END), 6) AS pairwise_acc FROM (SELECT k, subtype, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM x GROUP BY ALL) GROUP BY ALL""",
)
def g9(t: Tables) -> DataFrame:
    """All k in one pass: a head of rank r belongs to every k >= r."""
    from pairloom.operators import metrics

    p = pinned(protos(t))
    ranked = vec.ranked_heads(vec.head_scores(t.acts, p), ["subtype"], 8, ("score", "sep"))
    ks = F.filter(F.array(*map(F.lit, (1, 2, 4, 8))), lambda k: k >= F.col("rank"))
    chosen = p.join(ranked.select("subtype", *H, F.explode(ks).alias("k")), ["subtype", *H])
    s = vec.row_scores(t.acts, chosen, ["k", "subtype", "pair_no"]).withColumn("score", F.round("score", 9))
    table = metrics.candidate_summary(vec.paired_scores(s, ["k", "subtype", "pair_no"]), ["k", "subtype"])
    return rounded(table.select("k", "subtype", "num_pairs", "pairwise_acc"))


def part_of(t: Tables) -> DataFrame:
    """Activations with a train, val or test split of their pairs."""
    key = ordering.seeded_key(7, "pair_no")
    return t.acts.withColumn("split", F.when(key < "8", "train").when(key < "c", "val").otherwise("test"))


#: Prototypes, head ranks and scores for every k, learnt on the training pairs alone.
PREFIX_SQL = """
    us AS (SELECT *, CASE WHEN md5('7|' || pair_no) < '8' THEN 'train' WHEN md5('7|' || pair_no) < 'c' THEN 'val' ELSE 'test' END AS split FROM unit),
    tm AS (SELECT subtype, branch, layer, head, d, CASE WHEN n > 1e-12 THEN m / n ELSE 0 END AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY subtype, branch, layer, head)) AS n
      FROM (SELECT subtype, branch, layer, head, d, avg(v) AS m FROM us WHERE split = 'train' GROUP BY ALL))),
    ta AS (SELECT subtype, layer, head, d, CASE WHEN n > 1e-12 THEN m / n ELSE 0 END AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY subtype, layer, head)) AS n
      FROM (SELECT subtype, layer, head, d, max(v) FILTER (WHERE branch = 'pos') - max(v) FILTER (WHERE branch = 'neg') AS m FROM tm GROUP BY ALL))),
    td AS (SELECT subtype, layer, head, branch, avg(1 - dot) AS disp FROM (SELECT u.subtype, u.layer, u.head, u.branch, u.pair_no, sum(u.v * m.v) AS dot FROM us u JOIN tm m USING (subtype, branch, layer, head, d) WHERE split = 'train' GROUP BY ALL) GROUP BY ALL),
    ts AS (SELECT p.subtype, p.layer, p.head, 1 - sum(p.v * q.v) AS sep FROM tm p JOIN tm q USING (subtype, layer, head, d) WHERE p.branch = 'pos' AND q.branch = 'neg' GROUP BY ALL),
    rk AS (SELECT subtype, layer, head, row_number() OVER (PARTITION BY subtype ORDER BY round(sep / (a.disp + b.disp + 1e-8), 9) DESC, round(sep, 9) DESC, layer, head) AS rank
      FROM ts JOIN td a USING (subtype, layer, head) JOIN td b USING (subtype, layer, head) WHERE a.branch = 'pos' AND b.branch = 'neg'),
    xk AS (SELECT kk.k, u.subtype, u.pair_no, u.branch, u.split, sum(u.v * a.v / kk.k) AS score FROM us u JOIN ta a USING (subtype, layer, head, d) JOIN rk USING (subtype, layer, head)
      JOIN (VALUES (1), (2), (4), (8)) kk(k) ON rk.rank <= kk.k WHERE u.split <> 'train' GROUP BY ALL),
    pk AS (SELECT k, subtype, split, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM xk GROUP BY ALL)"""
KS = (1, 2, 4, 8)


def prefixes(t: Tables) -> DataFrame:
    """Scores for every k of the pairs to tune and to test on, one row a pair and branch."""
    acts = pinned(part_of(t))
    train = acts.filter("split = 'train'")
    p = protos_of(train)
    ranked = vec.ranked_heads(vec.head_scores(train, p), ["subtype"], max(KS), ("score", "sep"))
    return pinned(vec.prefix_scores(acts.filter("split <> 'train'"), p, ranked, ["split", "subtype", "pair_no"], KS))


def protos_of(acts: DataFrame) -> DataFrame:
    return pinned(vec.prototypes(acts))


@query(
    "G9_frozen_test",
    "WITH " + PREFIX_SQL + """,
    ch AS (SELECT subtype, k, acc FROM (SELECT subtype, k, avg(CASE WHEN round(p, 9) > round(q, 9) THEN 1.0 ELSE 0 END) AS acc FROM pk WHERE split = 'val' GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY round(acc, 9) DESC, k) = 1),
    s AS (SELECT subtype, branch = 'pos' AS y, round(score, 9) AS score FROM xk JOIN ch USING (subtype, k) WHERE split = 'val'),
    bt AS (WITH """ + BEST_THRESHOLD.format(k="subtype").replace("round(arg_max(threshold, (gain, -threshold)), 6)", "arg_max(threshold, (gain, -threshold))") + """),
    lt AS (SELECT subtype, pair_no, CASE WHEN branch = 'pos' THEN 1 ELSE 0 END AS label, round(score, 9) AS score FROM xk JOIN ch USING (subtype, k) WHERE split = 'test'),
    r AS (SELECT subtype, label, rank() OVER (PARTITION BY subtype ORDER BY score) + (count(*) OVER (PARTITION BY subtype, score) - 1) / 2 AS rk FROM lt),
    auc AS (SELECT subtype, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auroc FROM r GROUP BY subtype),
    hit AS (SELECT subtype, label = 1 AS y, score >= threshold AS h FROM lt JOIN bt USING (subtype)),
    acc AS (SELECT subtype, avg(CASE WHEN h = y THEN 1.0 ELSE 0 END) AS accuracy, 2 * count(*) FILTER (WHERE h AND y) / nullif(count(*) FILTER (WHERE h) + count(*) FILTER (WHERE y), 0) AS f1 FROM hit GROUP BY subtype)
    SELECT subtype, CAST(ch.k AS INTEGER) AS k, round(ch.acc, 6) AS tuned_acc, round(threshold, 6) AS threshold, count(*) AS num_pairs, round(avg(CASE WHEN p > q THEN 1.0 ELSE 0 END), 6) AS pairwise_acc,
      round(any_value(auroc), 6) AS auroc, round(any_value(accuracy), 6) AS accuracy, round(coalesce(any_value(f1), 0), 6) AS f1
    FROM pk JOIN ch USING (subtype, k) JOIN bt USING (subtype) JOIN auc USING (subtype) JOIN acc USING (subtype) WHERE split = 'test' GROUP BY subtype, ch.k, ch.acc, threshold""",
)
def g9_frozen(t: Tables) -> DataFrame:
    table = vec.frozen_test(prefixes(t), ["subtype"], "pair_no", "split", KS)
    return rounded(table.select("subtype", "k", "tuned_acc", "threshold", "num_pairs", "pairwise_acc", "auroc", "accuracy", "f1"))


ALPHAS, SIGNS = (0.25, 0.5, 1.0, 2.0), (-1, 1)


@query(
    "D34_grid_search",
    "WITH " + PREFIX_SQL + """,
    grid AS (SELECT k, a, s FROM (VALUES (1), (2), (4)) x(k), (VALUES (0.25::DOUBLE), (0.5), (1.0), (2.0)) y(a), (VALUES (-1), (1)) z(s)),
    m AS (SELECT e.split, e.subtype, g.k, g.a, g.s, round(b.p - b.q + g.a * g.s * (e.p - e.q), 9) AS m FROM pk e JOIN pk b ON b.k = 8 AND b.subtype = e.subtype AND b.pair_no = e.pair_no JOIN grid g ON g.k = e.k
          UNION ALL SELECT split, subtype, 0, 0, 1, round(p - q, 9) FROM pk WHERE k = 8),
    t AS (SELECT split, subtype, k, a, s, count(*) AS num_pairs, count(*) FILTER (WHERE m > 0) AS wins, count(*) FILTER (WHERE m = 0) AS ties, avg(m) AS mean_margin FROM m GROUP BY ALL),
    best AS (SELECT * FROM t WHERE split = 'val' AND k > 0 QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY round(wins / num_pairs, 9) DESC, round(mean_margin, 9) DESC, a, k, s) = 1)
    SELECT t.subtype, t.k, t.a AS alpha, t.s AS sign, t.num_pairs, t.wins, t.ties, round(t.wins / t.num_pairs, 6) AS pairwise_acc, round(t.mean_margin, 6) AS mean_margin,
      round(b.wins / b.num_pairs, 6) AS base_pairwise_acc, round(b.mean_margin, 6) AS base_mean_margin, round(best.wins / best.num_pairs, 6) AS tuned_pairwise_acc,
      round(t.wins / t.num_pairs - b.wins / b.num_pairs, 6) AS delta_pairwise_acc, round(t.mean_margin - b.mean_margin, 6) AS delta_mean_margin
    FROM best JOIN t ON t.split = 'test' AND t.subtype = best.subtype AND t.k = best.k AND t.a = best.a AND t.s = best.s JOIN t b ON b.split = 'test' AND b.k = 0 AND b.subtype = best.subtype""",
)
def d34_grid(t: Tables) -> DataFrame:
    """Steering moves a pair's margin over all heads by alpha times sign times its margin over the k best."""
    pairs = vec.paired_prefixes(prefixes(t), ["split", "subtype", "pair_no"])
    margins = pairs.select("split", "subtype", F.zip_with("scores_pos", "scores_neg", lambda p, n: p - n).alias("m"))
    table = selection.grid_summaries(margins, ["subtype", "split"], F.element_at("m", -1), F.slice("m", 1, 3), KS[:3], ALPHAS, SIGNS)
    best = selection.tuned_and_tested(pinned(table), ["subtype"])
    return rounded(best.drop("losses", "tuned_mean_margin"))


@query(
    "G10_random_baseline",
    """WITH h AS (SELECT subtype, layer, head, r AS repeat, row_number() OVER (PARTITION BY subtype, r ORDER BY md5('5|' || subtype || '|' || r || '|' || layer || '|' || head), layer, head) AS rank
      FROM (SELECT DISTINCT subtype, layer, head FROM axis), range(1, 6) v(r)),
    x AS (SELECT h.repeat, u.subtype, u.pair_no, u.branch, round(sum(u.v * a.v) / 3, 9) AS score FROM unit u JOIN axis a USING (subtype, layer, head, d) JOIN h USING (subtype, layer, head) WHERE h.rank <= 3 GROUP BY ALL),
    p AS (SELECT repeat, subtype, avg(CASE WHEN p > q THEN 1.0 ELSE 0 END) AS acc FROM (SELECT repeat, subtype, pair_no, max(score) FILTER (WHERE branch = 'pos') AS p, max(score) FILTER (WHERE branch = 'neg') AS q FROM x GROUP BY ALL) GROUP BY ALL)
    SELECT subtype, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM p GROUP BY subtype""",
)
def g10(t: Tables) -> DataFrame:
    from pairloom.operators import metrics

    p = pinned(protos(t))
    masks = vec.random_sweep(p.select("subtype", *H), ["subtype"], 3, 5, 5).select("subtype", *H, "repeat")
    s = vec.row_scores(t.acts, p.join(masks, ["subtype", *H]), ["repeat", "subtype", "pair_no"]).withColumn("score", F.round("score", 9))
    table = metrics.candidate_summary(vec.paired_scores(s, ["repeat", "subtype", "pair_no"]), ["repeat", "subtype"])
    return rounded(table.groupBy("subtype").agg(F.avg("pairwise_acc").alias("mean"), F.stddev_pop("pairwise_acc").alias("std")))


@query(
    "G11_directions",
    """WITH m AS (SELECT CASE subtype WHEN 'cnt' THEN 'attr' WHEN 'col' THEN 'attr' ELSE subtype END AS name, layer, head, d, avg(v) AS v FROM delta GROUP BY ALL),
    h AS (SELECT name, layer, head, sum(v * v) AS q FROM m GROUP BY ALL) SELECT name, round(sqrt(sum(q)), 6) AS flat_norm, round(avg(sqrt(q)), 6) AS mean, round(max(sqrt(q)), 6) AS max, round(min(sqrt(q)), 6) AS min FROM h GROUP BY name""",
)
def g11(t: Tables) -> DataFrame:
    kind = vec.name_map(F.col("subtype"), {"cat": "cat", "cnt": "attr", "col": "attr", "rel": "rel"})
    return rounded(vec.norm_summary(vec.directions(t.delta, kind)))


@query(
    "G12_relation_directions",
    """WITH r AS (SELECT *, ['left_of', 'right_of', 'above', 'below', 'on'][condition % 5 + 1] AS rel FROM delta),
    g AS (SELECT unnest(list_filter(['rel_all', CASE rel WHEN 'left_of' THEN 'rel_left' WHEN 'right_of' THEN 'rel_right' WHEN 'above' THEN 'rel_above' WHEN 'below' THEN 'rel_below' END,
       CASE WHEN rel IN ('left_of', 'right_of') THEN 'rel_horizontal' WHEN rel IN ('above', 'below') THEN 'rel_vertical' END], lambda x: x IS NOT NULL)) AS name, layer, head, d, v FROM r)
    SELECT name, layer, head, d, round(avg(v), 6) + 0.0 AS v FROM g GROUP BY ALL""",
)
def g12(t: Tables) -> DataFrame:
    rel = F.get(F.array(*map(F.lit, ("left_of", "right_of", "above", "below", "on"))), F.col("condition") % 5)
    return items(vec.grouped_directions(t.delta, vec.relation_groups(rel)), "name", *H)


@query(
    "G13_condition_balanced",
    "SELECT subtype, layer, head, d, round(avg(m), 6) + 0.0 AS v FROM (SELECT subtype, condition, layer, head, d, avg(v) AS m FROM delta GROUP BY ALL) GROUP BY ALL",
)
def g13(t: Tables) -> DataFrame:
    return items(vec.condition_balanced(t.delta, ["subtype"], "condition"), "subtype", *H)


@query(
    "G14_energy",
    """WITH q AS (SELECT pair_no, subtype, condition, layer, head, sum(v * v) AS q FROM delta GROUP BY ALL), c AS (SELECT subtype, condition, layer, head, sqrt(avg(q)) AS e FROM q GROUP BY ALL)
    SELECT a.subtype, a.layer, a.head, round(a.e, 6) AS score, round(b.e, 6) AS balanced FROM (SELECT subtype, layer, head, sqrt(avg(q)) AS e FROM q GROUP BY ALL) a
    JOIN (SELECT subtype, layer, head, avg(e) AS e FROM c GROUP BY ALL) b USING (subtype, layer, head)""",
)
def g14(t: Tables) -> DataFrame:
    plain = vec.energy(t.delta, ["subtype"])
    balanced = vec.energy(t.delta, ["subtype"], "condition").withColumnRenamed("score", "balanced")
    return rounded(plain.join(balanced, ["subtype", *H]))


YESNO = "yn AS (SELECT layer, head, d, avg(v) FILTER (WHERE answer = 'yes') - avg(v) FILTER (WHERE answer = 'no') AS b FROM delta GROUP BY ALL)"


@query("G15_answer_direction", f"WITH {YESNO} SELECT layer, head, d, round(b, 6) + 0.0 AS v FROM yn")
def g15(t: Tables) -> DataFrame:
    return items(vec.answer_direction(t.delta), *H)


@query(
    "G16_remove_projection",
    f"""WITH {YESNO}, s AS (SELECT name, sum(v * b) AS vb, sum(b * b) AS bb, sum(v * v) AS vv FROM dirs JOIN yn USING (layer, head, d) GROUP BY name),
    c AS (SELECT dirs.name, layer, head, d, v - vb / bb * b AS v, b FROM dirs JOIN yn USING (layer, head, d) JOIN s ON s.name = dirs.name),
    a AS (SELECT name, sum(v * b) AS cb, sum(v * v) AS cc FROM c GROUP BY name)
    SELECT name, round(vb / sqrt(bb * vv), 6) AS raw_cosine, round(abs(vb) / sqrt(bb * vv), 6) AS projection_ratio, round(sqrt(cc) / sqrt(vv), 6) AS rest_ratio,
      CASE WHEN abs(cb / sqrt(bb * cc)) < 1e-9 THEN 1 ELSE 0 END AS orthogonal FROM s JOIN a USING (name)""",
)
def g16(t: Tables) -> DataFrame:
    _, stats = vec.remove_projection(directions(t), vec.answer_direction(t.delta))
    clean = F.when(F.abs("clean_cosine") < 1e-9, 1).otherwise(0).alias("orthogonal")
    return rounded(stats.select("name", "raw_cosine", "projection_ratio", "rest_ratio", clean))


@query("G17_shared_private")
def g17(t: Tables) -> DataFrame:
    """Norms of projection and residual of each type direction for the three ways to find the shared part."""
    delta = pinned(t.delta)
    out = []
    for method in ("mean_all", "type_mean_svd", "all_svd"):
        parts = decompose.shared_private(delta, "subtype", "pair_no", method, 1, True, HEADS, DIM)
        stats = vec.norm_summary(parts["projection"]).select("name", F.round("flat_norm", 6).alias("projection_norm"))
        res = vec.norm_summary(parts["residual"]).select("name", F.round("flat_norm", 6).alias("residual_norm"))
        out.append(stats.join(res, "name").withColumn("method", F.lit(method)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "G17_mean_all_projection",
    """WITH n AS (SELECT pair_no, sqrt(sum(v * v)) AS n FROM delta GROUP BY pair_no), u AS (SELECT subtype, pair_no, layer, head, d, v / n AS v FROM delta JOIN n USING (pair_no)),
    r AS (SELECT subtype AS name, layer, head, d, avg(v) AS v FROM u GROUP BY ALL), rn AS (SELECT name, sqrt(sum(v * v)) AS n FROM r GROUP BY name),
    g AS (SELECT layer, head, d, avg(v) AS g FROM u GROUP BY ALL), gn AS (SELECT sqrt(sum(g * g)) AS gn FROM g)
    SELECT name, round(abs(sum(v * g) / max(n) / max(gn)), 6) AS projection_norm FROM r JOIN g USING (layer, head, d) JOIN rn USING (name), gn GROUP BY name""",
)
def g17_mean(t: Tables) -> DataFrame:
    parts = decompose.shared_private(t.delta, "subtype", "pair_no", "mean_all", 1, True)
    return vec.norm_summary(parts["projection"]).select("name", F.round("flat_norm", 6).alias("projection_norm"))


@query("G18_denoised_mean")
def g18(t: Tables) -> DataFrame:
    """Every subtype by itself; their number does not grow with the rows."""
    delta = pinned(t.delta)
    out = None
    for (subtype,) in sorted(delta.select("subtype").distinct().collect(), key=str) or [(None,)]:
        projection, energy = decompose.denoised(delta.filter(F.col("subtype").eqNullSafe(F.lit(subtype))), "pair_no", HEADS, DIM, 2)
        part = items(projection.withColumn("subtype", F.lit(subtype).cast("string")), "subtype", *H).withColumn("energy", F.round(F.lit(sum(energy)), 6))
        out = part if out is None else out.unionByName(part)
    return out


COSINES = "SELECT x.name AS a, y.name AS b, round(sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)), 6) AS cosine FROM {0} x JOIN {0} y USING (layer, head, d) {1} GROUP BY ALL"


@query("G19_cosine_matrix", COSINES.format("dirs", ""))
def g19(t: Tables) -> DataFrame:
    return rounded(vec.cosine_matrix(pinned(directions(t))))


@query("G19_restricted_cosines", COSINES.format("dirs", "WHERE (layer, head) IN (SELECT (layer, head) FROM headscore WHERE name IN ('cat', 'rel') QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, layer, head) <= 3)"))
def g19_masked(t: Tables) -> DataFrame:
    bank = pinned(directions(t))
    mask = vec.ranked_heads(vec.head_norms(bank).filter("name in ('cat', 'rel')"), ["name"], 3)
    return rounded(vec.cosine_matrix(bank, mask))


@query(
    "G20_contrast_families",
    """WITH un AS (SELECT dirs.name, layer, head, d, v / score AS v FROM dirs JOIN headscore USING (name, layer, head)),
    f AS (SELECT 'contrast' AS family, * FROM dirs UNION ALL SELECT 'headnorm_contrast', * FROM un),
    o AS (SELECT family, name, layer, head, d, v, (sum(v) OVER (PARTITION BY family, layer, head, d) - v) / (count(*) OVER (PARTITION BY family, layer, head, d) - 1) AS o FROM f),
    c AS (SELECT family, l, name, layer, head, v - l * o AS v FROM o, (VALUES (0.25::DOUBLE), (0.75)) x(l))
    SELECT family, l AS lambda, name, round(sqrt(sum(v * v)), 6) AS flat_norm FROM c GROUP BY ALL""",
)
def g20(t: Tables) -> DataFrame:
    fam = vec.contrast_families(pinned(directions(t)), [0.25, 0.75])
    return rounded(vec.norm_summary(fam, ["family", "lambda", "name"]).select("family", "lambda", "name", "flat_norm"), "flat_norm")


@query("G20_remove_principal")
def g20_pca(t: Tables) -> DataFrame:
    bank = pinned(directions(t).drop("n"))
    subspace, singular = decompose.bank_subspace(bank, 2)
    _, rest = decompose.project_out(bank, subspace)
    return rounded(vec.norm_summary(rest).select("name", "flat_norm", F.lit(round(singular[0], 6)).alias("first_singular")))


@query(
    "G21_score_maps",
    """WITH h AS (SELECT x.name, y.name AS other, x.layer, x.head, sum(x.v * y.v) AS dot, sqrt(sum(x.v * x.v)) AS nx, sqrt(sum(y.v * y.v)) AS ny FROM dirs x JOIN dirs y USING (layer, head, d) WHERE x.name <> y.name GROUP BY ALL),
    a AS (SELECT name, layer, head, max(nx) AS norm, max(dot / greatest(nx * ny, 1e-12)) AS mc, avg(ny) AS oth FROM h GROUP BY ALL),
    fl AS (SELECT a AS name, avg(cosine) AS fc FROM (SELECT x.name AS a, y.name AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS cosine FROM dirs x JOIN dirs y USING (layer, head, d) WHERE x.name <> y.name GROUP BY ALL) GROUP BY a),
    o AS (SELECT name, layer, head, v, (sum(v) OVER (PARTITION BY layer, head, d) - v) / (count(*) OVER (PARTITION BY layer, head, d) - 1) AS o FROM dirs),
    cn AS (SELECT name, layer, head, sqrt(sum((v - o) * (v - o))) AS contrast_norm FROM o GROUP BY ALL),
    md AS (SELECT name, quantile_cont(score, 0.5) AS md FROM headscore GROUP BY name), sh AS (SELECT layer, head, avg(score) AS shared FROM headscore GROUP BY ALL)
    SELECT name, layer, head, round(norm, 6) AS norm, round(norm * (1 - mc), 6) AS specificity, round(contrast_norm, 6) AS contrast_norm, round(CASE WHEN norm >= md THEN norm / greatest(oth, 1e-12) ELSE 0 END, 6) AS ratio,
      round(norm * greatest(fc - mc, 0), 6) AS hybrid, round(shared, 6) AS shared FROM a JOIN fl USING (name) JOIN cn USING (name, layer, head) JOIN md USING (name) JOIN sh USING (layer, head)""",
)
def g21(t: Tables) -> DataFrame:
    return rounded(vec.score_maps(pinned(directions(t).drop("n"))).drop("random"))


@query("E21_quantile_gate", "SELECT name, layer, head, round(CASE WHEN score >= m THEN score ELSE 0 END, 6) AS gated FROM headscore JOIN (SELECT name, quantile_cont(score, 0.5) AS m FROM headscore GROUP BY name) USING (name)")
def e21(t: Tables) -> DataFrame:
    norms = pinned(vec.head_norms(directions(t)))
    median = rankmetrics.exact_quantiles(norms, ["name"], "score", [0.5])
    gated = F.when(F.col("score") >= F.col("q50"), F.col("score")).otherwise(0.0)
    return norms.join(median, "name").select("name", *H, F.round(gated, 6).alias("gated"))


@query(
    "G22_family_diagnostics",
    """WITH g AS (SELECT layer, head, d, avg(v) AS v FROM dirs GROUP BY ALL),
    gc AS (SELECT x.name, sum(x.v * g.v) / sqrt(sum(x.v * x.v) * sum(g.v * g.v)) AS gc, sqrt(sum(x.v * x.v)) AS fn FROM dirs x JOIN g USING (layer, head, d) GROUP BY x.name),
    q AS (SELECT name, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.9) AS q90, avg(score) AS mean FROM headscore GROUP BY name),
    pc AS (SELECT a, avg(abs(c)) AS mc FROM (SELECT x.name AS a, y.name AS b, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS c FROM dirs x JOIN dirs y USING (layer, head, d) WHERE x.name <> y.name GROUP BY ALL) GROUP BY a)
    SELECT gc.name, round(fn, 6) AS flat_norm, round(mean, 6) AS head_mean, round(q50, 6) AS head_median, round(q90, 6) AS head_p90, round(gc, 6) AS global_cosine, round(mc, 6) AS mean_abs_cosine FROM gc JOIN q USING (name) JOIN pc ON pc.a = gc.name""",
)
def g22(t: Tables) -> DataFrame:
    bank = pinned(directions(t).drop("n"))
    stats = rankmetrics.describe(vec.head_norms(bank), ["name"], "score").select("name", F.col("mean").alias("head_mean"), F.col("q50").alias("head_median"), F.col("q90").alias("head_p90"))
    flat = vec.norm_summary(bank).select("name", "flat_norm")
    centre = vec.mean_vectors(bank.withColumn("g", F.lit("g")), ["g", *H]).select(*H, "vec")
    to_mean = vec.remove_projection(bank, centre)[1].select("name", F.col("raw_cosine").alias("global_cosine"))
    pairs = vec.cosine_matrix(bank).filter("a <> b").groupBy(F.col("a").alias("name")).agg(F.avg(F.abs("cosine")).alias("mean_abs_cosine"))
    return rounded(flat.join(stats, "name").join(to_mean, "name").join(pairs, "name"))


@query(
    "G23_mixture",
    """WITH p AS (SELECT layer, head, d, max(v) FILTER (WHERE name = 'cat') AS a, max(v) FILTER (WHERE name = 'rel') AS b FROM dirs GROUP BY ALL), n AS (SELECT sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM p),
    m AS (SELECT layer, head, d, (a / na + b / nb) / 2 AS m, na, nb FROM p, n), s AS (SELECT sqrt(sum(m * m)) AS s FROM m)
    SELECT layer, head, d, round(m / s * (na + nb) / 2, 6) + 0.0 AS v FROM m, s""",
)
def g23(t: Tables) -> DataFrame:
    bank = pinned(directions(t))
    return items(vec.mixed(bank.filter("name = 'cat'"), bank.filter("name = 'rel'"), "unit_mean"), *H)


@query(
    "G24_alignment",
    """WITH s AS (SELECT d.subtype, d.pair_no, n.name, sum(d.v * n.v) AS dot, sum(d.v * n.v) / sqrt(sum(d.v * d.v) * sum(n.v * n.v)) AS c FROM delta d JOIN dirs n USING (layer, head, d) GROUP BY ALL)
    SELECT subtype, name, count(*) AS n, round(avg(CASE WHEN dot > 0 THEN 1.0 ELSE 0 END), 6) AS positive_rate, round(avg(dot), 6) AS mean_dot, round(avg(c), 6) AS mean_cos FROM s GROUP BY ALL""",
)
def g24(t: Tables) -> DataFrame:
    scores = vec.alignment(t.delta, directions(t), ["subtype", "pair_no"])
    return rounded(vec.alignment_summary(scores, ["subtype", "name"]))


@query(
    "G25_first_token_margin",
    """SELECT vec_id, round(greatest(embedding[4]::DOUBLE, embedding[10]), 6) AS yes_logit, round(greatest(embedding[6]::DOUBLE, embedding[12]), 6) AS no_logit,
       round(greatest(embedding[4]::DOUBLE, embedding[10]) - greatest(embedding[6]::DOUBLE, embedding[12]), 6) + 0.0 AS margin,
       CASE WHEN greatest(embedding[4], embedding[10]) >= greatest(embedding[6], embedding[12]) THEN 'yes' ELSE 'no' END AS prediction FROM embeddings""",
)
def g25(t: Tables) -> DataFrame:
    m = t.embeddings.select("vec_id", v.margin_of(F.col("embedding"), [3, 9], [5, 11]).alias("m")).select("vec_id", "m.*")
    return rounded(m).withColumn("margin", F.col("margin") + F.lit(0.0))


@query(
    "G26_routed_sums",
    """WITH r AS (SELECT e.vec_id, e.label % 4 AS k FROM embeddings e), m AS (SELECT vec_id, unnest(CASE WHEN k = 0 THEN ['cat'] WHEN k = 1 THEN ['cnt', 'rel'] ELSE ['cat', 'cnt', 'col', 'rel'] END) AS name, k FROM r)
    SELECT vec_id, CASE WHEN k = 0 THEN 'cat' WHEN k = 1 THEN 'cnt+rel' ELSE 'cat+cnt+col+rel' END AS route, layer, head, d, round(sum(v), 6) + 0.0 AS v FROM m JOIN dirs USING (name) GROUP BY ALL""",
)
def g26(t: Tables) -> DataFrame:
    k = F.col("label") % 4
    names = lambda *n: F.array(*map(F.lit, n))
    route = F.when(k == 0, names("cat")).when(k == 1, names("cnt", "rel")).otherwise(names("cat", "cnt", "col", "rel"))
    return items(vec.routed_sums(t.embeddings.select("vec_id", "label"), route, directions(t), ["vec_id"]), "vec_id", "route", *H)


@query(
    "D32_condition_sizes",
    """WITH s AS (SELECT subtype, condition, count(DISTINCT pair_no) AS n FROM delta GROUP BY ALL)
    SELECT subtype, CAST(sum(n) AS BIGINT) AS samples, count(*) AS conditions, min(n) AS size_min, round(avg(n), 6) AS size_mean, max(n) AS size_max FROM s GROUP BY subtype""",
)
def d32(t: Tables) -> DataFrame:
    return rounded(vec.condition_sizes(t.delta, ["subtype"], "condition", "pair_no"))


TOPK = "(SELECT name, layer, head FROM headscore QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, layer, head) <= 3)"


@query("E15_ranked_heads", "SELECT name, layer, head, round(score, 6) AS score, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, layer, head) AS rank FROM headscore QUALIFY rank <= 3")
def e15(t: Tables) -> DataFrame:
    return rounded(vec.ranked_heads(vec.head_norms(directions(t)), ["name"], 3))


@query(
    "E16_random_masks",
    f"""WITH h AS (SELECT DISTINCT layer, head FROM dirs), ref AS (SELECT layer, count(*) AS want FROM {TOPK} WHERE name = 'cat' GROUP BY layer)
    SELECT 'random' AS kind, layer, head, row_number() OVER (ORDER BY md5('9|' || layer || '|' || head), layer, head) AS rank FROM h QUALIFY rank <= 3
    UNION ALL SELECT 'layer_matched', layer, head, row_number() OVER (PARTITION BY layer ORDER BY md5('9|' || layer || '|' || head), head) AS rank FROM h JOIN ref USING (layer) QUALIFY rank <= want""",
)
def e16(t: Tables) -> DataFrame:
    bank = pinned(directions(t))
    heads = bank.select(*H).distinct()
    reference = vec.ranked_heads(vec.head_norms(bank.filter("name = 'cat'")), ["name"], 3)
    rnd = ordering.seeded_sample(heads, 9, 3, *H)
    rnd = ordering.top_k(rnd.withColumn("all", F.lit(1)), ["all"], [ordering.seeded_key(9, *H), "layer", "head"], 3)
    matched = vec.layer_matched_mask(heads, reference, 9)
    return rnd.select(F.lit("random").alias("kind"), *H, "rank").unionByName(matched.select(F.lit("layer_matched").alias("kind"), *H, "rank"))


@query(
    "F5_head_overlap",
    f"""WITH m AS {TOPK}, n AS (SELECT name, count(*) AS n FROM m GROUP BY name), i AS (SELECT x.name AS a, y.name AS b, count(*) AS sh FROM m x JOIN m y USING (layer, head) GROUP BY ALL)
    SELECT p.name AS a, q.name AS b, coalesce(sh, 0) AS shared, round(coalesce(sh, 0) / (p.n + q.n - coalesce(sh, 0)), 6) AS jaccard FROM n p, n q LEFT JOIN i ON i.a = p.name AND i.b = q.name""",
)
def f5(t: Tables) -> DataFrame:
    mask = pinned(vec.ranked_heads(vec.head_norms(directions(t)), ["name"], 3))
    return rounded(sets.overlap(mask, "name", H))


@query("F5_head_ownership", f"WITH m AS {TOPK}, o AS (SELECT layer, head, string_agg(name, '+' ORDER BY name) AS owners, count(*) AS n FROM m GROUP BY ALL) SELECT CASE WHEN n = 1 THEN owners || ' only' ELSE owners END AS owners, count(*) AS heads FROM o GROUP BY 1")
def f5_owners(t: Tables) -> DataFrame:
    return sets.ownership(vec.ranked_heads(vec.head_norms(directions(t)), ["name"], 3), "name", H, "heads")


@query("F1_shard_merge", "SELECT vec_id AS row_index, 'p' || vec_id AS pair_id, label FROM embeddings")
def f1(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("row_index"), F.concat(F.lit("p"), "vec_id").alias("pair_id"), "label", F.col("embedding").alias("vec"))
    shards = [validate.shard(e, "row_index", 3, i) for i in range(3)]
    return sets.merged_shards(shards).select("row_index", "pair_id", "label")
