"""Approximate nearest neighbours: a robust-pruned directed graph in every shard, searched by beams.

Different vectors are dealt to shards by hash. In a shard they are inserted in batches: a greedy search from the entry point
proposes neighbours, and pruning keeps a neighbour only if no kept one is closer to it by the factor ALPHA, which leaves short and
long edges; reverse edges are added and pruned alike. A query is searched in every shard. Inner products are turned into distances
by one more coordinate (sqrt(M^2 - |x|^2), M the greatest length), so that the nearest vector has the largest product. What the
beams return is scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import parallelism
from pairloom.session import pinned

#: Vectors of a shard: what a task builds and holds.
SHARD_ROWS = 16_384
DEGREE, SLACK = 28, 44
ALPHA = 1.2
BEAM_BUILD, BEAM_SEARCH = 56, 96
STEP = 4
BATCH = 256


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest ids (queries x beam), -1 where fewer; ids expanded on the way). Distances: |x|^2 - 2 x.q."""
    n, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], dist[:, 0], seen[:, start] = start, norms[start] - 2 * (q @ x[start]), True
    expanded = []
    while True:
        open_ = ~done & (ids >= 0)
        if not open_.any():
            break
        order = np.cumsum(open_, axis=1)
        chosen = open_ & (order <= STEP)
        done |= chosen
        slot = np.full((n, STEP), -1)
        at = np.nonzero(chosen)
        slot[at[0], order[at] - 1] = ids[at]
        expanded.append(slot)
        fresh = []
        for e in range(STEP):
            near = np.where(slot[:, e : e + 1] >= 0, graph[slot[:, e]], -1)
            new = (near >= 0) & ~seen[rows, near]
            near = np.where(new, near, -1)
            hit = np.nonzero(new)
            seen[hit[0], near[hit]] = True
            fresh.append(near)
        near = np.concatenate(fresh, axis=1)
        hit = np.nonzero(near >= 0)
        d = np.full(near.shape, np.inf, np.float32)
        who = near[hit]
        d[hit] = norms[who] - 2 * np.einsum("ij,ij->i", x[who], q[hit[0]])
        ids, dist, done = np.concatenate([ids, near], axis=1), np.concatenate([dist, d], axis=1), np.concatenate([done, np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(dist, best, 1), axis=1), 1)
        ids, dist, done = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1), np.take_along_axis(done, best, 1)
        ids[np.isinf(dist)] = -1
    return ids, np.concatenate(expanded, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours (points x DEGREE, -1 where fewer) out of candidates (points x C, -1 where none)."""
    cand = np.sort(np.where(cand == points[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    own = ((v - x[points][:, None, :]) ** 2).sum(axis=2)
    own[cand < 0] = np.inf
    order = np.argsort(own, axis=1)
    cand, own, v = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    alive, out, rows = np.isfinite(own), np.full((len(points), DEGREE), -1), np.arange(len(points))
    sq = (v**2).sum(axis=2)
    for r in range(DEGREE):
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, r] = cand[rows, first][has]
        between = sq + sq[rows, first][:, None] - 2 * np.einsum("ncd,nd->nc", v, v[rows, first])
        alive &= ALPHA**2 * between > own
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(neighbours (n x SLACK, -1 where fewer), entry point) of different vectors."""
    n, norms = len(x), (x**2).sum(axis=1)
    graph, degree = np.full((n, SLACK), -1), np.zeros(n, np.int64)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        p = order[at : at + size]
        at, size = at + size, min(BATCH, 2 * size, max(1, (1 << 26) // n))
        ids, expanded = beam_search(x, norms, graph, start, x[p], BEAM_BUILD)
        # points inserted together do not see each other in the search; they propose themselves to each other by rank
        out = robust_prune(x, p, np.concatenate([ids, expanded], axis=1))
        graph[p, :DEGREE], degree[p] = out, (out >= 0).sum(axis=1)
        src, k = np.nonzero(out >= 0)
        to, back = out[src, k], p[src]
        sort = np.argsort(to, kind="stable")
        to, back = to[sort], back[sort]
        head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        count = np.diff(np.append(head, len(to)))
        place = np.arange(len(to)) - np.repeat(head, count) + degree[to]
        fits = np.repeat(degree[to[head]] + count <= SLACK, count)
        graph[to[fits], place[fits]] = back[fits]
        degree[to[head]] += np.where(degree[to[head]] + count <= SLACK, count, 0)
        full = np.flatnonzero(degree[to[head]] + count > SLACK) if len(head) else []
        full = [g for g in full if not fits[head[g]]]
        for some in np.array_split(sorted(full, key=lambda g: count[g]), max(1, -(-len(full) // BATCH))):
            if not len(some):
                continue
            nodes, width = to[head[some]], int(count[some].max())
            cand = np.full((len(some), SLACK + width), -1)
            cand[:, :SLACK] = graph[nodes]
            for i, g in enumerate(some):
                cand[i, SLACK : SLACK + count[g]] = back[head[g] : head[g] + count[g]]
            kept = robust_prune(x, nodes, cand)
            graph[nodes], degree[nodes] = -1, (kept >= 0).sum(axis=1)
            graph[nodes, :DEGREE] = kept
    return graph, start


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without null ids and vectors that are null, zero or hold null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter("embedding is not null and vec_id is not null").filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))


def build(vectors: DataFrame, ids_a_vector: int = 21, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, vec) -> index (shard, node, vec, ids, near, start, most). Equal vectors are one node, which lists the
    ``ids_a_vector`` smallest of its ids: as ties go to the smaller id, no search for fewer neighbours can return others."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = vectors.withColumn("_r", place).filter(F.col("_r") <= ids_a_vector)
    nodes = pinned(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).alias("most"), F.max(F.size("vec")).alias("width")).first()
    shards, most, width = max(1, -(-facts["n"] // shard_rows)), facts["most"] or 0.0, facts["width"] or 0

    def graphs(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, start = build_graph(lifted(pdf["vec"], width, most))
        near = [g[g >= 0].tolist() for g in graph]
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf)), "vec": pdf["vec"], "ids": pdf["ids"], "near": near, "start": start, "most": most})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(graphs, "shard int, node long, vec array<double>, ids array<long>, near array<long>, start long, most double")


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m = min(width, len(v))
        out[i, :m] = v[:m]
    return out


def lifted(vectors: pd.Series, width: int, most: float) -> np.ndarray:
    x = _padded(vectors, width)
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(axis=1, keepdims=True), 0))]).astype(np.float32)


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM_SEARCH) -> DataFrame:
    """index of :func:`build` and queries (vec_id, vec) -> (query_id, rank, vec_id, score): k nearest found with another id."""
    index = pinned(index)
    shards = [r["shard"] for r in index.select("shard").distinct().collect()]  # one number a shard
    shape = "query_id long, rank int, vec_id long, score double"
    if not shards:
        return index.sparkSession.createDataFrame([], shape)

    def answers(nodes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, nodes["vec"]))
        own, most = _padded(nodes["vec"], width), float(nodes["most"].iloc[0])
        x, graph = lifted(nodes["vec"], width, most), np.full((len(nodes), SLACK), -1)
        for i, g in enumerate(nodes["near"]):
            graph[i, : len(g)] = g
        norms, start, ids = (x**2).sum(axis=1), int(nodes["start"].iloc[0]), nodes["ids"].tolist()
        out = []
        size = max(1, min(BATCH, (1 << 26) // len(x)))
        for a in range(0, len(asked), size):
            part = asked.iloc[a : a + size]
            q = _padded(part["vec"], width)
            found, _ = beam_search(x, norms, graph, start, np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), max(beam, k + 1))
            for qid, v, near in zip(part["vec_id"], q, found):
                near = near[near >= 0]
                scores = own[near] @ v
                hits = [(-s, i) for node, s in zip(near, scores) for i in ids[node] if i != qid]
                out += [(qid, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, nodes, whole = None, [], None
        for pdf in batches:
            for (shard, asks), part in pdf.groupby(["shard", "asks"], sort=False):
                if shard != at:
                    at, nodes, whole = shard, [], None
                if not asks:
                    nodes.append(part)
                    continue
                whole = pd.concat(nodes).sort_values("node", ignore_index=True) if whole is None else whole
                yield answers(whole, part)

    n = parallelism(index.sparkSession)
    rows = index.withColumns({"asks": F.lit(0), "vec_id": F.lit(None).cast("long")})
    empty = {c: F.lit(None).cast(index.schema[c].dataType) for c in ("node", "ids", "near", "start", "most")}
    asked = queries.select("vec_id", "vec", F.explode(F.array(*map(F.lit, shards))).alias("shard"), F.lit(1).alias("asks")).withColumns(empty)
    hits = rows.unionByName(asked).repartition(n, "shard").sortWithinPartitions("shard", "asks").mapInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(vec_id, embedding, ...) -> the k nearest of every row whose id is divisible by ``every``, over all rows with another id.
    An id that repeats is asked once, with the vector that comes first by its components."""
    rows = pinned(sound_vectors(vectors))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return search(build(rows, k + 1), asked, k)
