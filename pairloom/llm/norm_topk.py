"""Exact top-k inner products by norm buckets.

Vectors are grouped by length. Every query first meets the longest bucket, whose k-th best score is a lower bound of its final one.
With it, a query skips every bucket whose longest vector cannot reach the bound; in the others the bound becomes a cosine threshold
for the bucket, which decides between coordinate pruning (ranges of the query's largest coordinates) and length pruning (the
bucket's longest vectors only). Survivors are verified by their exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import parallelism
from pairloom.session import pinned

#: Length buckets, and the vectors that a task holds of one.
BUCKETS = 32
SHARD_ROWS = 32_768
#: From this cosine threshold on the ranges of coordinates are narrow enough to prune.
COORDINATE_FROM = 0.3
FOCUS = 4
_EXACT = float(1 << 52)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, vec array<long>, norm double): floor(scale * x) of every component, as double.

    Rows with a null vector, null id, or a null or non-finite component are left out. A vector shorter than others counts as
    padded with zeros.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Shard:
    """A part of a bucket, longest vectors first."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, norm: np.ndarray):
        order = np.lexsort((ids, -norm))
        self.ids, self.vec, self.norm = ids[order], vec[order], norm[order]
        self.most = float(self.norm[0])
        self.unit = self.vec / np.maximum(self.norm, 1e-300)[:, None]
        self.peak = float(np.abs(self.vec).max(initial=0))
        self.float = self.vec.astype(np.float64)

    def best(self, qid: int, q: np.ndarray, qnorm: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score) of this shard with a score of ``bound`` or more."""
        keep = slice(0, len(self.ids))
        if np.isfinite(bound) and bound > 0 and qnorm > 0:
            if qnorm * self.most * (1 + 1e-9) < bound:
                return self.ids[:0], self.ids[:0]
            cosine = bound / (qnorm * self.most)
            if cosine >= COORDINATE_FROM:
                # a unit vector p with p.q >= c has p_f within q_f * c -+ sqrt((1 - c^2)(1 - q_f^2)) or beyond towards q_f
                unit = q / qnorm
                c = min(1.0, cosine) - 1e-9
                held = np.ones(len(self.ids), bool)
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    reach = np.sqrt((1 - c * c) * (1 - unit[f] ** 2)) + 1e-9
                    low = unit[f] * c - reach if unit[f] > -c else -1.0 - 1e-9
                    high = unit[f] * c + reach if unit[f] < c else 1.0 + 1e-9
                    held &= (self.unit[:, f] >= low) & (self.unit[:, f] <= high)
                keep = np.flatnonzero(held)
            else:
                keep = slice(0, int(np.searchsorted(-self.norm, -bound / (qnorm * (1 + 1e-9)), side="right")))
        ids = self.ids[keep]
        exact = self.peak * np.abs(q).max(initial=0) * len(q) < _EXACT
        scores = np.rint(self.float[keep] @ q.astype(np.float64)).astype(np.int64) if exact else self.vec[keep] @ q
        alive = ids != qid
        if np.isfinite(bound):
            alive &= scores >= bound
        ids, scores = ids[alive], scores[alive]
        if len(ids) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _meet(shards: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """Rows of shards (bucket, shard, vec_id, vec, norm) and queries at shards (bucket, shard, qid, vec, norm, bound) -> scores.

    Both lie in the same partition, sorted so that a shard comes before its queries; a task holds one shard and one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, shard = None, [], None
        for pdf in batches:
            if not len(pdf):
                continue
            ids, vec, norm = pdf["id"].to_numpy(), _matrix(pdf["vec"], width), pdf["norm"].to_numpy()
            keys, asks, bounds = list(zip(pdf["bucket"], pdf["shard"])), pdf["asks"].to_numpy(), pdf["bound"].to_numpy()
            cut = [0, *(i for i in range(1, len(pdf)) if keys[i] != keys[i - 1] or asks[i] != asks[i - 1]), len(pdf)]
            out = []
            for a, b in zip(cut, cut[1:]):
                if keys[a] != at:
                    at, held, shard = keys[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], vec[a:b], norm[a:b]))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = _Shard(*(np.concatenate(x) for x in zip(*held))), []
                for i in range(a, b):
                    got, scores = shard.best(int(ids[i]), vec[i], float(norm[i]), float(bounds[i]), k)
                    out.append(pd.DataFrame({"query_id": np.full(len(got), ids[i]), "vec_id": got, "score": scores}))
            if out:
                yield pd.concat(out)

    lowest = F.lit(float("-inf"))
    rows = shards.select("bucket", "shard", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "vec", "norm", lowest.alias("bound"))
    rows = rows.unionByName(queries.select("bucket", "shard", F.lit(1).alias("asks"), F.col("qid").alias("id"), "vec", "norm", "bound"))
    n = parallelism(shards.sparkSession)
    return rows.repartition(n, "bucket", "shard").sortWithinPartitions("bucket", "shard", "asks").mapInPandas(run, "query_id long, vec_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Vectors and queries (vec_id, vec, norm) -> (query_id, rank, vec_id, score): the k largest inner products with rows of another
    id, ties to the smaller id; all, if there are fewer."""
    vectors, queries = pinned(vectors), pinned(queries)
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10000).alias("borders")).first()
    width = facts["width"] or 0
    borders = sorted(set(facts["borders"] or []), reverse=True)
    # bucket 0 holds the longest vectors; vectors of equal length share one, whose shards split it
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b >= F.col("norm"))) if borders else F.lit(0)
    placed = vectors.withColumn("bucket", bucket.cast("int"))
    sizes = {r["bucket"]: (r["n"], r["most"]) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = {b: -(-n // SHARD_ROWS) for b, (n, _) in sizes.items()}
    # one row a bucket, 32 at most
    layout = F.create_map(*[F.lit(x) for b in shards for x in (b, shards[b])])
    placed = pinned(placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), layout[F.col("bucket")]).cast("int")))
    first = min(sizes)
    asked = queries.withColumnRenamed("vec_id", "qid")

    def at(rows: DataFrame, buckets: list[int]) -> DataFrame:
        places = [F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("shard"), F.lit(float(sizes[b][1])).alias("most")) for b in buckets for s in range(shards[b])]
        return rows.withColumn("_p", F.explode(F.array(*places))).select("qid", "vec", "norm", "bound", "_p.*")

    seeds = pinned(_ranked(_meet(placed.filter(F.col("bucket") == first), at(asked.withColumn("bound", F.lit(float("-inf"))), [first]), k, width), k))
    others = sorted(set(sizes) - {first})
    if not others:
        return seeds.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    bound = seeds.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound"))
    bounded = asked.join(bound, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    reach = at(bounded, others).filter((F.col("bound") <= 0) | (F.col("norm") * F.col("most") * (1 + 1e-9) >= F.col("bound")))
    rest = _meet(placed.filter(F.col("bucket") != first), reach, k, width)
    best = _ranked(rest.unionByName(seeds.select("query_id", "vec_id", "score")), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding, ...) -> the k best of every row whose id is divisible by ``every``. Rows that repeat an id are candidates
    one by one; as queries their best are listed once an id, from the vector that comes first by its components."""
    rows = pinned(integer_vectors(vectors, scale))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "norm")).alias("m")).select("vec_id", "m.vec", "m.norm")
    return top_k(rows, asked, k)
