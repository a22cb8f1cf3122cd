"""Bootstrap intervals from arrays of replicate weights: no row is copied for a replicate.

Every resampled unit (a row, or a pair with its two scores) draws one Poisson(1) weight a replicate from a hash of its key, as one
array. Group sums of such arrays are combined before the shuffle, so what moves is one array a group and task. Ranking metrics
of all replicates come from one pass over the distinct scores, best first: ranges of the total order are summed, what lies above
a range is added to its running sums, and the replicates are the columns of those sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.ordering import range_count
from pairloom.session import pinned

#: Distinct scores of a range; each carries two arrays of a weight a replicate.
RANGE_SCORES = 20_000
_EULER = 0.5772156649015329


#: Chance of at most k = 0, 1, ... events under Poisson(1), in steps of the 32-bit draws; what is left is finer than the draws.
_CHANCES: list[int] = []
_term, _total = math.exp(-1), 0.0
while 1 - _total > 2.0**-32:
    _total += _term
    _CHANCES.append(math.ceil(_total * 2**32))
    _term /= len(_CHANCES)
# MD5 in columns of 32-bit words: shifts and constants of its 64 steps.
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
#: Messages hashed at once: their words stay in the processor's cache.
LANES = 16384


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """First 8 hex digits, as a number, of the MD5 of each message, given as its one padded block of 64 bytes."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += _SINES[i]
        turned = f << np.uint32(_SHIFTS[i])
        f >>= np.uint32(32 - _SHIFTS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (a + start[0]).byteswap()


def unit_weights(keys: Sequence[str | None], replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (keys, replicates): by inversion at the first 8 hex digits of the MD5 of ``seed|key|replicate``."""
    tails = [f"|{b}".encode() for b in range(replicates)]
    width = max(map(len, tails), default=0) + 1
    tail, size = np.zeros((replicates, width), np.uint8), np.array([len(t) for t in tails], np.int64)
    for b, t in enumerate(tails):
        tail[b, : len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
    heads = [f"{seed}|{k or ''}".encode() for k in keys]
    out = np.empty((len(heads), replicates), np.uint8)
    step = max(1, LANES // max(replicates, 1))
    for at in range(0, len(heads), step):
        part = heads[at : at + step]
        blocks = np.zeros((len(part), replicates, 64), np.uint8)
        for block, head in zip(blocks, part):
            n = len(head)
            if n + width > 56:
                continue
            block[:, :n] = np.frombuffer(head, np.uint8)
            block[:, n : n + width] = tail
            bits = (n + size) * 8
            block[:, 56], block[:, 57] = bits & 255, bits >> 8
        drawn = _first_words(blocks.reshape(-1, 64)).reshape(len(part), replicates)
        for i, head in enumerate(part):
            if len(head) + width > 56:  # more than one block
                drawn[i] = [int(hashlib.md5(head + t).hexdigest()[:8], 16) for t in tails]
        out[at : at + step] = sum((drawn >= np.uint32(c)).view(np.uint8) for c in _CHANCES if c < 2**32)
    return out


def replicate_weights(key: Column, replicates: int, seed: int) -> Column:
    """Array of Poisson(1) weights of the unit ``key``, the same under any partitioning and retry."""

    @F.pandas_udf("array<double>")
    def draw(keys: pd.Series) -> pd.Series:
        return pd.Series(list(unit_weights(keys.where(keys.notna(), None).tolist(), replicates, seed).astype(float)), index=keys.index, dtype=object)

    return draw(key.cast("string"))


def array_total(col: Column) -> Column:
    """Element-wise sum of arrays without negative items as an aggregate; sums of whole numbers are exact."""
    return vector_to_array(Summarizer.normL1(array_to_vector(col)))


def array_sum(col: Column) -> Column:
    """Element-wise sum of arrays as an aggregate: what is above zero less what is below."""
    both = F.concat(F.transform(col, lambda x: F.greatest(x, F.lit(0.0))), F.transform(col, lambda x: F.greatest(-x, F.lit(0.0))))
    parts = F.transform(F.array(array_total(both)), lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), lambda x, y: x - y))
    return F.get(parts, F.lit(0))


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _ends(estimates: Column, name: str) -> list[Column]:
    """Order statistics ``int(q * (B - 1))`` of the estimates that exist."""
    ordered = F.sort_array(F.filter(estimates, lambda x: x.isNotNull()))
    last = F.size(ordered) - 1

    def at(q: float) -> Column:
        return F.when(last >= 0, F.get(ordered, F.floor(last * F.lit(q)).cast("int")))

    return [at(0.025).alias(f"{name}lower_95"), at(0.975).alias(f"{name}upper_95")]


def _quotients(above: Column, below: Column) -> Column:
    return F.zip_with(above, below, lambda a, b: F.when(b > 0, a / b))


#: Groups whose sums a task holds before it gives them out.
HELD_GROUPS = 1000


def _weighted_sums(keys: Sequence[str], replicates: int, seed: int):
    """Sums of the weights and of weight times value for each group of a task's rows ``(keys, _unit, _value)``."""

    def given(held: dict) -> pa.RecordBatch:
        rows = pa.Table.from_batches([h[0] for h in held.values()]).combine_chunks()
        arrays = [rows.column(k).combine_chunks() for k in keys]
        arrays += [pa.array([h[1] for h in held.values()], pa.int64()), pa.array([h[2] for h in held.values()], pa.float64())]
        arrays += [pa.array([h[i].tolist() for h in held.values()], pa.list_(pa.float64())) for i in (3, 4)]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "_n", "_total", "_s", "_w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            codes, units = pd.factorize(np.array(batch.column("_unit").to_pylist(), object), use_na_sentinel=False)
            drawn = unit_weights(units.tolist(), replicates, seed)
            values = batch.column("_value")
            there = np.asarray(values.is_valid())
            value = np.where(there, values.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
            members: dict = {}
            for i, group in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows):
                members.setdefault(repr(group), []).append(i)
            for group, rows in members.items():
                if group not in held:
                    held[group] = [batch.select(list(keys)).slice(rows[0], 1), 0, 0.0, np.zeros(replicates), np.zeros(replicates)]
                sums = held[group]
                for at in range(0, len(rows), LANES):
                    own = np.array(rows[at : at + LANES])
                    w = drawn[codes[own]].astype(float)
                    sums[1] += int(there[own].sum())
                    sums[2] += float(value[own].sum())
                    sums[3] += value[own] @ w
                    sums[4] += there[own].astype(float) @ w
                if len(held) >= HELD_GROUPS:
                    yield given(held)
                    held = {}
        if held:
            yield given(held)

    return run


def bootstrap_interval(df: DataFrame, keys: Sequence[str], value: Column, row_key: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean with a 95% Poisson-bootstrap interval: (keys, mean, lower_95, upper_95). Groups without any weight have none."""
    keys = list(keys)
    rows = df.select(*keys, F.col(row_key).cast("string").alias("_unit"), value.cast("double").alias("_value"))
    shape = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL("_n long, _total double, _s array<double>, _w array<double>").fields])
    # Few bytes mean much work here: as many tasks as a shuffle has, and the rows of a unit, which share their weights, together.
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_unit")
    parts = dealt.mapInArrow(_weighted_sums(keys, replicates, seed), shape)
    n = F.sum("_n")
    sums = parts.groupBy(*keys).agg(F.when(n > 0, F.sum("_total") / n).alias("mean"), array_sum(F.col("_s")).alias("s"), array_total(F.col("_w")).alias("w"))
    return sums.select(*keys, "mean", *_ends(_quotients(F.col("s"), F.col("w")), "")).filter("lower_95 IS NOT NULL")


def _harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + ... + 1/n for whole n, exact up to 20 and by the asymptotic series above."""
    table = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 21))])
    x = np.maximum(n, 21)
    series = np.log(x) + _EULER + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(n <= 20, table[np.minimum(n, 20).astype(int)], series)


def _range_sums(order: str, replicates: int):
    """Numerators of both ranking metrics over one range of one group, given the weights above it."""

    def sums(key: tuple, steps: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values(order, ascending=False)
        w = np.stack(steps["w"].to_numpy())
        start = np.asarray(above["above"].iloc[0], float) if len(above) else np.zeros(2 * replicates)
        before = start + np.cumsum(w, axis=0) - w
        p, m = w[:, :replicates], w[:, replicates:]
        above_p, above_m = before[:, :replicates], before[:, replicates:]
        rows = above_p + above_m
        won = (m * (above_p + p / 2)).sum(axis=0)
        # A run of p positives after h hits and r rows adds p - (r - h) * (H(r + p) - H(r)) to the sum of precisions.
        precision = (p - above_m * (_harmonic(rows + p) - _harmonic(rows))).sum(axis=0)
        return pd.DataFrame({**{f"_k{i}": [k] for i, k in enumerate(key[:-1])}, "sums": [np.concatenate([won, precision, w.sum(axis=0)]).tolist()]})

    return sums


def _running(key: tuple, ranges: pd.DataFrame) -> pd.DataFrame:
    """Weights of all higher ranges for each range of one group."""
    ranges = ranges.sort_values("_range", ascending=False)
    w = np.stack(ranges["w"].to_numpy())
    return ranges.assign(above=list(np.cumsum(w, axis=0) - w)).drop(columns="w")


def pair_intervals(pairs: DataFrame, keys: Sequence[str], pair: str, pos: str = "score_pos", neg: str = "score_neg", replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95% intervals of pairwise accuracy, AUROC and average precision, pairs resampled: ``<metric>_lower_95`` and ``_upper_95``.

    One row a pair with the scores of its two branches; pairs that miss one take no part. A replicate without any pair counts
    for no metric. Scores rank at nine digits, ties count half (AUROC) or positives first (average precision).
    """
    keys, b = list(keys), replicates
    whole = pairs.filter(F.col(pos).isNotNull() & F.col(neg).isNotNull())
    drawn = pinned(whole.select(*keys, F.col(pos).alias("_p"), F.col(neg).alias("_n"), replicate_weights(F.col(pair).cast("string"), b, seed).alias("w")))
    wins = drawn.groupBy(*keys).agg(array_total(F.when(F.col("_p") > F.col("_n"), F.col("w")).otherwise(_zeros(b))).alias("won"), array_total(F.col("w")).alias("all"))
    sides = F.inline(F.array(
        F.struct(F.round("_p", 9).alias("score"), F.concat("w", _zeros(b)).alias("w")), F.struct(F.round("_n", 9).alias("score"), F.concat(_zeros(b), "w").alias("w")),
    ))
    steps = pinned(drawn.select(*keys, sides).groupBy(*keys, "score").agg(array_total(F.col("w")).alias("w")))
    spark = pairs.sparkSession
    parts = max(range_count(0, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-steps.count() // RANGE_SCORES))
    ranged = pinned(steps.repartitionByRange(parts, *keys, "score").withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy(*keys, "_range").agg(array_total(F.col("w")).alias("w"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields if f.name in keys)
    above = per_range.groupBy(*keys).applyInPandas(_running, f"{kept}, _range int, above array<double>")
    named = ", ".join(f"_k{i} {ranged.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    partial = ranged.groupBy(*keys, "_range").cogroup(above.groupBy(*keys, "_range")).applyInPandas(_range_sums("score", b), f"{named}, sums array<double>")
    sums = partial.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]).agg(array_total(F.col("sums")).alias("s"))
    won, precision, p, m = (F.slice("s", 1 + i * b, b) for i in range(4))
    ranked = sums.select(*keys, *_ends(_quotients(won, F.zip_with(p, m, lambda x, y: x * y)), "auroc_"), *_ends(_quotients(precision, p), "average_precision_"))
    accuracy = wins.select(*keys, *_ends(_quotients(F.col("won"), F.col("all")), "pairwise_acc_"))
    return accuracy.join(ranked, keys)
