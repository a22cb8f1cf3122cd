"""Subspaces of vector tables: shared/private parts, low-rank denoising, principal directions.

Few vectors (types): the Gram matrix of their dots is an aggregate with types x types cells, its eigenvectors are
coefficients, and applying them is a join with a coefficient table. Many samples: ``RowMatrix.computeSVD``, which
keeps only a few vectors of the model's size outside the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import vectors as v
from pairloom.operators.vectors import HEAD, mean_vectors, unit_rows

MAX_NAMES = 256


def gram(bank: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and matrix of flat dots of a small bank."""
    a = bank.select(F.col("name").alias("a"), *HEAD, F.col("vec").alias("va"))
    b = bank.select(F.col("name").alias("b"), *HEAD, F.col("vec").alias("vb"))
    names = [r[0] for r in bank.select("name").distinct().orderBy("name").limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"a Gram matrix of more than {MAX_NAMES} vectors is not small; use sample_subspace")
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in a.join(b, HEAD).groupBy("a", "b").agg(F.sum(v.dot(F.col("va"), F.col("vb"))).alias("d")).collect():
        out[place[r["a"]], place[r["b"]]] = r["d"]
    return names, out


def bank_subspace(bank: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """First k right singular vectors of a small bank as ``(axis, layer, head, vec)``, with all singular values.

    Each direction is signed so that it has a positive dot with the mean of the bank.
    """
    names, g = gram(bank)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1]
    singular = np.sqrt(np.clip(values[order], 0.0, None))
    rows = []
    for axis in range(min(k, len(names))):
        if singular[axis] <= v.EPS:
            break
        coef = vectors[:, order[axis]] / singular[axis]
        if float(np.ones(len(names)) @ g @ coef) < 0:
            coef = -coef
        rows += [(axis, n, float(c)) for n, c in zip(names, coef)]
    table = bank.sparkSession.createDataFrame(rows, "axis int, name string, coef double")
    weighted = bank.join(table, "name").select("axis", *HEAD, v.scale(F.col("vec"), F.col("coef")).alias("vec"))
    summed = mean_vectors(weighted, ["axis", *HEAD])
    return summed.select("axis", *HEAD, v.scale(F.col("vec"), F.col("n").cast("double")).alias("vec")), [float(s) for s in singular]


def flat_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One flat array per row, heads in (layer, head) order; its length is the size of the model."""
    heads = F.array_sort(F.collect_list(F.struct(*HEAD, "vec")))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(heads, lambda h: h["vec"])).alias("flat"))


def sample_subspace(rows: DataFrame, keys: Sequence[str], heads: int, dim: int, k: int) -> tuple[DataFrame, list[float]]:
    """First k uncentred right singular vectors of all samples as ``(axis, layer, head, vec)``, with singular values."""
    spark = rows.sparkSession
    flat = flat_rows(rows, keys).select("flat")
    # MLlib's distributed SVD takes an RDD of vectors; the samples stay in their partitions.
    svd = RowMatrix(flat.rdd.map(lambda r: Vectors.dense(r[0]))).computeSVD(k, computeU=False)
    directions = svd.V.toArray().T
    rows_out = [(i, [float(x) for x in d]) for i, d in enumerate(directions)]
    from pairloom.operators.vectors import unfold_heads

    table = spark.createDataFrame(rows_out, "axis int, flat array<double>")
    return unfold_heads(table, "flat", heads, dim), [float(s) for s in svd.s]


def project_out(bank: DataFrame, subspace: DataFrame, keys: Sequence[str] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """(projection, residual) of every vector for an orthonormal ``subspace(axis, layer, head, vec)``."""
    keys = list(keys)
    base = bank.select(*keys, *HEAD, "vec")
    axes = subspace.select("axis", *HEAD, F.col("vec").alias("_d"))
    coef = base.join(axes, HEAD).groupBy(*keys, "axis").agg(F.sum(v.dot(F.col("vec"), F.col("_d"))).alias("_c"))
    parts = coef.join(axes, "axis").select(*keys, *HEAD, v.scale(F.col("_d"), F.col("_c")).alias("vec"))
    summed = mean_vectors(parts, [*keys, *HEAD])
    projection = summed.select(*keys, *HEAD, v.scale(F.col("vec"), F.col("n").cast("double")).alias("vec"))
    joined = base.join(projection.withColumnRenamed("vec", "_p"), [*keys, *HEAD])
    return projection, joined.select(*keys, *HEAD, v.sub(F.col("vec"), F.col("_p")).alias("vec"))


def shared_private(deltas: DataFrame, type_col: str, pair: str, method: str = "type_mean_svd", k: int = 1, unit_samples: bool = False, heads: int = 0, dim: int = 0) -> dict[str, DataFrame]:
    """Raw type directions, the shared subspace and the unit residuals.

    ``mean_all``: the shared direction is the mean of all samples. ``type_mean_svd``: the leading right singular
    vectors of the unit type means. ``all_svd``: those of all samples (needs ``heads`` and ``dim``).
    """
    named = deltas.withColumn("name", F.col(type_col))
    rows = unit_rows(named, [pair]) if unit_samples else named
    raw = unit_rows(mean_vectors(rows, ["name", *HEAD]).drop("n"), ["name"])
    if method == "mean_all":
        mean = mean_vectors(rows.withColumn("axis", F.lit(0)), ["axis", *HEAD]).drop("n")
        subspace = unit_rows(mean, ["axis"])
    elif method == "type_mean_svd":
        subspace, _ = bank_subspace(raw, k)
    elif method == "all_svd":
        subspace, _ = sample_subspace(rows, [pair], heads, dim, k)
    else:
        raise ValueError(f"unknown method {method}")
    projection, residual = project_out(raw, subspace)
    return {"raw": raw, "subspace": subspace, "projection": projection, "residual": unit_rows(residual, ["name"])}


def denoised(deltas: DataFrame, pair: str, heads: int, dim: int, k: int, unit_samples: bool = True) -> tuple[DataFrame, list[float]]:
    """Mean of the samples projected on their top-k singular directions, and the share of energy each explains."""
    rows = unit_rows(deltas, [pair]) if unit_samples else deltas
    subspace, singular = sample_subspace(rows, [pair], heads, dim, k)
    mean = mean_vectors(rows.withColumn("name", F.lit("mean")), ["name", *HEAD]).drop("n")
    projection, _ = project_out(mean, subspace)
    total = rows.agg(F.sum(v.sq_norm(F.col("vec")))).first()[0] or 0.0
    return projection, [s * s / total if total > 0 else 0.0 for s in singular]
