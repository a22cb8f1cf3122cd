"""Array algebra on ARRAY<DOUBLE|FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def scale(a: Column, factor: Column | float) -> Column:
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return F.transform(a, lambda x: x.cast("double") * f)


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > EPS, x.cast("double") / n).otherwise(F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def axpy(a: Column, factor: Column | float, b: Column) -> Column:
    """a + factor * b."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return F.zip_with(a, b, lambda x, y: x.cast("double") + f * y.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when one side is zero."""
    return ratio_or_zero(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def not_finite(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def text_of(a: Column, digits: int = 6) -> Column:
    """Comma-joined rounded items, for comparing vectors across engines (-0 shows as 0)."""
    return F.array_join(F.transform(a, lambda x: F.format_string("%.6f", F.round(x.cast("double"), digits) + F.lit(0.0))), ",")


def margin_of(logits: Column, yes_ids: list[int], no_ids: list[int]) -> Column:
    """First-token margin: best yes logit minus best no logit, with both and the side they pick."""

    def best(ids: list[int]) -> Column:
        return F.array_max(F.array(*[F.element_at(logits, i + 1) for i in ids])).cast("double")

    margin = best(yes_ids) - best(no_ids)
    return F.struct(
        best(yes_ids).alias("yes_logit"),
        best(no_ids).alias("no_logit"),
        margin.alias("margin"),
        F.when(margin >= 0, "yes").otherwise("no").alias("prediction"),
    )
