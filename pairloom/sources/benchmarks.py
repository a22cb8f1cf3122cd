"""Benchmark rows in one shape, whatever their field names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators.ordering import top_k
from pairloom.operators.validate import ValidationError

# Alias fields, first present one wins.
ALIASES = {
    "sample_id": ("sample_id", "question_id", "id"),
    "image_id": ("image_id", "id", "coco_id"),
    "image_path": ("image_path", "image", "img", "file_name"),
    "question": ("question", "query", "prompt", "text"),
    "answer": ("answer", "label", "gt_answer", "ground_truth", "target"),
}


def alias(df: DataFrame, names: Sequence[str], default: str | None = "") -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return text.first_present(*present, default=default) if present else F.lit(default)


def normalize_samples(df: DataFrame, label_mode: str = "words", strict: bool = False) -> DataFrame:
    """``(sample_id, image_id, image_path, question, label)``. With ``strict`` a missing question fails the job."""
    out = df.select(
        alias(df, ALIASES["sample_id"]).alias("sample_id"), alias(df, ALIASES["image_id"]).alias("image_id"), alias(df, ALIASES["image_path"]).alias("image_path"),
        alias(df, ALIASES["question"]).alias("question"), text.yes_no(alias(df, ALIASES["answer"]), label_mode).alias("label"),
    )
    if strict and out.filter("question = ''").limit(1).count():
        raise ValidationError("a benchmark row has no question")
    return out


def load_benchmarks(parts: Mapping[tuple[str, str], DataFrame], limit: int = 0, unlabeled: str = "skip") -> DataFrame:
    """Samples of several (dataset, setting) tables; ``limit`` keeps the first so many ids of each.

    Rows without a yes/no label are skipped, or with ``unlabeled="error"`` fail the job.
    """
    tagged = [normalize_samples(df).withColumns({"dataset": F.lit(d), "setting": F.lit(s)}) for (d, s), df in parts.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    if unlabeled == "error" and rows.filter("label is null").limit(1).count():
        raise ValidationError("a benchmark row has no yes/no label")
    rows = rows.filter("label is not null")
    return top_k(rows, ["dataset", "setting"], ["sample_id"], limit).drop("rank") if limit else rows


def manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "setting", "label").agg(F.count("*").alias("n"))
