"""Relation records in three layouts, brought to (image_id, subject, predicate, object)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text

OUT = ("image_id", "subject", "predicate", "object")
SUBJECT = ("subject", "subj", "object_a", "entity1", "from")
PREDICATE = ("predicate", "relation", "rel", "true_relation", "name")
OBJECT = ("object", "obj", "object_b", "entity2", "to")


def _aliased(df: DataFrame, prefix: str, fields: list[str]) -> list:
    def first(names: tuple[str, ...]):
        present = [F.col(f"{prefix}{n}") for n in names if n in fields]
        return text.first_present(*present, default="") if present else F.lit("")

    return [first(SUBJECT).alias("subject"), first(PREDICATE).alias("predicate"), first(OBJECT).alias("object")]


def flatten_relations(graph: DataFrame | None = None, listed: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """Union of the layouts given.

    ``graph(image_id, objects MAP<id, STRUCT<name, relations ARRAY<STRUCT<name, object>>>>)``: references to
    objects of the same record become their names, others stay as they are. ``listed(image_id, relationships
    ARRAY<STRUCT>)`` and ``flat(image_id, ...)`` use alias field names.
    """
    parts = []
    if graph is not None:
        names = F.transform_values("objects", lambda k, o: o["name"])
        each = graph.select("image_id", names.alias("names"), F.explode("objects").alias("id", "o")).select("image_id", "names", F.col("o.name").alias("subject"), F.explode("o.relations").alias("r"))
        parts.append(each.select("image_id", "subject", F.col("r.name").alias("predicate"), F.coalesce(F.col("names")[F.col("r.object")], F.col("r.object")).alias("object")))
    if listed is not None:
        each = listed.select("image_id", F.explode("relationships").alias("r"))
        parts.append(each.select("image_id", *_aliased(each, "r.", each.schema["r"].dataType.names)))
    if flat is not None:
        parts.append(flat.select("image_id", *_aliased(flat, "", flat.columns)))
    return reduce(DataFrame.unionByName, parts).select(*OUT)
