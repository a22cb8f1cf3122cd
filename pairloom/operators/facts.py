"""From annotations to objects, counts, relations and atomic facts.

Tables: ``annotations(image_id, annotation_id, category, box STRUCT<x,y,w,h>, crowd, color)`` and
``images(image_id, width, height)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import geometry as geo
from pairloom.operators.ordering import dealt, global_rank
from pairloom.session import pinned

# Objects of one image that are paired within one task; larger images are paired block by block.
BLOCK = 2000


def objects(images: DataFrame, annotations: DataFrame, min_area: float = 0.01) -> DataFrame:
    """Objects large enough to count, keyed ``{image}_{annotation}``."""
    sized = annotations.join(images.select("image_id", "width", "height"), "image_id")
    ratio = geo.area_ratio(F.col("box.w"), F.col("box.h"), F.col("width"), F.col("height"))
    return (
        sized.withColumn("area_ratio", ratio)
        .filter(F.col("area_ratio") >= min_area)
        .withColumn("object_id", F.concat_ws("_", "image_id", "annotation_id"))
    )


def hygiene_reason(mode: str = "strict", known: Column | None = None) -> Column:
    """Why an annotation is dropped; null when it is kept.

    ``basic`` looks at category, crowd flag and box; ``strict`` also at the share of the image.
    """
    out = F.when(~(known if known is not None else F.col("category").isNotNull()), "unknown_category")
    out = out.when(F.col("crowd"), "crowd")
    out = out.when(F.col("box").isNull() | (F.col("box.w") <= 1.0) | (F.col("box.h") <= 1.0), "invalid_bbox")
    if mode == "strict":
        ratio = geo.area_ratio(F.col("box.w"), F.col("box.h"), F.col("width"), F.col("height"))
        out = out.when(ratio <= 0.005, "too_small").when(ratio >= 0.5, "too_large")
    return out


def category_counts(objs: DataFrame, name: str = "category") -> DataFrame:
    return objs.groupBy("image_id", name).agg(F.count("*").alias("n"))


def count_maps(counts: DataFrame, name: str = "category") -> DataFrame:
    """One row per image with ``counts MAP<category, n>``; its size is bounded by the vocabulary."""
    entries = F.sort_array(F.collect_list(F.struct(name, "n")))
    return counts.groupBy("image_id").agg(F.map_from_entries(entries).alias("counts"))


def oversized(objs: DataFrame) -> DataFrame:
    """``(image_id, _n)`` of the images with more than ``BLOCK`` objects."""
    return objs.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)


def paired(
    objs: DataFrame,
    match: Callable[[Column, Column], Column],
    columns: list[str],
    ordered: bool = False,
    key: str = "annotation_id",
) -> DataFrame:
    """Self join inside each image on ``match(a, b)``, with structs ``a`` and ``b`` of ``columns``.

    Unordered pairs have ``a.key < b.key``; ordered pairs every ``a.key <> b.key``. The predicate is part
    of the join, so pairs that fail it are never materialised. Usually no image has more than ``BLOCK``
    objects, and one shuffle by image serves both sides. Larger images are cut into blocks, and each pair of
    blocks becomes its own join key, which spreads an image over tasks.
    """
    fields = list(dict.fromkeys([key, *columns]))
    sizes = oversized(objs)
    a, b = F.col("a"), F.col("b")
    order = a[key] != b[key] if ordered else a[key] < b[key]
    # One job tells the largest image and how many objects there are to deal out.
    most, rows = objs.groupBy("image_id").agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if most <= BLOCK:
        left = dealt(objs.select("image_id", F.struct(*fields).alias("a")), rows, "image_id")
        right = dealt(objs.select(F.col("image_id").alias("_image"), F.struct(*fields).alias("b")), rows, "_image")
        return left.join(right, (F.col("image_id") == F.col("_image")) & order & match(a, b)).select("image_id", "a", "b")

    blocks = sizes.select("image_id", F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("_blocks"))
    base = (
        objs.join(blocks, "image_id", "left")
        .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        .withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    )

    def side(name: str) -> DataFrame:
        spread = base.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        return spread.select("image_id", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), F.struct(*fields, "_block").alias(name))

    left, right = side("a"), side("b").withColumnsRenamed({"image_id": "_image", "_lo": "_lo2", "_hi": "_hi2"})
    # Two objects of different blocks meet once; two of the same block only where both ends name that block.
    once = (F.col("_lo") == F.col("_hi")) | (a["_block"] != b["_block"])
    keys = (F.col("image_id") == F.col("_image")) & (F.col("_lo") == F.col("_lo2")) & (F.col("_hi") == F.col("_hi2"))
    return left.join(right, keys & once & order & match(a, b)).select("image_id", "a", "b")


def relations(objs: DataFrame, dx: float = 0.75, dy: float = 1.0, max_iou: float = 0.1) -> DataFrame:
    """At most one spatial relation per unordered object pair of an image."""
    pairs = paired(objs, lambda a, b: F.lit(True), ["annotation_id", "object_id", "category", "box"])
    # Overlap and offsets become columns, computed once per pair; pairs without a relation end in this same stage.
    measured = pairs.select(
        "image_id",
        F.col("a.annotation_id").alias("subject_ann"),
        F.col("b.annotation_id").alias("object_ann"),
        F.col("a.object_id").alias("subject_id"),
        F.col("b.object_id").alias("object_id"),
        F.col("a.category").alias("subject_category"),
        F.col("b.category").alias("object_category"),
        geo.norm_dx(F.col("a.box"), F.col("b.box")).alias("dx"),
        geo.norm_dy(F.col("a.box"), F.col("b.box")).alias("dy"),
        geo.iou(F.col("a.box"), F.col("b.box")).alias("iou"),
    )
    return some(measured, geo.relation_of_offsets(F.col("iou"), F.col("dx"), F.col("dy"), dx, dy, max_iou), "predicate")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once a row, however often it is read: a generator, as in :func:`some`, but nulls stay."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def some(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column and keep the rows where it is not null.

    A generator instead of a filter: the optimizer would copy a long expression into the pushed-down filter.
    """
    return df.select("*", F.explode(F.array_compact(F.array(value))).alias(name))


def numbered_relations(objs: DataFrame, **thresholds: float) -> DataFrame:
    """Relations with their 1-based index in the image, in pair order.

    Without an oversized image a window by image is bounded by the block size. Otherwise the relations, the dear
    part, are written once and ranked over ranges.
    """
    rels = relations(objs, **thresholds)
    if not oversized(objs).limit(1).count():
        order = Window.partitionBy("image_id").orderBy("subject_ann", "object_ann")
        return rels.withColumn("rel_index", F.row_number().over(order).cast("long"))
    return global_rank(pinned(rels), ["image_id"], ["subject_ann", "object_ann"], "rel_index")


def atomic_facts(objs: DataFrame, counts: DataFrame, rels: DataFrame) -> DataFrame:
    """cat and col facts per object, cnt facts per category, rel facts per numbered relation."""
    none = F.lit(None)

    def shape(df: DataFrame, subtype: str, tail: Column, **cols: Column) -> DataFrame:
        typed = {
            "subject_id": "string", "subject_category": "string", "object_id": "string", "object_category": "string",
            "positive_value": "string", "positive_int": "int", "annotation_id": "long", "area_ratio": "double",
        }
        return df.select(
            F.concat_ws("_", F.lit("coco"), "image_id", F.lit(subtype), tail).alias("fact_id"),
            "image_id",
            F.lit(subtype).alias("subtype"),
            *[cols.get(c, none).cast(t).alias(c) for c, t in typed.items()],
        )

    ann = F.col("annotation_id")
    both = {"subject_id": F.col("object_id"), "subject_category": F.col("category"), "annotation_id": ann}
    cat = shape(objs, "cat", ann, positive_value=F.col("category"), area_ratio=F.col("area_ratio"), **both)
    col = shape(objs, "col", ann, positive_value=F.col("color"), **both)
    cnt = shape(
        counts, "cnt", F.col("category"),
        subject_id=F.concat_ws("_count_", "image_id", "category"), subject_category=F.col("category"),
        positive_value=F.col("n").cast("string"), positive_int=F.col("n"),
    )
    rel = shape(
        rels, "rel", F.col("rel_index"), subject_id=F.col("subject_id"), subject_category=F.col("subject_category"),
        object_id=F.col("object_id"), object_category=F.col("object_category"), positive_value=F.col("predicate"),
    )
    return cat.unionByName(col).unionByName(cnt).unionByName(rel)


def representatives(annotations: DataFrame) -> DataFrame:
    """One annotation per (image, category): unique instances if the image has two of them, else the largest.

    Ties in area go to the lower annotation id.
    """
    keys = ["image_id", "category"]
    fields = [c for c in annotations.columns if c not in keys]
    # The best annotation and their number from one aggregate; a window by image then has one row a category.
    order = F.struct((-F.col("box.w") * F.col("box.h")).alias("o"), F.col("annotation_id"))
    named = annotations.filter(F.col("image_id").isNotNull() & F.col("category").isNotNull())
    best = named.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_best"), F.count("*").alias("n"))
    uniques = F.count_if(F.col("n") == 1).over(Window.partitionBy("image_id"))
    shown = best.withColumn("uniques", uniques).filter((F.col("uniques") < 2) | (F.col("n") == 1))
    return shown.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in fields], "n", "uniques")


def best_segment(annotations: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment of the same image and category that fits each annotation best.

    ``annotations(image_id, annotation_id, category, box, area, segment_id?)``,
    ``segments(image_id, category, segment_id, box, area, pos)``. An explicit id that exists wins, then
    the score, then the earlier segment.
    """
    explicit = F.col("a.segment_id") == F.col("s.segment_id") if "segment_id" in annotations.columns else F.lit(False)
    score = geo.match_score(F.col("a.box"), F.col("s.box"), F.col("a.area"), F.col("s.area"))
    joined = annotations.alias("a").join(segments.alias("s"), (F.col("a.image_id") == F.col("s.image_id")) & (F.col("a.category") == F.col("s.category")))
    rank = F.struct(F.when(F.coalesce(explicit, F.lit(False)), 1).otherwise(0), score, -F.col("s.pos"))
    return joined.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.annotation_id").alias("annotation_id")).agg(
        F.max_by("s.segment_id", rank).alias("segment_id"), F.max(score).alias("score")
    )


def segment_colors(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Colour token of every segment from ``pixels(image_id, pos, r, g, b)`` and ``mask(image_id, pos, segment_id)``.

    An image whose raster and mask differ in size has no colours.
    """
    area = pixels.groupBy("image_id").agg(F.count("*").alias("np"))
    cover = mask.groupBy("image_id").agg(F.count("*").alias("nm"))
    same = area.join(cover, "image_id").filter(F.col("np") == F.col("nm")).select("image_id")
    sums = (
        mask.join(pixels, ["image_id", "pos"]).groupBy("image_id", "segment_id")
        .agg(*[F.avg(c).alias(c) for c in "rgb"]).join(same, "image_id", "left_semi")
    )
    return sums.withColumn("color", geo.color_of(F.col("r"), F.col("g"), F.col("b")))


def raster_blocks(pixels: DataFrame, size: int = 4096) -> DataFrame:
    """``pixels(image_id, pos, r, g, b)``, pos from 0 without gaps, as blocks ``(image_id, block, r, g, b)`` of ``size`` pixels in arrays."""
    rows = pixels.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    blocks = rows.groupBy("image_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "r", "g", "b"))).alias("_px"))
    return blocks.select("image_id", "block", *[F.col(f"_px.{c}").alias(c) for c in "rgb"])


def mask_runs(mask: DataFrame) -> DataFrame:
    """``mask(image_id, pos, segment_id)`` as runs ``(image_id, segment_id, first, n)`` of consecutive pixels of one segment."""
    of_segment = Window.partitionBy("image_id", "segment_id").orderBy("pos")
    island = mask.withColumn("_i", F.col("pos") - F.row_number().over(of_segment))
    return island.groupBy("image_id", "segment_id", "_i").agg(F.min("pos").alias("first"), F.count("*").alias("n")).drop("_i")


def run_colors(blocks: DataFrame, runs: DataFrame, size: int = 4096) -> DataFrame:
    """Mean colour, pixels and colour token of every segment, from raster blocks and run-length masks.

    A run is cut at the borders of the blocks it covers and meets them by (image, block): rows are joined by runs and blocks, not by
    pixels, and a run's part of a block is one slice of it. Images whose mask covers another number of pixels than the raster have no colours.
    """
    end = F.col("first") + F.col("n")
    covered = F.sequence(F.floor(F.col("first") / size).cast("long"), F.floor((end - 1) / size).cast("long"))
    cut = runs.filter("n > 0").select("image_id", "segment_id", "first", "n", F.explode(covered).alias("block"))
    low = F.greatest(F.col("first") - F.col("block") * size, F.lit(0))
    high = F.least(F.col("first") + F.col("n") - F.col("block") * size, F.lit(size))
    joined = cut.select("image_id", "segment_id", "block", low.cast("int").alias("_low"), (high - low).cast("int").alias("_n")).join(blocks, ["image_id", "block"])

    def total(c: str) -> Column:
        return F.aggregate(F.slice(c, F.col("_low") + 1, F.col("_n")), F.lit(0.0), lambda a, x: a + x.cast("double"))

    pixels = F.sum(F.size(F.slice("r", F.col("_low") + 1, F.col("_n"))))
    sums = joined.groupBy("image_id", "segment_id").agg(pixels.cast("long").alias("pixels"), *[(F.sum(total(c)) / pixels).alias(c) for c in "rgb"])
    raster = blocks.groupBy("image_id").agg(F.sum(F.size("r")).alias("_raster"))
    masked = runs.groupBy("image_id").agg(F.sum("n").alias("_mask"))
    same = raster.join(masked, "image_id").filter("_raster = _mask").select("image_id")
    return sums.join(same, "image_id", "left_semi").withColumn("color", geo.color_of(F.col("r"), F.col("g"), F.col("b")))
