"""Sinks: gated training export, image-annotation datasets, graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_jsonl(records: DataFrame, path: str, allowed: Column, mode: str = "errorifexists") -> None:
    """Records that pass the gate, one JSON object per line; a null verdict keeps a record back."""
    records.where(F.coalesce(allowed, F.lit(False))).write.mode(mode).json(path)


def coco(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """The three frames of an image-annotation dataset with dense ids in order of name.

    images: name, width, height; annotations: image, category, x, y, w, h;
    categories: name.
    """
    from lodestrata.operators.ordered import zrank

    def numbered(df: DataFrame) -> DataFrame:
        ranked = zrank(df.select(F.col("name").alias("member"), F.lit(0).alias("score")).distinct())
        return ranked.select(F.col("member").alias("name"), (F.col("rank") + 1).alias("id"))

    image_ids, category_ids = numbered(images), numbered(categories)
    placed = annotations.join(image_ids.select(F.col("name").alias("image"), F.col("id").alias("image_id")), "image")
    placed = placed.join(category_ids.select(F.col("name").alias("category"), F.col("id").alias("category_id")), "category")
    boxes = placed.select("image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"))
    return {"images": images.join(image_ids, "name").select("id", F.col("name").alias("file_name"), "width", "height"), "annotations": boxes, "categories": category_ids}


def suppress_boxes(boxes: DataFrame, limit: float) -> DataFrame:
    """Boxes (image, id, score, x1, y1, x2, y2) that no better box of their image overlaps by more than the limit.

    One round of suppression: a box goes if any better one covers it.
    """
    from lodestrata.functions.scalars import iou

    corners = F.struct("x1", "y1", "x2", "y2")
    a = boxes.select("image", "id", "score", corners.alias("a"))
    b = boxes.select("image", F.col("id").alias("better"), F.col("score").alias("s2"), corners.alias("b"))
    over = a.join(b, "image").where(((F.col("s2") > F.col("score")) | ((F.col("s2") == F.col("score")) & (F.col("better") < F.col("id")))) & (iou(F.col("a"), F.col("b")) > limit))
    return boxes.join(over.select("image", "id").distinct(), ["image", "id"], "left_anti")
