"""The geometry of boxes as SQL functions: bodies are SQL, so the optimizer inlines them like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

#: name -> (parameters, type of the result, body); a body may use the functions before it.
FUNCTIONS = {
    "box_of": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", BOX, "named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)"),
    "box_width": (f"b {BOX}", "DOUBLE", "greatest(0D, b.x2 - b.x1)"),
    "box_height": (f"b {BOX}", "DOUBLE", "greatest(0D, b.y2 - b.y1)"),
    "box_area": (f"b {BOX}", "DOUBLE", "box_width(b) * box_height(b)"),
    "box_intersection": (f"a {BOX}, b {BOX}", "DOUBLE", "greatest(0D, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0D, least(a.y2, b.y2) - greatest(a.y1, b.y1))"),
    "box_iou": (f"a {BOX}, b {BOX}", "DOUBLE", "coalesce(box_intersection(a, b) / nullif(box_area(a) + box_area(b) - box_intersection(a, b), 0D), 0D)"),
    "box_iomin": (f"a {BOX}, b {BOX}", "DOUBLE", "coalesce(box_intersection(a, b) / nullif(least(box_area(a), box_area(b)), 0D), 0D)"),
    "box_union": (f"a {BOX}, b {BOX}", BOX, "box_of(least(a.x1, b.x1), least(a.y1, b.y1), greatest(a.x2, b.x2), greatest(a.y2, b.y2))"),
    "box_translate": (f"b {BOX}, dx DOUBLE, dy DOUBLE", BOX, "box_of(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)"),
    "box_expand": (f"b {BOX}, ratio DOUBLE", BOX, "box_of(b.x1 - box_width(b) * ratio, b.y1 - box_height(b) * ratio, b.x2 + box_width(b) * ratio, b.y2 + box_height(b) * ratio)"),
    "box_clip": (f"b {BOX}, w DOUBLE, h DOUBLE", BOX, "box_of(least(greatest(b.x1, 0D), w), least(greatest(b.y1, 0D), h), least(greatest(b.x2, 0D), w), least(greatest(b.y2, 0D), h))"),
    "box_normalize": (f"b {BOX}, w DOUBLE", BOX, "box_translate(b, -floor(b.x1 / w) * w, 0D)"),
    "box_unwrap": (f"b {BOX}, ref {BOX}, w DOUBLE", BOX, "box_translate(b, rint((ref.x1 + ref.x2 - b.x1 - b.x2) / 2 / w) * w, 0D)"),
    "box_wrapped_iou": (f"a {BOX}, b {BOX}, w DOUBLE", "DOUBLE", "box_iou(a, box_unwrap(b, a, w))"),
    "box_size": (f"b {BOX}", "STRING", "CASE WHEN box_height(b) < 16 THEN '<16px' WHEN box_height(b) < 32 THEN '16-32px' WHEN box_height(b) < 96 THEN '32-96px' ELSE '>96px' END"),
}


def register(spark: SparkSession) -> None:
    """Make every function of ``FUNCTIONS`` known to the session's SQL, for as long as the session lives.

    A null box has size 0 and shares nothing, as with the Column expressions.
    """
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
