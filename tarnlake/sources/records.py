"""Nested record formats: VOC annotations, tool listings, JSON props."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOX = "name string, bndbox struct<xmin: double, ymin: double, xmax: double, ymax: double>"
VOC = f"size struct<width: int, height: int>, object array<struct<{_BOX.replace('name string', 'name: string').replace('bndbox struct', 'bndbox: struct')}>>"


def voc_boxes(xml: Column) -> Column:
    """Boxes (name, x0, y0, x1, y1) of an annotation; none where it can't be parsed."""
    parsed = F.from_xml(xml, VOC, {"mode": "PERMISSIVE", "rowTag": "annotation"})
    boxes = F.transform(parsed["object"], lambda o: F.struct(o["name"].alias("name"), o["bndbox"]["xmin"].alias("x0"), o["bndbox"]["ymin"].alias("y0"), o["bndbox"]["xmax"].alias("x1"), o["bndbox"]["ymax"].alias("y1")))
    complete = F.filter(boxes, lambda b: b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull())
    return F.coalesce(complete, F.expr("cast(array() AS array<struct<name: string, x0: double, y0: double, x1: double, y1: double>>)"))


def key_values(block: Column) -> Column:
    """A block of ``Key = value`` lines as a map."""
    return F.str_to_map(block, F.lit("\n"), F.lit(" = "))
