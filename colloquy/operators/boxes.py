"""Box geometry. A box is (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def shared(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def union_share(a: Box, b: Box) -> Column:
    """Shared area over the area of both; 0 where nothing is shared."""
    both = shared(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def share_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, shared(a, b) / least).otherwise(0.0)


def inside(inner: Box, outer: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def flipped(b: Box, height: Column) -> Box:
    """The same box measured from the other edge of the image."""
    return b[0], height - b[3], b[2], height - b[1]
