"""The data model: pixels are rows (scene, i, j, bands), grids and extents are small values.

Rows ``i`` count down from the top, columns ``j`` right from the left edge, both from 0; bands count from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    """Map bounds and cell sizes of a north-up grid."""

    left: float
    top: float
    right: float
    bottom: float
    width: float = 1.0
    height: float = 1.0

    @property
    def shape(self) -> tuple[int, int]:
        """(rows, columns)"""
        return round((self.top - self.bottom) / self.height), round((self.right - self.left) / self.width)

    def contains(self, other: Extent) -> bool:
        """Strictly: no edge is shared."""
        return self.left < other.left and self.right > other.right and self.top > other.top and self.bottom < other.bottom

    def within(self, other: Extent) -> bool:
        return other.contains(self)

    def overlaps(self, other: Extent) -> bool:
        """Some area is shared."""
        return self.left < other.right and other.left < self.right and self.bottom < other.top and other.bottom < self.top

    def outside(self, other: Extent) -> bool:
        return not self.overlaps(other)

    def intersects_strict(self, other: Extent) -> bool:
        """Area is shared, and an edge of ``other`` lies strictly inside this extent."""
        x = self.left < other.left < self.right or self.left < other.right < self.right
        y = self.bottom < other.bottom < self.top or self.bottom < other.top < self.top
        return self.overlaps(other) and (x or y)

    def intersection(self, other: Extent) -> Extent:
        if not self.overlaps(other):
            raise ValueError("extents don't overlap")
        return Extent(max(self.left, other.left), min(self.top, other.top), min(self.right, other.right), max(self.bottom, other.bottom), self.width, self.height)

    def union(self, other: Extent) -> Extent:
        return Extent(min(self.left, other.left), max(self.top, other.top), max(self.right, other.right), min(self.bottom, other.bottom), self.width, self.height)

    def offsets(self, x: float, y: float) -> tuple[int, int]:
        """(row, column) of the cell that holds a point."""
        return int((self.top - y) // self.height), int((x - self.left) // self.width)

    def corner(self, i: int, j: int) -> tuple[float, float]:
        """(x, y) of a cell's upper left corner."""
        return self.left + j * self.width, self.top - i * self.height

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.top) - y) / self.height).cast("bigint")

    def column(self, x: Column) -> Column:
        return F.floor((x - self.left) / self.width).cast("bigint")

    def x(self, j: Column) -> Column:
        """Centre of a column."""
        return F.lit(self.left) + (j + 0.5) * self.width

    def y(self, i: Column) -> Column:
        """Centre of a row."""
        return F.lit(self.top) - (i + 0.5) * self.height

    def holds(self, x: Column, y: Column) -> Column:
        """Whether points are strictly inside."""
        return (x > self.left) & (x < self.right) & (y > self.bottom) & (y < self.top)


def tiles(rows: int, columns: int, size: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """(i, j, rows, columns) of tiles in reading order, cut at the edges; ``overlap`` widens each on all sides."""
    out = []
    for i in range(0, rows, size):
        for j in range(0, columns, size):
            a, b = max(0, i - overlap), max(0, j - overlap)
            out.append((a, b, min(rows, i + size + overlap) - a, min(columns, j + size + overlap) - b))
    return out
