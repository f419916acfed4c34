"""Boxes: parsing, and predicates whose comparisons reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TerravaneError


@dataclass(frozen=True)
class Bbox:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @classmethod
    def parse(cls, text: str | None) -> Bbox | None:
        """`xmin,ymin,xmax,ymax`; empty text is no box."""
        if not text:
            return None
        parts = text.split(",")
        if len(parts) != 4:
            raise TerravaneError("please provide 4 comma-separated values (xmin,ymin,xmax,ymax) as a bbox")
        values = []
        for name, part in zip(("xmin", "ymin", "xmax", "ymax"), parts):
            try:
                values.append(float(part))
            except ValueError as e:
                raise TerravaneError(f"trouble parsing {name} input as float64: {part!r}") from e
        return cls(*values)

    def shifted(self) -> Bbox:
        """A box that starts east and ends west of 0 starts 360 degrees earlier."""
        return Bbox(self.xmin - 360, self.ymin, self.xmax, self.ymax) if self.xmin > 0 > self.xmax else self

    def intersects(self, other: Bbox) -> bool:
        """Edges included."""
        a, b = self.shifted(), other.shifted()
        return a.xmax >= b.xmin and b.xmax >= a.xmin and a.ymax >= b.ymin and b.ymax >= a.ymin


def intersects(box: Column, query: Bbox, fields: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax"), wrap: bool = False) -> Column:
    """Does a box column meet the query box, edges included; null, which no filter keeps, for a null box.

    Three comparisons are literal and go down to the scan. The fourth has a literal superset beside
    it, so that row groups are skipped there too. wrap=True also tries the query 360 degrees east,
    for boxes that meet it only beyond the antimeridian.
    """
    q = query.shifted()
    xmin, ymin, xmax, ymax = (box[f] for f in fields)
    crosses = (xmin > 0) & (xmax < 0)

    def at(west: float, east: float) -> Column:
        pushable = (xmax >= west) & ((xmin <= east) | crosses)
        return pushable & (F.when(crosses, xmin - 360).otherwise(xmin) <= east)

    across = at(q.xmin, q.xmax)
    if wrap and q.xmin < -180:
        across = across | at(q.xmin + 360, q.xmax + 360)
    return (ymax >= q.ymin) & (ymin <= q.ymax) & across


def within(box: Column, limits: list[float]) -> Column:
    """Null if an envelope is within metadata limits of 4 or 6 numbers, else which side it leaves
    and how far: struct(side, value). Limits whose west is east of their east cross the antimeridian."""
    x0, y0, x1, y1 = (limits[0], limits[1], limits[2], limits[3]) if len(limits) == 4 else (limits[0], limits[1], limits[3], limits[4])
    side = lambda name, v: F.struct(F.lit(name).alias("side"), v.alias("value"))
    if x0 <= x1:
        out = F.when(box.xmin < x0, side("west", box.xmin)).when(box.xmax > x1, side("east", box.xmax))
    else:
        out = F.when((box.xmax > x1) & (box.xmax < x0), side("outside", box.xmax)).when((box.xmin < x0) & (box.xmin > x1), side("outside", box.xmin))
    return out.when(box.ymin < y0, side("south", box.ymin)).when(box.ymax > y1, side("north", box.ymax))
