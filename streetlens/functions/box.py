"""Boxes as four Column expressions; everything stays inside code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


@dataclass(frozen=True)
class Box:
    """A box in pixels, origin top left."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{s}") for s in SIDES))

    def named(self, prefix: str = "", digits: int | None = None) -> list[Column]:
        sides = (self.x1, self.y1, self.x2, self.y2)
        if digits is not None:
            sides = tuple(F.round(s, digits) + F.lit(0.0) for s in sides)
        return [s.alias(f"{prefix}{n}") for s, n in zip(sides, SIDES, strict=True)]

    @property
    def width(self) -> Column:
        return F.greatest(F.lit(0.0), self.x2 - self.x1)

    @property
    def height(self) -> Column:
        return F.greatest(F.lit(0.0), self.y2 - self.y1)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def side(self) -> Column:
        return F.greatest(self.width, self.height)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    def intersection(self, o: Box) -> Column:
        return F.greatest(F.lit(0.0), F.least(self.x2, o.x2) - F.greatest(self.x1, o.x1)) * F.greatest(F.lit(0.0), F.least(self.y2, o.y2) - F.greatest(self.y1, o.y1))

    def iou(self, o: Box) -> Column:
        both = self.intersection(o)
        union = self.area + o.area - both
        return F.when(union > 0, both / union).otherwise(0.0)

    def iomin(self, o: Box) -> Column:
        least = F.least(self.area, o.area)
        return F.when(least > 0, self.intersection(o) / least).otherwise(0.0)

    def union(self, o: Box) -> Box:
        return Box(F.least(self.x1, o.x1), F.least(self.y1, o.y1), F.greatest(self.x2, o.x2), F.greatest(self.y2, o.y2))

    def expand(self, ratio) -> Box:
        dx, dy = self.width * ratio, self.height * ratio
        return Box(self.x1 - dx, self.y1 - dy, self.x2 + dx, self.y2 + dy)

    def translate(self, dx, dy) -> Box:
        return Box(self.x1 + dx, self.y1 + dy, self.x2 + dx, self.y2 + dy)

    def scale(self, sx, sy) -> Box:
        return Box(self.x1 * sx, self.y1 * sy, self.x2 * sx, self.y2 * sy)

    def clip(self, w, h) -> Box:
        def held(v: Column, top) -> Column:
            return F.least(F.greatest(v, F.lit(0.0)), F.lit(top) * F.lit(1.0))

        return Box(held(self.x1, w), held(self.y1, h), held(self.x2, w), held(self.y2, h))

    def lerp(self, o: Box, t: Column) -> Box:
        return Box(*(a + (b - a) * t for a, b in zip((self.x1, self.y1, self.x2, self.y2), (o.x1, o.y1, o.x2, o.y2), strict=True)))

    def round_out(self) -> Box:
        return Box(F.floor(self.x1), F.floor(self.y1), F.ceil(self.x2), F.ceil(self.y2))

    def jump(self, o: Box) -> Column:
        """Distance of the centres in sizes of the larger box, a size being one pixel at least."""
        dx, dy = o.cx - self.cx, o.cy - self.cy
        return F.sqrt(dx * dx + dy * dy) / F.greatest(self.side, o.side, F.lit(1.0))

    # across the seam of a frame that closes at width w

    def normalize(self, w) -> Box:
        turns = F.floor(self.x1 / w) * w
        return Box(self.x1 - turns, self.y1, self.x2 - turns, self.y2)

    def unwrap_towards(self, ref: Box, w) -> Box:
        turns = F.rint((ref.cx - self.cx) / w) * w
        return Box(self.x1 + turns, self.y1, self.x2 + turns, self.y2)

    def wrapped_iou(self, o: Box, w) -> Column:
        """IoU with ``o`` brought next to this box across the seam."""
        return self.iou(o.unwrap_towards(self, w))

    def split(self, w) -> Column:
        """The one or two visible parts inside [0, w), as an array of (left, right)."""
        b = self.normalize(w)
        whole = F.array(F.struct(b.x1.alias("left"), b.x2.alias("right")))
        two = F.array(F.struct(b.x1.alias("left"), F.lit(w).alias("right")), F.struct(F.lit(0.0).alias("left"), F.least(b.x2 - w, b.x1).alias("right")))
        return F.when(b.x2 <= w, whole).otherwise(two)

    def copies(self, w) -> Column:
        """The box and its copies one turn to either side, as an array of (turn, x1, x2)."""
        b = self.normalize(w)
        return F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda t: F.struct(t.alias("turn"), (b.x1 + t * w).alias("x1"), (b.x2 + t * w).alias("x2")))

    def circular_dx(self, o: Box, w) -> Column:
        half = F.lit(w) / 2
        return F.pmod(o.cx - self.cx + half, F.lit(w) * F.lit(1.0)) - half

    # rotation of a frame of w x h pixels, in quarter turns

    def rotate(self, degrees: Column, w, h) -> Box:
        """From coded to display coordinates of a frame that is shown turned clockwise."""
        turns = F.pmod(F.rint(degrees / 90).cast("int"), F.lit(4))

        def pick(a, b, c, d):
            return F.when(turns == 0, a).when(turns == 1, b).when(turns == 2, c).otherwise(d)

        return Box(
            pick(self.x1, self.y1, F.lit(w) - self.x2, F.lit(h) - self.y2), pick(self.y1, F.lit(w) - self.x2, F.lit(h) - self.y2, self.x1),
            pick(self.x2, self.y2, F.lit(w) - self.x1, F.lit(h) - self.y1), pick(self.y2, F.lit(w) - self.x1, F.lit(h) - self.y1, self.x2),
        )

    def unrotate(self, degrees: Column, w, h) -> Box:
        """From display back to coded coordinates: the inverse of ``rotate``; ``w`` and ``h`` are the coded frame's."""
        turns = F.pmod(F.rint(degrees / 90).cast("int"), F.lit(4))

        def pick(a, b, c, d):
            return F.when(turns == 0, a).when(turns == 1, b).when(turns == 2, c).otherwise(d)

        return Box(
            pick(self.x1, F.lit(w) - self.y2, F.lit(w) - self.x2, self.y1), pick(self.y1, self.x1, F.lit(h) - self.y2, F.lit(h) - self.x2),
            pick(self.x2, F.lit(w) - self.y1, F.lit(w) - self.x1, self.y2), pick(self.y2, self.x2, F.lit(h) - self.y1, F.lit(h) - self.x1),
        )


def size_bucket(height: Column) -> Column:
    return F.when(height < 16, "<16px").when(height < 32, "16-32px").when(height < 96, "32-96px").otherwise(">96px")
