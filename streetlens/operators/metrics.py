"""Coverage of annotated objects by a blur plan, leakage, exposures and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import SIDES, Box, size_bucket
from ..functions.rounding import round_half_even
from ..options import Options
from .catalog import seam_copies

#: Points a side of the grid that stands for a box, at most; a box has one a pixel.
GRID = 16


def _inside(kind: Column, s: Box, x: Column, y: Column) -> Column:
    """Whether a shape holds a point: a rectangle with its edges, or the ellipse through the corners of its box."""
    rx2, ry2 = s.width * s.width / 2, s.height * s.height / 2
    dx, dy = x - s.cx, y - s.cy
    round_ = (rx2 > 0) & (ry2 > 0) & (dx * dx * ry2 + dy * dy * rx2 <= rx2 * ry2)
    flat = (x >= s.x1) & (x <= s.x2) & (y >= s.y1) & (y <= s.y2)
    return F.when(kind == "ellipse", round_).otherwise(flat)


def _turned(plan: DataFrame, o: Options) -> DataFrame:
    """The shapes of a plan as (clip_id, frame, chain_id, kind, s_x1..s_y2); where the frame closes sideways also one turn to either side."""
    shapes = seam_copies(plan, o.wrap_width) if o.wrap_width else plan
    return shapes.select("clip_id", "frame", "chain_id", "kind", *Box.of().named("s_"))


def object_frames(truth: DataFrame, plan: DataFrame, o: Options) -> DataFrame:
    """Truth boxes (clip_id, track, frame, seq, cls, readable, x1..y2) with the share of their grid that some shape of the frame covers.

    A box has a grid of min(16, pixels) points a side. Boxes meet the shapes
    that reach them; each pair gives a bit mask a grid row, and masks are united
    as they are aggregated: points are never rows.
    """
    key = ["clip_id", "track", "frame", "seq", "cls", "readable", *SIDES]
    box, shape = Box.of(), Box.of("s_")
    nx, ny = (F.greatest(F.lit(1), F.least(F.lit(GRID), F.ceil(side).cast("int"))) for side in (box.width, box.height))
    more = F.when(F.col("kind") == "ellipse", F.lit(0.5)).otherwise(F.lit(0.0))  # an ellipse reaches less than half a side beyond its box
    reach = shape.expand(more)
    met = (reach.x2 >= box.x1) & (reach.x1 <= box.x2) & (reach.y2 >= box.y1) & (reach.y1 <= box.y2)
    t, p = truth.select(*key).alias("t"), _turned(plan, o).alias("p")
    pairs = t.join(p, (F.col("t.clip_id") == F.col("p.clip_id")) & (F.col("t.frame") == F.col("p.frame")) & met, "left")
    rows = pairs.select(*(F.col(f"t.{c}") for c in key), "kind", *shape.named("s_"), nx.alias("nx"), ny.alias("ny")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    # a point x of the row is inside if low <= x <= high and (x - cx)^2 * a + b <= c: one test for both kinds, false where there is no shape
    y = F.col("y1") + (F.col("j") + F.lit(0.5)) * box.height / F.col("ny")
    round_, flat = F.col("kind") == "ellipse", F.coalesce((y >= shape.y1) & (y <= shape.y2), F.lit(False))
    rx2, ry2 = shape.width * shape.width / 2, shape.height * shape.height / 2
    held = {
        "w": box.width, "low": F.when(round_, F.col("x1")).otherwise(F.coalesce("s_x1", F.lit(0.0))), "high": F.when(round_, F.col("x2")).otherwise(F.coalesce("s_x2", F.lit(0.0))), "cx": F.coalesce(shape.cx, F.lit(0.0)),
        "a": F.when(round_, ry2).otherwise(0.0), "b": F.when(round_, (y - shape.cy) * (y - shape.cy) * rx2).otherwise(0.0), "c": F.when(round_, F.when((rx2 > 0) & (ry2 > 0), rx2 * ry2).otherwise(-1.0)).when(flat, 0.0).otherwise(-1.0),
    }
    tested = rows.select(*key, "nx", "ny", "j", *(v.alias(k) for k, v in held.items()))
    mask = F.lit(0)
    for i in range(GRID):
        x = F.col("x1") + F.lit(i + 0.5) * F.col("w") / F.col("nx")
        inside = (x >= F.col("low")) & (x <= F.col("high")) & ((x - F.col("cx")) * (x - F.col("cx")) * F.col("a") + F.col("b") <= F.col("c"))
        mask = mask.bitwiseOR(inside.cast("int") * (1 << i))
    masked = tested.select(*key, "nx", "ny", "j", mask.alias("mask"))
    lines = masked.groupBy(*key, "nx", "ny", "j").agg(F.bit_count(F.bit_or("mask").bitwiseAND(F.pow(F.lit(2), F.col("nx")).cast("int") - 1)).alias("hit"))
    found = lines.groupBy(*key).agg((F.sum("hit") / F.max(F.col("nx") * F.col("ny"))).alias("coverage"))
    return found.select("clip_id", "track", "cls", "frame", "seq", size_bucket(box.height).alias("size"), "readable", "coverage", (F.col("coverage") >= o.protected).alias("protected"))


def leakage(objects: DataFrame) -> DataFrame:
    """Frames, unprotected frames and their rate: overall, by class, by size and by readability."""
    sets = objects.groupingSets([[], ["cls"], ["size"], ["readable"]], "cls", "size", "readable")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("protected")).alias("unprotected"), F.grouping_id().alias("gid"))
    what = F.when(F.col("gid") == 7, "overall").when(F.col("gid") == 3, F.concat(F.lit("class="), "cls")).when(F.col("gid") == 5, F.concat(F.lit("size="), "size")).otherwise(F.concat(F.lit("readable="), F.col("readable").cast("string")))
    return out.select(what.alias("slice"), "n", "unprotected", F.round(F.col("unprotected") / F.col("n"), 5).alias("rate"))


def exposures(objects: DataFrame) -> DataFrame:
    """Per track with an unprotected frame: how many, and the longest run of consecutive ones."""
    exposed = objects.where(~F.col("protected")).select("clip_id", "track", "frame").distinct()
    island = exposed.withColumn("island", F.col("frame") - F.row_number().over(Window.partitionBy("clip_id", "track").orderBy("frame")))
    return island.groupBy("clip_id", "track", "island").agg(F.count(F.lit(1)).alias("run")).groupBy("clip_id", "track").agg(F.sum("run").alias("exposed"), F.max("run").alias("longest"))


def transients(objects: DataFrame, o: Options) -> DataFrame:
    """Exposed frames with a protected one of the same track at most a third of a second before and after."""
    window = o.transient_window
    each = objects.groupBy("clip_id", "track", "frame").agg(F.bool_or("protected").alias("held"), F.count_if(~F.col("protected")).alias("exposed"))
    w = Window.partitionBy("clip_id", "track").orderBy("frame")
    held = F.when(F.col("held"), F.col("frame"))
    near = each.withColumns({"before": F.max(held).over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.min(held).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return near.where((F.col("exposed") > 0) & (F.col("frame") - F.col("before") <= window) & (F.col("after") - F.col("frame") <= window)).groupBy("clip_id").agg(F.sum("exposed").alias("transient"))


def chains_per_track(truth: DataFrame, plan: DataFrame, o: Options) -> DataFrame:
    """How many chains have a shape that holds the centre of one of the track's boxes; tracks that none holds have 0."""
    t = truth.select("clip_id", "frame", "track", *SIDES).alias("t")
    p = _turned(plan, o).alias("p")
    box = Box.of("t.")
    on = (F.col("t.clip_id") == F.col("p.clip_id")) & (F.col("t.frame") == F.col("p.frame")) & _inside(F.col("p.kind"), Box.of("p.s_"), box.cx, box.cy)
    return t.join(p, on, "left").groupBy(F.col("t.clip_id").alias("clip_id"), F.col("t.track").alias("track")).agg(F.count_distinct("p.chain_id").alias("chains"))


def summary(objects: DataFrame, chains: DataFrame, o: Options, over_blur: DataFrame | None = None) -> DataFrame:
    """One row on all clips: leakage of all and of readable objects, tracks ever leaked, longest exposures, transient
    exposures, mean chains a track (three decimals) and mean ``over_blur`` (clip_id, over_blur) of the clips (five).

    ``chains`` is what ``chains_per_track`` gives. Parts are rows of one long table, so that no part is joined with another.
    """
    bare = ~F.col("protected")
    rates = objects.agg(
        F.count_distinct("clip_id").alias("clips"), F.count(F.lit(1)).alias("object_frames"), F.count_if(bare).alias("unprotected"), F.count_if("readable").alias("readable_object_frames"), F.count_if(F.col("readable") & bare).alias("readable_unprotected")
    )
    tracks = objects.groupBy("clip_id", "track").agg(F.bool_or("readable").alias("readable"), F.bool_or(bare).alias("leaked"), F.bool_or(F.col("readable") & bare).alias("readable_leaked"))
    tracks = tracks.agg(F.count(F.lit(1)).alias("tracks"), F.count_if("leaked").alias("tracks_ever_leaked"), F.count_if("readable").alias("readable_tracks"), F.count_if("readable_leaked").alias("readable_tracks_ever_leaked"))
    longest = exposures(objects).agg(F.max("longest").alias("longest_exposure_frames"))
    readable = exposures(objects.where("readable")).agg(F.max("longest").alias("longest_exposure_frames_readable"))
    brief = transients(objects, o).agg(F.sum("transient").alias("transient_exposures"))
    mean = chains.agg(F.avg("chains").alias("mean_chains_per_track"))
    parts = [rates, tracks, longest, readable, brief, mean] + ([over_blur.agg(F.avg("over_blur").alias("over_blur_ratio"))] if over_blur is not None else [])
    long = [part.unpivot([], [F.col(c).cast("double").alias(c) for c in part.columns], "k", "v") for part in parts]
    names = [c for part in parts for c in part.columns]
    every = reduce(DataFrame.unionByName, long)
    row = every.agg(*(F.coalesce(F.max(F.when(F.col("k") == n, F.col("v"))), F.lit(0.0)).alias(n) for n in names))
    shares = [F.when(F.col(n) > 0, round_half_even(F.col(u) / F.col(n), 5)).otherwise(0.0).alias(f"{p}leakage_rate") for p, u, n in (("", "unprotected", "object_frames"), ("readable_", "readable_unprotected", "readable_object_frames"))]
    digits = {"mean_chains_per_track": 3, "over_blur_ratio": 5}
    return row.select(*(round_half_even(F.col(n), digits[n]).alias(n) if n in digits else F.col(n).cast("long").alias(n) for n in names), *shares)


def gate(found: DataFrame, o: Options) -> DataFrame:
    """(passed, failures) of a ``summary``: why leakage or exposure of readable objects is too much."""
    rate, run = F.col("readable_leakage_rate"), F.col("longest_exposure_frames_readable")
    percent = F.format_string("%.2f%%", round_half_even(rate * 100, 2))
    leak = F.when(rate > o.max_leakage, F.concat(F.lit("leakage rate of readable objects "), percent, F.lit(f" > {o.max_leakage:.2%}")))
    long = F.when(run > o.max_exposure, F.concat(F.lit("a readable object stayed exposed "), run.cast("string"), F.lit(f" consecutive frames > {o.max_exposure}")))
    failures = F.array_compact(F.array(leak, long))
    return found.select((F.size(failures) == 0).alias("passed"), failures.alias("failures"))
