"""From chains of observations to the regions to blur, as windows and aggregates.

A chain is (clip_id, chain_id); observations come ordered by (frame, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.box import SIDES, Box
from ..options import Options
from .detections import majority_class, unwrap

CHAIN = ("clip_id", "chain_id")
ORDER = ("frame", "seq")


def split_jumps(chained: DataFrame, o: Options) -> DataFrame:
    """Adds ``part``: a chain breaks where the centre jumps more than ``max_jump`` sizes; and the part's best score."""
    w = Window.partitionBy(*CHAIN).orderBy(*ORDER)
    before = Box(*(F.lag(s).over(w) for s in SIDES))
    broken = F.when(before.jump(Box.of()) > o.max_jump, 1).otherwise(0)
    parts = chained.withColumn("_new", broken).withColumn("part", F.sum("_new").over(w)).drop("_new")
    return parts.withColumns({"part_score": F.max("score").over(Window.partitionBy(*CHAIN, "part")), "chain_n": F.count(F.lit(1)).over(Window.partitionBy(*CHAIN))})


def segments(parts: DataFrame, o: Options) -> DataFrame:
    """Blurred parts only, with ``segment``: numbered per chain, a new one at each part and after too long a gap."""
    blurred = parts.where(F.col("part_score") >= o.conf_blur)
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy(*CHAIN, "part").orderBy(*ORDER))
    new = F.when(gap <= o.interpolation_gap + 1, 0).otherwise(1)
    w = Window.partitionBy(*CHAIN).orderBy(*ORDER)
    return blurred.withColumn("_new", new).withColumn("segment", (F.sum("_new").over(w) - 1).cast("int")).drop("_new")


def densify(segmented: DataFrame) -> DataFrame:
    """A box for every frame of a segment: the union of what was observed there, else interpolated."""
    key = (*CHAIN, "segment")
    each = segmented.groupBy(*key, "frame").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("chain_n").alias("chain_n"))
    w = Window.partitionBy(*key).orderBy("frame")
    ahead = each.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("frame", *SIDES)})
    gap = F.coalesce(F.col("n_frame") - F.col("frame"), F.lit(1))
    steps = ahead.withColumn("gap", gap).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap") - 1)))
    box = Box.of().lerp(Box.of("n_"), F.col("step") / F.col("gap"))
    inner = F.col("step") > 0
    sides = [F.when(inner, i).otherwise(F.col(s)).alias(s) for i, s in zip((box.x1, box.y1, box.x2, box.y2), SIDES, strict=True)]
    return steps.select(*key, (F.col("frame") + F.col("step")).alias("frame"), *sides, (~inner).alias("observed"), "chain_n")


def smooth(dense: DataFrame, o: Options) -> DataFrame:
    """Each box united with the mean of its neighbours in a centred window."""
    half = o.smoothing // 2
    w = Window.partitionBy(*CHAIN, "segment").orderBy("frame").rowsBetween(-half, half)
    mean = Box(*(F.avg(s).over(w) for s in SIDES))
    wide = Box.of().union(mean)
    return dense.select(*CHAIN, "segment", "frame", *wide.named(), "observed", "chain_n")


def padding(segmented: DataFrame, smoothed: DataFrame, o: Options) -> DataFrame:
    """Regions before and after each segment: its end boxes follow the centre's motion and grow."""
    key = (*CHAIN, "segment")
    up, down = Window.partitionBy(*key).orderBy(*ORDER), Window.partitionBy(*key).orderBy(*(F.desc(c) for c in ORDER))
    ranked = segmented.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})

    def motion(rank: str, name: str) -> list:
        inside, place = F.col(rank) <= o.velocity_samples, F.struct(*ORDER)
        center = F.when(inside, F.struct((F.col("x1") + F.col("x2")).alias("x"), (F.col("y1") + F.col("y2")).alias("y"), F.col("frame").alias("f")))
        place = F.when(inside, place)
        return [F.count_if(inside).alias(f"{name}_n"), F.max(F.when(inside, Box.of().side)).alias(f"{name}_side"), F.min_by(center, place).alias(f"{name}_a"), F.max_by(center, place).alias(f"{name}_b")]

    moved = ranked.where((F.col("_up") <= o.velocity_samples) | (F.col("_down") <= o.velocity_samples)).groupBy(*key).agg(*motion("_up", "head"), *motion("_down", "tail"))
    box = F.struct("frame", *SIDES)
    ends = smoothed.groupBy(*key).agg(F.min_by(box, "frame").alias("first"), F.max_by(box, "frame").alias("last"))

    def speed(name: str, axis: str):
        frames = F.col(f"{name}_b.f") - F.col(f"{name}_a.f")
        limit = F.col(f"{name}_side") * o.padding_speed
        v = (F.col(f"{name}_b.{axis}") - F.col(f"{name}_a.{axis}")) / 2 / frames
        return F.when((F.col(f"{name}_n") < o.padding_detections) | (frames <= 0), F.lit(0.0)).otherwise(F.greatest(-limit, F.least(limit, v)))

    speeds = {f"{n}_v{a}": speed(n, a) for n in ("head", "tail") for a in ("x", "y")}
    steps = moved.join(ends, [*key]).withColumns(speeds).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(o.padding)))) if o.padding else moved.join(ends, [*key]).withColumns(speeds).withColumn("step", F.lit(0)).where("false")
    n, grow = F.col("step"), F.col("step") * F.lit(o.growth) / 2
    head = Box.of("first.").translate(-F.col("head_vx") * n, -F.col("head_vy") * n).expand(grow)
    tail = Box.of("last.").translate(F.col("tail_vx") * n, F.col("tail_vy") * n).expand(grow)
    return steps.select(*key, (F.col("first.frame") - n).alias("frame"), *head.named()).unionByName(steps.select(*key, (F.col("last.frame") + n).alias("frame"), *tail.named()))


def regions(smoothed: DataFrame, padded: DataFrame, frame_count: int) -> DataFrame:
    """One region per frame, chain and segment: boxes united, the better founded source named; frames outside the clip drop."""
    kind = F.when(~F.col("observed"), "interpolated").when(F.col("chain_n") == 1, "orphan").otherwise("detected")
    key = (*CHAIN, "segment", "frame")
    both = smoothed.select(*key, *SIDES, kind.alias("source")).unionByName(padded.select(*key, *SIDES, F.lit("padded").alias("source")))
    rank = F.when(F.col("source").isin("detected", "orphan"), 3).when(F.col("source") == "interpolated", 2).otherwise(1)
    inside = both.where((F.col("frame") >= 0) & (F.col("frame") < frame_count))
    return inside.groupBy(*key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max_by("source", rank).alias("source"))


def shapes(found: DataFrame, classes: DataFrame, o: Options) -> DataFrame:
    """Regions enlarged by the margin; those outside the frame drop, faces become ellipses.

    In a frame that closes sideways a region comes back at the other side: its
    left edge is brought into the frame, and only its height can leave it.
    """
    wide = Box.of().expand(o.margin)
    out = found.join(classes, [*CHAIN]).select(*CHAIN, "segment", "frame", F.when(F.col("cls") == "face", "ellipse").otherwise("rect").alias("kind"), "cls", "source", *wide.named())
    if not o.wrap_width:
        return out.where(Box.of().clip(o.width, o.height).area > 0)
    held = Box.of().normalize(o.wrap_width)
    return out.withColumns({"x1": held.x1, "x2": held.x2}).where((F.col("y2") > 0) & (F.col("y1") < o.height))


def blur_plan(chained: DataFrame, o: Options, frame_count: int) -> DataFrame:
    """(clip_id, chain_id, segment, frame, kind, cls, source, x1..y2): the whole plan in one lazy pass over chains.

    With ``wrap_width`` the boxes of a chain are first unwrapped across the seam.
    """
    if o.wrap_width:
        chained = unwrap(chained, o.wrap_width).drop("turns")
    cut = segments(split_jumps(chained, o), o)
    even = smooth(densify(cut), o)
    return shapes(regions(even, padding(cut, even, o), frame_count), majority_class(chained), o)


def plan_stats(chained: DataFrame, plan: DataFrame, o: Options) -> DataFrame:
    """Counters of a plan as (clip_id, key, n)."""
    parts = split_jumps(chained, o).select(*CHAIN, "part", "part_score").distinct()
    per = parts.groupBy(*CHAIN).agg(F.count_if(F.col("part_score") < o.conf_blur).alias("low"), F.count(F.lit(1)).alias("all"))
    below = per.groupBy("clip_id").agg(F.count_if(F.col("low") == F.col("all")).alias("chains_below_threshold"), F.sum(F.when(F.col("low") < F.col("all"), F.col("low")).otherwise(0)).alias("parts_below_threshold"), F.count(F.lit(1)).alias("chains"))
    long = below.unpivot("clip_id", ["chains_below_threshold", "parts_below_threshold", "chains"], "key", "n")
    boxes = plan.groupBy("clip_id", F.concat(F.lit("boxes_"), "source").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    frames = plan.groupBy("clip_id").agg(F.count_distinct("frame").alias("n")).select("clip_id", F.lit("frames_with_blur").alias("key"), "n")
    return long.unionByName(boxes).unionByName(frames)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Per clip the shapes of each source, frames with any, and chains per blurred class, in one aggregate."""
    sources = [F.count_if(F.col("source") == s).alias(s) for s in ("detected", "interpolated", "padded", "orphan")]
    chains = [F.count_distinct(F.when(F.col("cls") == c, F.col("chain_id"))).alias(f"{c}_chains") for c in ("face", "plate")]
    return plan.groupBy("clip_id").agg(*sources, F.count_distinct("frame").alias("frames_with_blur"), *chains)
