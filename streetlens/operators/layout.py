"""What is decided before detections exist: projection, detection passes, class groups, refusals, encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Containers taken, the step of network inputs in pixels, tile sides and size limits.
CONTAINERS = ("mp4", "mov", "m4v")
STRIDE, SMALL, LARGE, TILE, TILE_LIMIT = 32, 1024, 2048, 3840, 4096


def _input_size(side: Column, most: int) -> Column:
    return F.least(F.lit(most), (F.ceil(side / STRIDE) * STRIDE).cast("int"))


def projection(setting: Column, spherical: Column, width: Column, height: Column) -> Column:
    """struct(projection, source): the setting, else what the file says, else twice as wide as high; null projection: not supported."""
    forced = setting.isin("flat", "equirectangular")
    name = F.when(forced, setting).when(spherical.startswith("equirectangular"), "equirectangular").when(spherical.isNotNull(), F.lit(None).cast("string")).when(width == 2 * height, "equirectangular").otherwise("flat")
    source = F.when(forced, "setting").when(spherical.isNotNull(), "spherical-metadata").when(width == 2 * height, "aspect-ratio-heuristic").otherwise("default")
    return F.struct(name.alias("projection"), source.alias("source"))


def passes(videos: DataFrame, tile_trigger: int = 5760, pad_ratio: float = 0.0) -> DataFrame:
    """(clip_id, place, id, kind, imgsz, x1, y1, x2, y2, pad): the passes of each video (clip_id, width, height, projection, profile).

    One or two passes see the whole frame; large frames get tiles, too, unless
    the profile is fast: two halves of a frame that closes sideways, else a
    grid whose tiles overlap by a tenth. Whole-frame passes have null sides.
    """
    w, h = F.col("width"), F.col("height")
    around = F.col("projection") == "equirectangular"
    sized = videos.withColumn("pad", F.when(around, F.rint(w * F.lit(pad_ratio))).otherwise(0).cast("int"))
    sized = sized.withColumns({"long": F.greatest(w + 2 * F.col("pad"), h), "cols": F.ceil(w / TILE).cast("int"), "rows": F.ceil(h / TILE).cast("int")})
    tall = F.col("profile") == "thorough"
    top, bottom = F.when(tall, 0).otherwise(F.floor(h / 4)).cast("int"), F.when(tall, h).otherwise(F.floor(h * 3 / 4)).cast("int")
    half, more = F.floor(w / 2).cast("int"), F.floor(w / 16).cast("int")

    def whole(size: Column) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(F.concat(F.lit("g"), size.cast("string")).alias("id"), F.lit("global").alias("kind"), size.alias("imgsz"), none.alias("x1"), none.alias("y1"), none.alias("x2"), none.alias("y2"), F.col("pad").alias("pad"))

    def tile(name: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        size = _input_size(F.greatest(x2 - x1, y2 - y1), TILE_LIMIT)
        return F.struct(name.alias("id"), F.lit("tile").alias("kind"), size.alias("imgsz"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.lit(0).alias("pad"))

    def cell(n: Column) -> Column:
        row, col = F.floor(n / F.col("cols")).cast("int"), (n % F.col("cols")).cast("int")
        tw, th = F.ceil(w / F.col("cols")).cast("int"), F.ceil(h / F.col("rows")).cast("int")
        mx, my = F.floor(tw / 10).cast("int"), F.floor(th / 10).cast("int")
        return tile(F.concat(F.lit("t"), row.cast("string"), col.cast("string")), F.greatest(F.lit(0), col * tw - mx), F.greatest(F.lit(0), row * th - my), F.least(w, (col + 1) * tw + mx), F.least(h, (row + 1) * th + my))

    small, large = _input_size(F.col("long"), SMALL), _input_size(F.col("long"), LARGE)
    seen = F.when(F.col("long") > SMALL, F.array(whole(small), whole(large))).otherwise(F.array(whole(small)))
    halves = F.array(tile(F.lit("tL"), -F.col("pad"), top, half + more, bottom), tile(F.lit("tR"), half - more, top, w + F.col("pad"), bottom))
    tiles = F.when(around, halves).otherwise(F.transform(F.sequence(F.lit(0), F.col("cols") * F.col("rows") - 1), cell))
    tiled = (F.col("profile") != "fast") & (F.greatest(w, h) >= tile_trigger)
    return sized.select("clip_id", F.posexplode(F.when(tiled, F.concat(seen, tiles)).otherwise(seen)).alias("place", "p")).select("clip_id", "place", "p.*")


def class_groups(policy: DataFrame) -> DataFrame:
    """(cls, action, grp) of a class policy: a class to blur is its own group, all to annotate share one."""
    return policy.select("cls", "action", F.when(F.col("action") == "blur", F.col("cls")).otherwise("signage").alias("grp"))


def policy_gaps(policy: DataFrame, models: DataFrame) -> DataFrame:
    """(cls): classes of the policy that no model row (cls) gives."""
    return policy.select("cls").join(models.select("cls"), "cls", "left_anti")


def refusal(videos: DataFrame, longest_s: float) -> DataFrame:
    """``videos`` (path, video_streams, spherical, width, height, setting, duration_s) with ``code``: null where a file is taken."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    streams = F.coalesce(F.col("video_streams"), F.lit(0))
    found = projection(F.col("setting"), F.col("spherical"), F.col("width"), F.col("height"))
    code = (
        F.when(suffix.isin("insv", "360"), "unsupported_projection").when(~suffix.isin(*CONTAINERS) | (streams == 0), "unsupported_media_type").when(streams > 1, "unsupported_projection")
        .when(F.col("duration_s") > longest_s, "video_too_long").when(found["projection"].isNull(), "unsupported_projection")
    )
    return videos.withColumn("code", code)


def choose_encoder(videos: DataFrame, encoders: DataFrame, factor: float) -> DataFrame:
    """(clip_id, encoder, family, bit_rate): of the usable encoders (family, rank, encoder) of a video's codec the first; other codecs are h264.

    A video without a usable encoder has null. The table of encoders is a few rows.
    """
    best = encoders.groupBy("family").agg(F.min_by("encoder", "rank").alias("encoder"))
    family = F.when(F.col("codec") == "hevc", "hevc").otherwise("h264")
    return videos.withColumn("family", family).join(F.broadcast(best), "family", "left").select("clip_id", "encoder", "family", F.floor(F.col("bit_rate") * F.lit(factor)).cast("long").alias("bit_rate"))


def frame_range(start: Column, end: Column, count: Column) -> Column:
    """How many frames of ``count`` a range [start, end) has; a null end is the last frame, a null count may leave it unknown."""
    return F.when(count.isNull(), F.when(end.isNotNull(), end - start)).otherwise(F.greatest(F.lit(0), F.least(F.coalesce(end, count), count) - start))


def copied_packets(packets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Packets (clip_id, stream, time, ...) inside their clip's [start, end), with times from the start on."""
    inside = packets.join(ranges.select("clip_id", "start", "end"), "clip_id").where("time >= start AND (end IS NULL OR time < end)")
    return inside.withColumn("time", F.col("time") - F.col("start")).drop("start", "end")
