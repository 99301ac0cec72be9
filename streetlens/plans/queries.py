"""One query per operator over the detections made of the ``events`` table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.box import SIDES, Box, size_bucket
from ..operators import catalog as C
from ..operators import detections as D
from ..operators import keyframes as K
from ..operators import jobs as J
from ..operators import link as L
from ..operators import metrics as M
from ..operators import plan as P
from ..operators import signs as S
from ..options import Options
from ..sources import logs

OPTIONS = Options()
AROUND = Options(width=1900, wrap_width=1900.0)
FRAMES = 720
KEY = ("clip_id", "chain_id", "segment", "frame")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def chained(spark, sf_dir) -> DataFrame:
    return D.tracks_as_chains(detections(spark, sf_dir), ("face", "plate"))


def sign_chains(spark, sf_dir) -> DataFrame:
    return D.tracks_as_chains(detections(spark, sf_dir), ("signage",))


def truth(spark, sf_dir) -> DataFrame:
    found = detections(spark, sf_dir).where(F.col("grp").isin("face", "plate"))
    track = F.coalesce("track_id", F.concat("grp", F.lit(":~"), F.col("seq").cast("string")))
    # every fifth box is smaller than what was detected, some of them under 16 pixels
    size = F.when(F.col("seq") % 5 == 0, F.lit(-0.35)).otherwise(F.lit(0.1))
    return found.select("clip_id", track.alias("track"), "cls", "frame", "seq", (F.col("seq") % 2 == 0).alias("readable"), *Box.of().expand(size).named())


def jobs(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "queued").when(s == "F", "succeeded").when(s == "P", "running").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(s == "F", (F.col("o_orderkey") * 37) % 25000).alias("duration_s"), (F.col("o_orderkey") % 3000).alias("frames"))


def _segments(spark, sf_dir):
    return P.segments(P.split_jumps(chained(spark, sf_dir), OPTIONS), OPTIONS)


def _smooth(spark, sf_dir):
    return P.smooth(P.densify(_segments(spark, sf_dir)), OPTIONS)


def _regions(spark, sf_dir):
    cut = _segments(spark, sf_dir)
    even = P.smooth(P.densify(cut), OPTIONS)
    return P.regions(even, P.padding(cut, even, OPTIONS), FRAMES)


def plan(spark, sf_dir) -> DataFrame:
    return P.blur_plan(chained(spark, sf_dir), OPTIONS, FRAMES)


def objects(spark, sf_dir) -> DataFrame:
    return M.object_frames(truth(spark, sf_dir), plan(spark, sf_dir), OPTIONS)


def seam_plan(spark, sf_dir) -> DataFrame:
    return P.blur_plan(chained(spark, sf_dir), AROUND, FRAMES)


def summary(spark, sf_dir) -> DataFrame:
    # what the summary and the gate read several times is computed once
    found = objects(spark, sf_dir).persist()
    return M.summary(found, M.chains_per_track(truth(spark, sf_dir), plan(spark, sf_dir), OPTIONS), OPTIONS)


def annotations(spark, sf_dir) -> DataFrame:
    return S.display_shapes(S.sign_tracks(sign_chains(spark, sf_dir), OPTIONS), OPTIONS)


def gps(spark, sf_dir) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k")
    clips = detections(spark, sf_dir).select("clip_id").distinct().select("clip_id", k)
    return clips.select("clip_id", (F.col("k") * 50 / F.lit(24.0)).alias("time"), (45 + F.col("clip_id") / 1000.0 + F.col("k") / 10000.0).alias("lat"), (5 + F.col("clip_id") / 2000.0 - F.col("k") / 20000.0).alias("lon"))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    # a millionth more keeps exact ties from falling either way
    box = Box.of()
    return df.select(*cols, *Box(*(v + 1e-6 for v in (box.x1, box.y1, box.x2, box.y2))).named(digits=3))


def videos_of(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("clip_id"))


def _best(spark, sf_dir):
    return S.sign_tracks(sign_chains(spark, sf_dir), OPTIONS)


def linked(spark, sf_dir) -> DataFrame:
    return L.link(detections(spark, sf_dir).where("grp <> 'signage'"), OPTIONS)


def _by_day(spark, sf_dir):
    # days as frames: frames with several boxes each
    return detections(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") / 24))


def _keys(spark, sf_dir):
    base = detections(spark, sf_dir).where("track_id is not null")
    return base.select("clip_id", F.col("track_id").alias("track"), "frame", "seq", (F.col("seq") % 4 == 0).alias("outside"), (F.col("seq") % 2 == 0).alias("readable"), *SIDES)


def _scores(spark, sf_dir):
    return P.split_jumps(chained(spark, sf_dir), OPTIONS).where(F.col("part_score") >= OPTIONS.conf_blur).where("track_id is not null").groupBy("clip_id", "chain_id").agg(F.max("score").alias("score"))


def _log(spark, sf_dir):
    return logs.parse(logs.to_lines(detections(spark, sf_dir), FRAMES, OPTIONS.fps))


QUERIES = {
    "cvat_expand": lambda s, d: _rounded(K.expand(_keys(s, d), FRAMES), "clip_id", "track", "frame", "readable"),
    "keyframe_thin": lambda s, d: K.thin(chained(s, d), 20, 48),
    "keep_regions": lambda s, d: C.kept_regions(plan(s, d), _scores(s, d), 0.5).select(*KEY, "score"),
    "overlay_match": lambda s, d: C.overlay(plan(s, d), detections(s, d)),
    "orphan_antijoin": lambda s, d: detections(s, d).select("clip_id").distinct().join(_best(s, d), "clip_id", "left_anti"),
    "sweep_grid": lambda s, d: C.sweep(s, {"margin": [0.0, 0.1, 0.2], "padding": [0.0, 12.0], "conf_blur": [0.15, 0.3]}),
    "model_select": lambda s, d: C.select_models(s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("name"), F.col("p_size").alias("min_memory")), 20),
    "speed_median": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median_value"), F.count(F.lit(1)).alias("n")),
    "seam_split": lambda s, d: C.seam_parts(detections(s, d), 1900.0).select("seq", F.col("part").cast("long").alias("part"), F.col("left").alias("part_left"), F.col("right").alias("part_right")),
    "ndjson_roundtrip": lambda s, d: logs.detections(_log(s, d)),
    "ndjson_check": lambda s, d: logs.check(_log(s, d)),
    "dedup_merge": lambda s, d: L.merge_duplicates(_by_day(s, d), OPTIONS),
    "link_chains": lambda s, d: linked(s, d).select("clip_id", "seq", "frame", "chain_id"),
    "linked_blur_plan": lambda s, d: _rounded(P.blur_plan(linked(s, d), OPTIONS, FRAMES), *KEY, "kind", "cls", "source"),
    "detection_counts": lambda s, d: D.counts(detections(s, d)),
    "fragments": lambda s, d: D.fragments(detections(s, d)),
    "majority_class": lambda s, d: D.majority_class(sign_chains(s, d)),
    "iou_pairs": lambda s, d: D.overlaps(detections(s, d)),
    "jump_split": lambda s, d: P.split_jumps(chained(s, d), OPTIONS).select("clip_id", "chain_id", "seq", F.col("part").cast("long").alias("part")),
    "gap_split": lambda s, d: _segments(s, d).select("clip_id", "chain_id", "seq", "segment"),
    "densify": lambda s, d: _rounded(P.densify(_segments(s, d)), *KEY, "observed"),
    "smooth_envelope": lambda s, d: _rounded(_smooth(s, d), *KEY, "observed"),
    "temporal_padding": lambda s, d: _rounded(P.padding(_segments(s, d), _smooth(s, d), OPTIONS), *KEY),
    "region_union": lambda s, d: _rounded(_regions(s, d), *KEY, "source"),
    "blur_plan": lambda s, d: _rounded(plan(s, d), *KEY, "kind", "cls", "source"),
    "plan_stats": lambda s, d: P.plan_stats(chained(s, d), plan(s, d), OPTIONS),
    "coverage": lambda s, d: objects(s, d),
    "leakage_rollup": lambda s, d: M.leakage(objects(s, d)),
    "exposure_islands": lambda s, d: M.exposures(objects(s, d)),
    "transient_exposures": lambda s, d: M.transients(objects(s, d), replace(OPTIONS, fps=144.0)),
    "benchmark_summary": summary,
    "seam_plan": lambda s, d: _rounded(seam_plan(s, d), *KEY, "kind", "cls", "source"),
    "seam_coverage": lambda s, d: M.object_frames(truth(s, d), seam_plan(s, d), AROUND),
    "seam_chains_per_track": lambda s, d: M.chains_per_track(truth(s, d), seam_plan(s, d), AROUND),
    "seam_annotations": lambda s, d: S.display_shapes(_best(s, d), AROUND, (F.col("best.seq") % 4) * 90).select("clip_id", "chain_id", *SIDES),
    "sign_facts": lambda s, d: S.published(annotations(s, d), D.majority_class(sign_chains(s, d)), OPTIONS, "lens", "m", None).withColumn("semantics", F.to_json("semantics")),
    "sure_detections": lambda s, d: D.sure(D.first_frames(detections(s, d), 500), OPTIONS).select("clip_id", "seq"),
    "worth_annotating": lambda s, d: D.worth_annotating(chained(s, d), 0.6, 2).select("clip_id", "chain_id", "seq"),
    "chain_ratios": lambda s, d: D.chain_ratios(chained(s, d), plan(s, d)),
    "annotated_clips": lambda s, d: C.annotated(videos_of(s, d), truth(s, d)).select("clip_id", "boxes"),
    "chains_per_track": lambda s, d: M.chains_per_track(truth(s, d), plan(s, d), OPTIONS),
    "privacy_gate": lambda s, d: M.gate(summary(s, d), OPTIONS).withColumn("failures", F.array_join("failures", "; ")),
    "sign_tracks": lambda s, d: _best(s, d).select("clip_id", "chain_id", "n", "first_frame", "last_frame", "confidence_max", F.round("confidence_mean", 6).alias("confidence_mean")),
    "best_observation": lambda s, d: _best(s, d).select("clip_id", "chain_id", "best.frame", "best.seq", "best.score"),
    "annotations": lambda s, d: annotations(s, d).select("clip_id", "chain_id", "frame", *SIDES, F.round("time", 6).alias("time")),
    "best_frames": lambda s, d: S.best_frames(annotations(s, d)),
    "gps_asof": lambda s, d: S.position_at(annotations(s, d).select("clip_id", "chain_id", "time"), gps(s, d)).select("clip_id", "chain_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")),
    "unwrap_track": lambda s, d: D.unwrap(chained(s, d), 1900.0).select("clip_id", "chain_id", "seq", "turns"),
    "size_bucket": lambda s, d: detections(s, d).groupBy("cls", size_bucket(Box.of().height).alias("size")).agg(F.count(F.lit(1)).alias("n")),
    "seam_copies": lambda s, d: C.seam_copies(detections(s, d), 1900.0).select("seq", "turn", "x1", "x2"),
    "wrapped_iou": lambda s, d: detections(s, d).select("seq", F.round(Box.of().wrapped_iou(Box.of().translate(F.lit(1905.0) - 3800.0 * (F.col("seq") % 2), F.lit(2.0)), 1900.0), 6).alias("iou")),
    "fragmentation": lambda s, d: D.fragmentation(detections(s, d)).withColumn("tracked_share", F.round("tracked_share", 6)),
    "job_claim": lambda s, d: J.claim(jobs(s, d)).select("id", "created_at"),
    "job_counts": lambda s, d: J.counts(jobs(s, d)),
    "job_histogram": lambda s, d: J.histogram(jobs(s, d)),
    "job_expiry": lambda s, d: J.expired(jobs(s, d).crossJoin(jobs(s, d).agg(F.max("created_at").alias("now"))), F.col("now"), 1440).select("id"),
    "job_latest": lambda s, d: J.latest(detections(s, d).select(F.col("clip_id").alias("job_id"), "seq", F.col("cls").alias("status"))),
}
