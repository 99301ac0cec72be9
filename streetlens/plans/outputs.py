"""Queries on keys, files, pictures, summaries and JSON outputs, over tables made of the TPC-like ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cache as C
from ..operators import jobs as J
from ..operators import pictures as X
from ..operators import plan as P
from ..operators import signs as S
from ..sources import files, setup_files
from ..streaming import progress as R
from . import queries as Q
from .service import _VIDEO, videos


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def requests(s, d) -> DataFrame:
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").select(
        k.alias("clip_id"), _text("m", k % 3).alias("model"), _text("p", k % 2).alias("profile"), F.when(k % 2 == 0, 0.25).otherwise(0.5).alias("conf"), F.lit(5760).alias("tile_trigger_width"), F.lit(0.0).alias("equirect_pad_ratio"),
        F.lit("auto").alias("projection"), F.lit("face=blur").alias("policy"), F.when(k % 5 == 0, k).alias("max_frames"), F.lit("flow").alias("tracker"), (k % 4 * 480).alias("width"),
    )


def wanted(s, d) -> DataFrame:
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("clip_id"), _text("d", k % 7).alias("det_key"), _text("t", k % 5).alias("track_key"))


def kept(s, d) -> DataFrame:
    n = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("clip_id"), _text("d", n % 11).alias("det_key"), _text("t", n % 3).alias("track_key"), (n % 2 == 0).alias("complete"))


def folders(s, d) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("modified"), "o_orderstatus")
    return files.leftovers(orders.drop("o_orderstatus"), orders.where("o_orderstatus <> 'P'").select("id"), F.lit("1997-01-01").cast("timestamp"), 60)


def put(s, d) -> DataFrame:
    old = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return setup_files.put(old, old.where("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.lit("new").alias("name")))


def creation(s, d) -> DataFrame:
    n = F.col("o_orderkey")
    zone = F.element_at(F.array(*map(F.lit, ("Z", "+02:00", "-03:30", "", "+0530"))), (n % 5 + 1).cast("int"))
    raw = F.when(n % 11 == 0, "unknown").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:20:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(".250"), zone))
    return s.read.parquet(f"{d}/orders.parquet").select(n.alias("clip_id"), X.created(raw).alias("started"))


def _creation(s, d) -> DataFrame:
    local = F.col("started.local")
    return creation(s, d).select("clip_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS").alias("local"), F.col("started.offset").alias("offset_min"), X.utc_offset(F.col("started.offset")).alias("zone"))


def index(s, d) -> DataFrame:
    found = X.index(Q.annotations(s, d))
    return found.select("clip_id", F.col("n").cast("long").alias("n"), "file", "frame", F.array_join(F.col("annotation_indices").cast("array<string>"), ",").alias("places"), F.array_join(F.flatten("shapes").cast("array<string>"), ",").alias("shapes"))


def tags(s, d) -> DataFrame:
    seen = Q.annotations(s, d).select("clip_id", "chain_id", "time")
    at = S.position_at(seen, Q.gps(s, d)).withColumns({"lon": -F.col("lon"), "alt": F.col("lat") - 45.5, "started": F.struct(F.lit("2024-05-06 07:08:09.5").cast("timestamp_ntz").alias("local"), F.lit(-210).alias("offset"))})
    return X.tags(at).select("clip_id", "chain_id", "taken", "subsec", "zone", "lat_ref", F.col("lat_dms.degrees").alias("lat_d"), F.col("lat_dms.minutes").alias("lat_m"), "lon_ref", F.col("lon_dms.degrees").alias("lon_d"), F.col("lon_dms.minutes").alias("lon_m"), F.col("alt_ref").cast("int").alias("alt_ref"))


def marks(s, d) -> DataFrame:
    found = X.overlay_marks(Q.plan(s, d), Q.detections(s, d), 0.5, 1920.0)
    return found.groupBy("clip_id", "mark", "dashed", F.array_join(F.col("colour").cast("array<string>"), ",").alias("colour")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"), F.sum(F.rint((F.col("x1") + 1e-6) * 1000).cast("long")).alias("sum_x1"))


def timings(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("clip_id"), F.create_map("event_type", (F.col("event_id") % 1000 / F.lit(8.0))).alias("timings"))
    return J.total_times(e)


def reports(s, d) -> DataFrame:
    n = F.col("event_id")
    e = s.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 40).alias("job_id"), F.when(n % 2 == 0, "rendering").otherwise("analyzing").alias("phase"), F.date_trunc("minute", "ts").alias("at"), F.timestamp_add("SECOND", F.lit(-600), F.date_trunc("minute", "ts")).alias("started_at"),
        n.alias("done"), F.when(n % 3 != 0, F.greatest(n, F.lit(1000)) * 2).alias("total"),
    )
    return R.throttled(e).select("job_id", "phase", F.unix_seconds("at").alias("at"), "done", "total", F.round("percent", 6).alias("percent"), "eta_s")


def states(s, d) -> DataFrame:
    none = F.lit(None)
    jobs = Q.jobs(s, d).withColumns({
        "created_at": F.col("created_at").cast("timestamp"), "started_at": none.cast("timestamp"), "finished_at": none.cast("timestamp"), "expires_at": none.cast("timestamp"), "phase": none.cast("string"), "percent": F.when(F.col("status") == "succeeded", 100.0).otherwise(0.0),
        "frames_done": F.col("frames"), "frames_total": F.when(F.col("id") % 2 == 0, F.col("frames")), "eta_s": none.cast("long"), "error_code": F.when(F.col("status") == "failed", "job_failed"), "error_message": F.when(F.col("status") == "failed", "no frames"), "debug": F.col("id") % 3 == 0,
    })
    return J.status_json(jobs)


def published(s, d) -> DataFrame:
    notes = Q.annotations(s, d)
    where = S.position_at(notes.select("clip_id", "chain_id", "time"), Q.gps(s, d)).drop("time")
    clips = videos(s, d).select("clip_id", "width", "height", "duration_s", F.lit(Q.FRAMES).alias("frame_count"), "projection")
    return S.metadata(notes.join(where, ["clip_id", "chain_id"]), clips)


QUERIES = {
    "cache_keys": lambda s, d: C.with_keys(requests(s, d)).select("clip_id", "det_key", "track_key"),
    "cache_reuse": lambda s, d: C.reuse(wanted(s, d), kept(s, d)),
    "folder_leftovers": lambda s, d: folders(s, d).select("id"),
    "manifest_put": put,
    "creation_times": _creation,
    "picture_index": index,
    "picture_tags": tags,
    "overlay_marks": marks,
    "plan_summary": lambda s, d: P.plan_summary(Q.plan(s, d)),
    "timings_total": timings,
    "progress_reports": reports,
    "job_status_json": states,
    "published_metadata": published,
}


_AT = """
    (SELECT clip_id, chain_id, time, CASE WHEN b_time IS NOT NULL THEN a_lat + (b_lat - a_lat) * CASE WHEN b_time > a_time THEN (time - a_time) / (b_time - a_time) ELSE 0 END WHEN time - a_time <= 1 THEN a_lat END AS lat,
            CASE WHEN b_time IS NOT NULL THEN a_lon + (b_lon - a_lon) * CASE WHEN b_time > a_time THEN (time - a_time) / (b_time - a_time) ELSE 0 END WHEN time - a_time <= 1 THEN a_lon END AS lon
     FROM (SELECT n.clip_id, n.chain_id, n.time, a.time AS a_time, a.lat AS a_lat, a.lon AS a_lon FROM notes n ASOF JOIN gps a ON n.clip_id = a.clip_id AND n.time >= a.time) x
     LEFT JOIN (SELECT n.clip_id, n.chain_id, min(g.time) AS b_time, arg_min(g.lat, g.time) AS b_lat, arg_min(g.lon, g.time) AS b_lon FROM notes n JOIN gps g ON n.clip_id = g.clip_id AND g.time >= n.time GROUP BY ALL) y USING (clip_id, chain_id))"""


def oracles(sql) -> dict[str, str]:
    """SQL of these queries; ``sql`` puts the common tables before a statement."""
    return {
        "picture_tags": sql(f"""
            SELECT clip_id, chain_id, strftime(taken, '%Y:%m:%d %H:%M:%S') AS taken, strftime(taken, '%g') AS subsec, '-03:30' AS zone, CASE WHEN lat >= 0 THEN 'N' WHEN lat < 0 THEN 'S' END AS lat_ref, CAST(floor(lat) AS BIGINT) AS lat_d, CAST(floor((lat - floor(lat)) * 60) AS BIGINT) AS lat_m,
                   CASE WHEN -lon >= 0 THEN 'E' WHEN -lon < 0 THEN 'W' END AS lon_ref, CAST(floor(lon) AS BIGINT) AS lon_d, CAST(floor((lon - floor(lon)) * 60) AS BIGINT) AS lon_m, CAST(CASE WHEN lat - 45.5 >= 0 THEN 0 WHEN lat - 45.5 < 0 THEN 1 END AS INTEGER) AS alt_ref
            FROM (SELECT *, TIMESTAMP '2024-05-06 07:08:09.5' + to_microseconds(CAST(round(time * 1000000) AS BIGINT)) AS taken FROM {_AT})"""),
        "published_metadata": sql(f"""
            SELECT v.clip_id, '{{"video":{{"width":' || width || ',"height":' || height || ',"duration_s":' || round(v.clip_id % 5000, 3)::DOUBLE || ',"frame_count":720,"projection":"' || projection || '"}},"annotations":[' || coalesce(items, '') || ']}}' AS body
            FROM {_VIDEO} v LEFT JOIN (
              SELECT n.clip_id, string_agg('{{"shape":[' || concat_ws(',', x1, y1, x2, y2) || '],"video":{{"track":"' || n.chain_id || '","best_frame":' || frame || ',"best_timestamp":' || round(n.time, 3) || '}}' ||
                     CASE WHEN lat IS NOT NULL THEN ',"position":{{"lat":' || round(lat, 7) || ',"lon":' || round(lon, 7) || '}}' ELSE '' END || '}}', ',' ORDER BY first_frame, n.chain_id) AS items
              FROM notes n JOIN sign_tracks t ON n.clip_id = t.clip_id AND n.chain_id = t.chain_id JOIN {_AT} a ON n.clip_id = a.clip_id AND n.chain_id = a.chain_id GROUP BY ALL) i ON v.clip_id = i.clip_id"""),
        "cache_keys": """
            SELECT p_partkey AS clip_id, substr(sha256('{"conf":' || CASE WHEN p_partkey % 2 = 0 THEN '0.25' ELSE '0.5' END || ',"equirect_pad_ratio":0.0,"max_frames":' || CASE WHEN p_partkey % 5 = 0 THEN p_partkey::VARCHAR ELSE 'null' END
                || ',"model":"m' || p_partkey % 3 || '","policy":"face=blur","profile":"p' || p_partkey % 2 || '","projection":"auto","tile_trigger_width":5760}'), 1, 12) AS det_key,
                substr(sha256('{"tracker":"flow","width":' || p_partkey % 4 * 480 || '}'), 1, 12) AS track_key FROM part""",
        "cache_reuse": """
            WITH w AS (SELECT DISTINCT p_partkey AS clip_id, 'd' || p_partkey % 7 AS det_key, 't' || p_partkey % 5 AS track_key FROM part),
            k AS (SELECT user_id AS clip_id, 'd' || event_id % 11 AS det_key, 't' || event_id % 3 AS track_key FROM events WHERE event_id % 2 = 0)
            SELECT w.*, CASE WHEN EXISTS (FROM k WHERE k = w) THEN 'cached' WHEN b IS NULL THEN 'detect' ELSE 'retrack' END AS action, CASE WHEN NOT EXISTS (FROM k WHERE k = w) THEN b END AS base
            FROM w LEFT JOIN (SELECT clip_id, det_key, min(track_key) AS b FROM k GROUP BY ALL) USING (clip_id, det_key)""".replace("k = w", "k.clip_id = w.clip_id AND k.det_key = w.det_key AND k.track_key = w.track_key"),
        "folder_leftovers": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-12-31 23:59:00'",
        "manifest_put": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT p_partkey * 2 FROM part WHERE p_partkey % 3 = 0) UNION ALL SELECT p_partkey * 2, 'new' FROM part WHERE p_partkey % 3 = 0",
        "creation_times": """
            SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.250' END AS local,
                   CASE WHEN o_orderkey % 11 <> 0 THEN ([0, 120, -210, 0, 330])[o_orderkey % 5 + 1] END AS offset_min, CASE WHEN o_orderkey % 11 <> 0 THEN (['+00:00', '+02:00', '-03:30', '+00:00', '+05:30'])[o_orderkey % 5 + 1] END AS zone FROM orders""",
        "picture_index": sql("""
            SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS n, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY frame) - 1 AS VARCHAR) || '.jpg' AS file, frame, places, shapes
            FROM (SELECT clip_id, frame, string_agg(place, ',' ORDER BY place) AS places, string_agg(concat_ws(',', x1, y1, x2, y2), ',' ORDER BY place) AS shapes
                  FROM (SELECT n.*, row_number() OVER (PARTITION BY n.clip_id ORDER BY first_frame, n.chain_id) - 1 AS place FROM notes n JOIN sign_tracks t ON n.clip_id = t.clip_id AND n.chain_id = t.chain_id) GROUP BY ALL)"""),
        "overlay_marks": sql("""
            SELECT clip_id, mark, dashed, colour, count(*) AS n, count(label) AS labels, CAST(sum(CAST(round_even((x1 + 1e-6::DOUBLE) * 1000, 0) AS BIGINT)) AS BIGINT) AS sum_x1 FROM (
              SELECT clip_id, kind AS mark, source IN ('interpolated', 'padded') AS dashed, CASE cls WHEN 'face' THEN '255,0,255' ELSE '0,215,255' END AS colour, CASE WHEN source IN ('detected', 'orphan') AND k = 0 THEN cls END AS label, (x1 + k * 1920::DOUBLE) * 0.5::DOUBLE AS x1
              FROM plan, (VALUES (-1), (0), (1)) t(k)
              UNION ALL SELECT clip_id, 'rect', false, CASE cls WHEN 'sign' THEN '255,128,0' ELSE '255,255,0' END, cls, x1 * 0.5::DOUBLE FROM det WHERE grp = 'signage') GROUP BY ALL"""),
        "plan_summary": sql("""
            SELECT clip_id, count(*) FILTER (source = 'detected') AS detected, count(*) FILTER (source = 'interpolated') AS interpolated, count(*) FILTER (source = 'padded') AS padded, count(*) FILTER (source = 'orphan') AS orphan,
                   count(DISTINCT frame) AS frames_with_blur, count(DISTINCT chain_id) FILTER (cls = 'face') AS face_chains, count(DISTINCT chain_id) FILTER (cls = 'plate') AS plate_chains FROM plan GROUP BY clip_id"""),
        "timings_total": "SELECT event_type AS key, sum(event_id % 1000 / 8.0::DOUBLE) AS seconds FROM events GROUP BY event_type",
        "progress_reports": """
            WITH r AS (SELECT user_id % 40 AS job_id, CASE WHEN event_id % 2 = 0 THEN 'rendering' ELSE 'analyzing' END AS phase, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS "at", max(event_id) AS done FROM events GROUP BY ALL),
            t AS (SELECT *, CASE WHEN done % 3 <> 0 THEN greatest(done, 1000) * 2 END AS total FROM r)
            SELECT job_id, phase, "at", done, total, round(100 * (CASE phase WHEN 'rendering' THEN 0.7::DOUBLE ELSE 0 END + CASE phase WHEN 'rendering' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END * coalesce(done / total, 0)), 6) AS percent,
                   CASE WHEN total IS NOT NULL AND done > 0 THEN CAST(round_even(600 / done * (total - done), 0) AS BIGINT) END AS eta_s FROM t""",
        "job_status_json": sql("""
            SELECT id, '{"job_id":"' || id || '","status":"' || status || '","phase":null,"progress":{"percent":' || CASE WHEN status = 'succeeded' THEN '100.0' ELSE '0.0' END || ',"frames_done":' || frames || ',"frames_total":' || CASE WHEN id % 2 = 0 THEN frames::VARCHAR ELSE 'null' END
                || '},"eta_s":null,"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z","started_at":null,"finished_at":null,"expires_at":null,"error":' || CASE WHEN status = 'failed' THEN '{"code":"job_failed","message":"no frames"}' ELSE 'null' END
                || ',"links":{"self":"/jobs/' || id || '","video":"/jobs/' || id || '/video","metadata":"/jobs/' || id || '/metadata"' || CASE WHEN id % 3 = 0 THEN ',"debug":"/jobs/' || id || '/debug"' ELSE '' END || '}}' AS body FROM jobs"""),
    }
