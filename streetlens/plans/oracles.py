"""DuckDB SQL for the registered queries, as one chain of common table expressions."""

from __future__ import annotations

# Each entry may use the ones before it.
CTE = {
    "det0": """
        SELECT user_id AS clip_id, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS frame, event_id AS seq,
               CASE WHEN event_type IN ('click', 'error') THEN 'face' WHEN event_type = 'view' THEN 'plate' WHEN event_type = 'purchase' THEN 'sign' ELSE 'direction' END AS cls
        FROM events""",
    "det1": """
        SELECT *, CASE WHEN cls IN ('face', 'plate') THEN cls ELSE 'signage' END AS grp, CAST((seq * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
               CAST((clip_id * 53 + frame * 3 + seq % 7) % 1900 AS DOUBLE) AS x1, CAST((clip_id * 31 + frame) % 1000 AS DOUBLE) AS y1
        FROM det0""",
    "det": """
        SELECT *, x1 + CAST(seq % 41 + 20 AS DOUBLE) AS x2, y1 + CAST(seq % 23 + 20 AS DOUBLE) AS y2,
               CASE WHEN seq % 3 <> 0 THEN grp || ':' || CAST(frame // 48 AS VARCHAR) END AS track_id, CASE WHEN seq % 2 = 0 THEN 'g1024' ELSE 'g2048' END AS pass_id
        FROM det1""",
    "chained": "SELECT *, coalesce(track_id, grp || ':~' || CAST(seq AS VARCHAR)) AS chain_id FROM det WHERE grp IN ('face', 'plate')",
    "signs": "SELECT *, coalesce(track_id, grp || ':~' || CAST(seq AS VARCHAR)) AS chain_id FROM det WHERE grp = 'signage'",
    "cls_n": "SELECT clip_id, chain_id, cls, count(*) AS n, min(frame * 100000000 + seq) AS first FROM chained GROUP BY ALL",
    "classes": "SELECT clip_id, chain_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, chain_id ORDER BY n DESC, first) AS r FROM cls_n) WHERE r = 1",
    "lagged": """
        SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2, count(*) OVER (PARTITION BY clip_id, chain_id) AS chain_n
        FROM chained WINDOW w AS (PARTITION BY clip_id, chain_id ORDER BY frame, seq)""",
    "parts0": """
        SELECT *, sum(CASE WHEN sqrt(((x1 + x2) / 2 - (px1 + px2) / 2) ** 2 + ((y1 + y2) / 2 - (py1 + py2) / 2) ** 2) / greatest(x2 - x1, y2 - y1, px2 - px1, py2 - py1, 1) > 20 THEN 1 ELSE 0 END)
               OVER (PARTITION BY clip_id, chain_id ORDER BY frame, seq) AS part FROM lagged""",
    "parts": "SELECT *, max(score) OVER (PARTITION BY clip_id, chain_id, part) AS part_score FROM parts0",
    "seg0": "SELECT *, frame - lag(frame) OVER (PARTITION BY clip_id, chain_id, part ORDER BY frame, seq) AS gap FROM parts WHERE part_score >= 0.15",
    "seg": "SELECT *, sum(CASE WHEN gap <= 49 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, chain_id ORDER BY frame, seq) - 1 AS segment FROM seg0",
    "per_frame": "SELECT clip_id, chain_id, segment, frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(chain_n) AS chain_n FROM seg GROUP BY ALL",
    "ahead": """
        SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2
        FROM per_frame WINDOW w AS (PARTITION BY clip_id, chain_id, segment ORDER BY frame)""",
    "stepped": "SELECT *, unnest(range(0, coalesce(nf - frame, 1))) AS step, CAST(coalesce(nf - frame, 1) AS DOUBLE) AS g FROM ahead",
    "dense": """
        SELECT clip_id, chain_id, segment, frame + step AS frame, step = 0 AS observed, chain_n,
               CASE WHEN step = 0 THEN x1 ELSE x1 + (nx1 - x1) * (step / g) END AS x1, CASE WHEN step = 0 THEN y1 ELSE y1 + (ny1 - y1) * (step / g) END AS y1,
               CASE WHEN step = 0 THEN x2 ELSE x2 + (nx2 - x2) * (step / g) END AS x2, CASE WHEN step = 0 THEN y2 ELSE y2 + (ny2 - y2) * (step / g) END AS y2
        FROM stepped""",
    "smoothed": """
        SELECT clip_id, chain_id, segment, frame, observed, chain_n,
               least(x1, avg(x1) OVER w) AS x1, least(y1, avg(y1) OVER w) AS y1, greatest(x2, avg(x2) OVER w) AS x2, greatest(y2, avg(y2) OVER w) AS y2
        FROM dense WINDOW w AS (PARTITION BY clip_id, chain_id, segment ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY clip_id, chain_id, segment ORDER BY frame, seq) AS up, row_number() OVER (PARTITION BY clip_id, chain_id, segment ORDER BY frame DESC, seq DESC) AS down,
               greatest(x2 - x1, y2 - y1) AS side, frame * 100000000 + seq AS place FROM seg""",
    "head": """
        SELECT clip_id, chain_id, segment, count(*) AS n, max(side) * 0.5 AS lim, max(frame) - min(frame) AS fr,
               (arg_max(x1 + x2, place) - arg_min(x1 + x2, place)) / 2 AS dx, (arg_max(y1 + y2, place) - arg_min(y1 + y2, place)) / 2 AS dy FROM ranked WHERE up <= 5 GROUP BY ALL""",
    "tail": """
        SELECT clip_id, chain_id, segment, count(*) AS n, max(side) * 0.5 AS lim, max(frame) - min(frame) AS fr,
               (arg_max(x1 + x2, place) - arg_min(x1 + x2, place)) / 2 AS dx, (arg_max(y1 + y2, place) - arg_min(y1 + y2, place)) / 2 AS dy FROM ranked WHERE down <= 5 GROUP BY ALL""",
    "moves": """
        SELECT *, CASE WHEN n < 3 OR fr <= 0 THEN 0 ELSE greatest(-lim, least(lim, dx / fr)) END AS vx, CASE WHEN n < 3 OR fr <= 0 THEN 0 ELSE greatest(-lim, least(lim, dy / fr)) END AS vy
        FROM (SELECT *, -1 AS sign FROM head UNION ALL SELECT *, 1 AS sign FROM tail)""",
    "ends": """
        SELECT clip_id, chain_id, segment, -1 AS sign, frame, x1, y1, x2, y2 FROM smoothed QUALIFY row_number() OVER (PARTITION BY clip_id, chain_id, segment ORDER BY frame) = 1
        UNION ALL SELECT clip_id, chain_id, segment, 1, frame, x1, y1, x2, y2 FROM smoothed QUALIFY row_number() OVER (PARTITION BY clip_id, chain_id, segment ORDER BY frame DESC) = 1""",
    "padded": """
        SELECT clip_id, chain_id, segment, frame + sign * k AS frame, x1 + sign * vx * k - (x2 - x1) * (0.05::DOUBLE * k / 2) AS x1, y1 + sign * vy * k - (y2 - y1) * (0.05::DOUBLE * k / 2) AS y1,
               x2 + sign * vx * k + (x2 - x1) * (0.05::DOUBLE * k / 2) AS x2, y2 + sign * vy * k + (y2 - y1) * (0.05::DOUBLE * k / 2) AS y2
        FROM ends JOIN moves USING (clip_id, chain_id, segment, sign), range(1, 13) t(k)""",
    "region": """
        SELECT clip_id, chain_id, segment, frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(p) AS p, bool_or(one AND p = 3) AS one
        FROM (SELECT clip_id, chain_id, segment, frame, x1, y1, x2, y2, CASE WHEN observed THEN 3 ELSE 2 END AS p, chain_n = 1 AS one FROM smoothed
              UNION ALL SELECT clip_id, chain_id, segment, frame, x1, y1, x2, y2, 1, false FROM padded)
        WHERE frame >= 0 AND frame < 720 GROUP BY ALL""",
    "regions": "SELECT clip_id, chain_id, segment, frame, x1, y1, x2, y2, CASE WHEN p = 3 AND one THEN 'orphan' WHEN p = 3 THEN 'detected' WHEN p = 2 THEN 'interpolated' ELSE 'padded' END AS source FROM region",
    "wide": """
        SELECT r.clip_id, r.chain_id, segment, frame, CASE WHEN cls = 'face' THEN 'ellipse' ELSE 'rect' END AS kind, cls, source,
               x1 - (x2 - x1) * 0.1::DOUBLE AS x1, y1 - (y2 - y1) * 0.1::DOUBLE AS y1, x2 + (x2 - x1) * 0.1::DOUBLE AS x2, y2 + (y2 - y1) * 0.1::DOUBLE AS y2
        FROM regions r JOIN classes c ON r.clip_id = c.clip_id AND r.chain_id = c.chain_id""",
    "plan": "SELECT * FROM wide WHERE least(x2, 1920) > greatest(x1, 0) AND least(y2, 1080) > greatest(y1, 0)",
    "shown": "SELECT * FROM plan",
    "sized": "SELECT *, CASE WHEN seq % 5 = 0 THEN -0.35::DOUBLE ELSE 0.1::DOUBLE END AS more FROM det WHERE grp IN ('face', 'plate')",
    "truth": """
        SELECT clip_id, coalesce(track_id, grp || ':~' || CAST(seq AS VARCHAR)) AS track, cls, frame, seq, seq % 2 = 0 AS readable,
               x1 - (x2 - x1) * more AS x1, y1 - (y2 - y1) * more AS y1, x2 + (x2 - x1) * more AS x2, y2 + (y2 - y1) * more AS y2 FROM sized""",
    "grid": "SELECT *, CAST(least(16, ceil(x2 - x1)) AS BIGINT) AS nx, CAST(least(16, ceil(y2 - y1)) AS BIGINT) AS ny FROM truth",
    "points": "SELECT t.*, t.x1 + ((k % nx) + 0.5::DOUBLE) * (t.x2 - t.x1) / nx AS px, t.y1 + ((k // nx) + 0.5::DOUBLE) * (t.y2 - t.y1) / ny AS py, k FROM grid t, range(256) g(k) WHERE k < nx * ny",
    "round": "SELECT clip_id, frame, chain_id, kind, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (x2 - x1) / 2 AS rx2, (y2 - y1) * (y2 - y1) / 2 AS ry2 FROM shown",
    "hit": """
        SELECT p.clip_id, p.track, p.seq, p.k, coalesce(bool_or(CASE WHEN s.kind = 'ellipse' THEN (px - cx) * (px - cx) * ry2 + (py - cy) * (py - cy) * rx2 <= rx2 * ry2 ELSE px BETWEEN s.x1 AND s.x2 AND py BETWEEN s.y1 AND s.y2 END), false) AS inside
        FROM points p LEFT JOIN round s ON p.clip_id = s.clip_id AND p.frame = s.frame GROUP BY ALL""",
    "cover": "SELECT clip_id, track, seq, count(*) FILTER (inside) / CAST(count(*) AS DOUBLE) AS coverage FROM hit GROUP BY ALL",
    "per_track": """
        SELECT t.clip_id, t.track, count(DISTINCT s.chain_id) AS chains FROM (SELECT *, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM truth) t
        LEFT JOIN round s ON t.clip_id = s.clip_id AND t.frame = s.frame AND CASE WHEN s.kind = 'ellipse' THEN (px - cx) * (px - cx) * ry2 + (py - cy) * (py - cy) * rx2 <= rx2 * ry2 ELSE px BETWEEN s.x1 AND s.x2 AND py BETWEEN s.y1 AND s.y2 END GROUP BY ALL""",
    "objects": """
        SELECT t.clip_id, t.track, cls, frame, t.seq, readable, coverage, coverage >= 0.9 AS protected,
               CASE WHEN y2 - y1 < 16 THEN '<16px' WHEN y2 - y1 < 32 THEN '16-32px' WHEN y2 - y1 < 96 THEN '32-96px' ELSE '>96px' END AS size
        FROM truth t JOIN cover c ON t.clip_id = c.clip_id AND t.track = c.track AND t.seq = c.seq""",
    "sign_tracks": """
        SELECT clip_id, chain_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame, max(score) AS confidence_max, avg(score) AS confidence_mean
        FROM signs GROUP BY ALL HAVING count(*) >= 5 AND max(score) >= 0.6""",
    "best": """
        SELECT s.* FROM signs s SEMI JOIN sign_tracks USING (clip_id, chain_id)
        QUALIFY row_number() OVER (PARTITION BY clip_id, chain_id ORDER BY score * ((x2 - x1) * (y2 - y1)) DESC, frame, seq) = 1""",
    "notes": """
        SELECT clip_id, chain_id, frame, CAST(round_even(x1, 0) AS BIGINT) AS x1, CAST(round_even(y1, 0) AS BIGINT) AS y1, CAST(round_even(least(x2, 1920), 0) AS BIGINT) AS x2, CAST(round_even(least(y2, 1080), 0) AS BIGINT) AS y2, frame / 24::DOUBLE AS time FROM best""",
    "gps": "SELECT DISTINCT clip_id, k * 50 / 24::DOUBLE AS time, 45 + clip_id / 1000::DOUBLE + k / 10000::DOUBLE AS lat, 5 + clip_id / 2000::DOUBLE - k / 20000::DOUBLE AS lon FROM det, range(0, 14) t(k)",
    "jobs": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN (o_orderkey * 37) % 25000 END AS duration_s, o_orderkey % 3000 AS frames FROM orders""",
}


# In a frame that closes at 1900 pixels chains are unwrapped first, and shapes come back to the frame and are seen a turn to either side.
AROUND = {
    "chained": """
        SELECT clip_id, chain_id, frame, seq, cls, grp, score, track_id, y1, y2, x1 + 1900 * sum(step) OVER w AS x1, x2 + 1900 * sum(step) OVER w AS x2
        FROM (SELECT *, coalesce(round_even((lag((x1 + x2) / 2) OVER v - (x1 + x2) / 2) / 1900, 0), 0) AS step FROM flat WINDOW v AS (PARTITION BY clip_id, chain_id ORDER BY frame, seq)) WINDOW w AS (PARTITION BY clip_id, chain_id ORDER BY frame, seq)""",
    "plan": "SELECT * REPLACE (x1 - floor(x1 / 1900) * 1900 AS x1, x2 - floor(x1 / 1900) * 1900 AS x2) FROM wide WHERE y2 > 0 AND y1 < 1080",
    "shown": "SELECT * REPLACE (x1 + k * 1900 AS x1, x2 + k * 1900 AS x2) FROM plan, (VALUES (-1), (0), (1)) t(k)",
}


def sql(select: str, around: bool = False) -> str:
    known = dict(CTE)
    if around:
        known = {}
        for name, body in CTE.items():
            if name == "chained":
                known["flat"] = body
            known[name] = AROUND.get(name, body)
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in known.items()) + "\n" + select


BOX = ", ".join(f"round({c} + 0.000001::DOUBLE, 3) + 0.0::DOUBLE AS {c}" for c in ("x1", "y1", "x2", "y2"))
EXPOSED = """(SELECT clip_id, track, island, count(*) AS run FROM (SELECT clip_id, track, frame, frame - row_number() OVER (PARTITION BY clip_id, track ORDER BY frame) AS island
           FROM (SELECT DISTINCT clip_id, track, frame FROM objects WHERE NOT protected {and_})) GROUP BY ALL)"""

BRIEF = """NOT protected AND EXISTS (FROM objects p WHERE p.protected AND p.clip_id = o.clip_id AND p.track = o.track AND p.frame BETWEEN o.frame - 48 AND o.frame - 1)
          AND EXISTS (FROM objects p WHERE p.protected AND p.clip_id = o.clip_id AND p.track = o.track AND p.frame BETWEEN o.frame + 1 AND o.frame + 48)"""
_TRACKS = "(SELECT count(DISTINCT (clip_id, track)) FROM objects{})"
SUMMARY = f"""
        (SELECT count(DISTINCT clip_id) FROM objects) AS clips, (SELECT count(*) FROM objects) AS object_frames, (SELECT count(*) FROM objects WHERE NOT protected) AS unprotected,
        (SELECT count(*) FROM objects WHERE readable) AS readable_object_frames, (SELECT count(*) FROM objects WHERE readable AND NOT protected) AS readable_unprotected,
        {_TRACKS.format("")} AS tracks, {_TRACKS.format(" WHERE NOT protected")} AS tracks_ever_leaked, {_TRACKS.format(" WHERE readable")} AS readable_tracks, {_TRACKS.format(" WHERE readable AND NOT protected")} AS readable_tracks_ever_leaked,
        coalesce((SELECT max(run) FROM {EXPOSED.format(and_='')}), 0) AS longest_exposure_frames, coalesce((SELECT max(run) FROM {EXPOSED.format(and_='AND readable')}), 0) AS longest_exposure_frames_readable,
        (SELECT count(*) FROM objects o WHERE {BRIEF.replace("48", "8")}) AS transient_exposures, round_even((SELECT avg(chains) FROM per_track), 3) AS mean_chains_per_track,
        round_even((SELECT avg(CASE WHEN protected THEN 0 ELSE 1 END) FROM objects), 5) AS leakage_rate, round_even((SELECT avg(CASE WHEN protected THEN 0 ELSE 1 END) FROM objects WHERE readable), 5) AS readable_leakage_rate"""

ORACLE = {
    "cvat_expand": sql(f"""
        SELECT clip_id, track, frame + k AS frame, readable, {BOX} FROM (
          SELECT clip_id, track, frame, k, readable, {", ".join(f"CASE WHEN k > 0 AND nout IS NOT NULL AND NOT nout THEN {c} + (n{c} - {c}) * (k / CAST(nf - frame AS DOUBLE)) ELSE {c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))}
          FROM (SELECT *, unnest(range(0, least(coalesce(nf, 720), 720) - frame)) AS k FROM (
            SELECT clip_id, track_id AS track, frame, seq % 4 = 0 AS outside, seq % 2 = 0 AS readable, x1, y1, x2, y2, lead(frame) OVER w AS nf, lead(seq % 4 = 0) OVER w AS nout, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2
            FROM (FROM det WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id, track_id, frame ORDER BY seq DESC) = 1) WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame))
          WHERE NOT outside))"""),
    "keyframe_thin": sql("""
        , seen AS (SELECT DISTINCT clip_id, chain_id, frame FROM chained),
        cut AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip_id, chain_id ORDER BY frame) > 48 THEN 1 ELSE 0 END AS new FROM seen),
        piece AS (SELECT clip_id, chain_id, frame, CAST(sum(new) OVER (PARTITION BY clip_id, chain_id ORDER BY frame) AS BIGINT) AS segment FROM cut),
        hop AS (SELECT *, min(frame) OVER (PARTITION BY clip_id, chain_id, segment ORDER BY frame RANGE BETWEEN 20 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM piece),
        kept AS (
          SELECT clip_id, chain_id, segment, min(frame) AS frame FROM piece GROUP BY ALL
          UNION ALL SELECT h.clip_id, h.chain_id, h.segment, h.next FROM kept k JOIN hop h ON k.clip_id = h.clip_id AND k.chain_id = h.chain_id AND k.frame = h.frame WHERE h.next IS NOT NULL)
        SELECT clip_id, chain_id, segment, frame FROM kept UNION SELECT clip_id, chain_id, segment, max(frame) FROM piece GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1),
    "keep_regions": sql("""
        SELECT p.clip_id, p.chain_id, CAST(segment AS INT) AS segment, frame, score FROM plan p
        JOIN (SELECT clip_id, chain_id, max(score) AS score FROM parts WHERE part_score >= 0.15 AND track_id IS NOT NULL GROUP BY ALL) s ON p.clip_id = s.clip_id AND p.chain_id = s.chain_id WHERE score < 0.5"""),
    "orphan_antijoin": sql("SELECT DISTINCT clip_id FROM det ANTI JOIN sign_tracks USING (clip_id)"),
    "sweep_grid": "SELECT margin, padding, conf_blur FROM (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) a(margin), (VALUES (0.0::DOUBLE), (12.0::DOUBLE)) b(padding), (VALUES (0.15::DOUBLE), (0.3::DOUBLE)) c(conf_blur)",
    "model_select": "SELECT p_brand AS family, coalesce(max_by(p_partkey, p_size::BIGINT * 1000000000 + p_partkey) FILTER (p_size <= 20), min_by(p_partkey, p_size::BIGINT * 1000000000 + p_partkey)) AS name FROM part GROUP BY p_brand",
    "speed_median": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_value, count(*) AS n FROM events GROUP BY event_type",
    "seam_split": sql("SELECT seq, CAST(0 AS BIGINT) AS part, x1 AS part_left, least(x2, 1900) AS part_right FROM det UNION ALL SELECT seq, 1, 0, least(x2 - 1900, x1) FROM det WHERE x2 > 1900"),
    "ndjson_roundtrip": sql("SELECT clip_id, frame, seq, cls, score, track_id, x1, y1, x2, y2 FROM det"),
    "ndjson_check": sql("SELECT DISTINCT clip_id, CAST(NULL AS VARCHAR) AS problem FROM det"),
    "detection_counts": sql("SELECT cls, count(*) AS detections, count(*) FILTER (track_id IS NULL) AS orphans FROM det GROUP BY cls"),
    "fragments": sql("SELECT clip_id, coalesce(track_id, grp || ':~' || CAST(seq AS VARCHAR)) AS fragment, min(grp) AS grp, min(frame) AS start, max(frame) AS \"end\", count(*) AS n, max(score) AS best_score FROM det GROUP BY 1, 2"),
    "majority_class": sql("SELECT clip_id, chain_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, chain_id ORDER BY n DESC, first) AS r FROM (SELECT clip_id, chain_id, cls, count(*) AS n, min(frame * 100000000 + seq) AS first FROM signs GROUP BY ALL)) WHERE r = 1"),
    "iou_pairs": sql("""
        SELECT clip_id, seq_a, seq_b, round(i / (aa + ba - i), 6) AS iou, round(i / least(aa, ba), 6) AS iomin FROM (
          SELECT a.clip_id, a.seq AS seq_a, b.seq AS seq_b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba
          FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.grp = b.grp AND a.seq < b.seq)"""),
    "jump_split": sql("SELECT clip_id, chain_id, seq, CAST(part AS BIGINT) AS part FROM parts"),
    "gap_split": sql("SELECT clip_id, chain_id, seq, CAST(segment AS INT) AS segment FROM seg"),
    "densify": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, observed, {BOX} FROM dense"),
    "smooth_envelope": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, observed, {BOX} FROM smoothed"),
    "temporal_padding": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, {BOX} FROM padded"),
    "region_union": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, source, {BOX} FROM regions"),
    "blur_plan": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, kind, cls, source, {BOX} FROM plan"),
    "plan_stats": sql("""
        SELECT clip_id, key, CAST(n AS BIGINT) AS n FROM (
          SELECT clip_id, 'chains' AS key, count(*) AS n FROM classes GROUP BY ALL
          UNION ALL SELECT clip_id, 'chains_below_threshold', count(*) FILTER (low = total) FROM (SELECT clip_id, chain_id, count(DISTINCT part) FILTER (part_score < 0.15) AS low, count(DISTINCT part) AS total FROM parts GROUP BY ALL) GROUP BY ALL
          UNION ALL SELECT clip_id, 'parts_below_threshold', sum(CASE WHEN low < total THEN low ELSE 0 END) FROM (SELECT clip_id, chain_id, count(DISTINCT part) FILTER (part_score < 0.15) AS low, count(DISTINCT part) AS total FROM parts GROUP BY ALL) GROUP BY ALL
          UNION ALL SELECT clip_id, 'boxes_' || source, count(*) FROM plan GROUP BY ALL
          UNION ALL SELECT clip_id, 'frames_with_blur', count(DISTINCT frame) FROM plan GROUP BY ALL)"""),
    "coverage": sql("SELECT clip_id, track, cls, frame, seq, size, readable, coverage, protected FROM objects"),
    "leakage_rollup": sql("""
        SELECT CASE WHEN g = 7 THEN 'overall' WHEN g = 3 THEN 'class=' || cls WHEN g = 5 THEN 'size=' || size ELSE 'readable=' || CAST(readable AS VARCHAR) END AS slice, n, unprotected, round(unprotected / n, 5) AS rate
        FROM (SELECT cls, size, readable, grouping(cls, size, readable) AS g, count(*) AS n, count(*) FILTER (NOT protected) AS unprotected FROM objects GROUP BY GROUPING SETS ((), (cls), (size), (readable)))"""),
    "exposure_islands": sql(f"SELECT clip_id, track, CAST(sum(run) AS BIGINT) AS exposed, max(run) AS longest FROM {EXPOSED.format(and_='')} GROUP BY ALL"),
    "transient_exposures": sql(f"SELECT clip_id, count(*) AS transient FROM objects o WHERE {BRIEF} GROUP BY ALL"),
    "chains_per_track": sql("SELECT clip_id, track, chains FROM per_track"),
    "seam_plan": sql(f"SELECT clip_id, chain_id, CAST(segment AS INT) AS segment, frame, kind, cls, source, {BOX} FROM plan", True),
    "seam_coverage": sql("SELECT clip_id, track, cls, frame, seq, size, readable, coverage, protected FROM objects", True),
    "seam_chains_per_track": sql("SELECT clip_id, track, chains FROM per_track", True),
    "benchmark_summary": sql(f"SELECT {SUMMARY}"),
    "privacy_gate": sql(f"""
        SELECT failures = '' AS passed, failures FROM (SELECT concat_ws('; ', CASE WHEN readable_leakage_rate > 0.01 THEN 'leakage rate of readable objects ' || printf('%.2f', round_even(readable_leakage_rate * 100, 2)) || '% > 1.00%' END,
          CASE WHEN longest_exposure_frames_readable > 3 THEN 'a readable object stayed exposed ' || longest_exposure_frames_readable || ' consecutive frames > 3' END) AS failures FROM (SELECT {SUMMARY}))"""),
    "seam_annotations": sql("""
        SELECT clip_id, chain_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(greatest(x2, x1 + 1) AS BIGINT) AS x2, CAST(greatest(y2, y1 + 1) AS BIGINT) AS y2 FROM (
          SELECT clip_id, chain_id, CASE seq % 4 WHEN 0 THEN l WHEN 1 THEN y1 WHEN 2 THEN 1900 - r ELSE 1080 - least(y2, 1080) END AS x1, CASE seq % 4 WHEN 0 THEN y1 WHEN 1 THEN 1900 - r WHEN 2 THEN 1080 - least(y2, 1080) ELSE l END AS y1,
                 CASE seq % 4 WHEN 0 THEN r WHEN 1 THEN least(y2, 1080) WHEN 2 THEN 1900 - l ELSE 1080 - y1 END AS x2, CASE seq % 4 WHEN 0 THEN least(y2, 1080) WHEN 1 THEN 1900 - l WHEN 2 THEN 1080 - y1 ELSE r END AS y2
          FROM (SELECT *, CASE WHEN x2 <= 1900 OR 1900 - x1 >= x2 - 1900 THEN x1 ELSE 0 END AS l, CASE WHEN x2 <= 1900 THEN x2 WHEN 1900 - x1 >= x2 - 1900 THEN 1900 ELSE x2 - 1900 END AS r FROM best))"""),
    "sign_facts": sql("""
        SELECT n.clip_id, n.chain_id, c.cls, n.x1, n.y1, n.x2, n.y2, n.frame AS best_frame, round_even(n.frame / 24::DOUBLE, 3) AS best_timestamp, first_frame, round_even(first_frame / 24::DOUBLE, 3) AS first_timestamp, last_frame, round_even(last_frame / 24::DOUBLE, 3) AS last_timestamp,
               n AS observations, confidence_max, round_even(confidence_mean, 3) AS confidence_mean,
               '[{"key":"osm|traffic_sign","value":"yes"},{"key":"detection_model[osm|traffic_sign=yes]","value":"lens-m/unknown"},{"key":"detection_confidence[osm|traffic_sign=yes]","value":"' || printf('%.3f', b.score) || '"}]' AS semantics
        FROM notes n JOIN sign_tracks t ON n.clip_id = t.clip_id AND n.chain_id = t.chain_id JOIN best b ON n.clip_id = b.clip_id AND n.chain_id = b.chain_id
        JOIN (SELECT clip_id, chain_id, arg_max(cls, o) AS cls FROM (SELECT clip_id, chain_id, cls, count(*) * 1000000000000000 - min(frame * 100000000 + seq) AS o FROM signs GROUP BY clip_id, chain_id, cls) GROUP BY clip_id, chain_id) c ON n.clip_id = c.clip_id AND n.chain_id = c.chain_id"""),
    "sure_detections": sql("SELECT clip_id, seq FROM det WHERE score >= 0.1 AND frame < 500"),
    "worth_annotating": sql("SELECT clip_id, chain_id, seq FROM chained SEMI JOIN (SELECT clip_id, chain_id FROM chained GROUP BY ALL HAVING max(score) >= 0.6 AND count(DISTINCT frame) >= 2) USING (clip_id, chain_id)"),
    "chain_ratios": sql("SELECT *, detections / chains_blurred AS detections_per_blurred_chain FROM (SELECT count(*) AS detections, count(DISTINCT (clip_id, chain_id)) AS chains FROM chained), (SELECT count(DISTINCT (clip_id, chain_id)) AS chains_blurred FROM plan)"),
    "annotated_clips": sql("SELECT clip_id, count(*) AS boxes FROM truth SEMI JOIN part ON p_partkey = clip_id GROUP BY ALL"),
    "wrapped_iou": sql("SELECT seq, round((x2 - x1 - 5) * (y2 - y1 - 2) / (2 * (x2 - x1) * (y2 - y1) - (x2 - x1 - 5) * (y2 - y1 - 2)), 6) AS iou FROM det"),
    "overlay_match": sql("""
        SELECT p.clip_id, p.chain_id, CAST(segment AS INT) AS segment, p.frame, arg_max(d.score, {'i': i / (a + b - i), 's': -d.seq}) AS score FROM (
          SELECT p.*, d.seq AS dseq, greatest(0, least(p.x2, d.x2) - greatest(p.x1, d.x1)) * greatest(0, least(p.y2, d.y2) - greatest(p.y1, d.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) AS a, (d.x2 - d.x1) * (d.y2 - d.y1) AS b
          FROM plan p JOIN det d ON p.clip_id = d.clip_id AND p.frame = d.frame AND p.cls = d.cls) p JOIN det d ON d.seq = p.dseq WHERE i / least(a, b) >= 0.5 GROUP BY ALL"""),
    "sign_tracks": sql("SELECT clip_id, chain_id, n, first_frame, last_frame, confidence_max, round(confidence_mean, 6) AS confidence_mean FROM sign_tracks"),
    "best_observation": sql("SELECT clip_id, chain_id, frame, seq, score FROM best"),
    "annotations": sql("SELECT clip_id, chain_id, frame, x1, y1, x2, y2, round(time, 6) AS time FROM notes"),
    "best_frames": sql("SELECT clip_id, frame, count(*) AS annotations, min(chain_id) AS first_chain FROM notes GROUP BY ALL"),
    "gps_asof": sql("""
        SELECT clip_id, chain_id, round(CASE WHEN b_time IS NOT NULL THEN a_lat + (b_lat - a_lat) * CASE WHEN b_time > a_time THEN (time - a_time) / (b_time - a_time) ELSE 0 END WHEN time - a_time <= 1 THEN a_lat END, 6) AS lat,
               round(CASE WHEN b_time IS NOT NULL THEN a_lon + (b_lon - a_lon) * CASE WHEN b_time > a_time THEN (time - a_time) / (b_time - a_time) ELSE 0 END WHEN time - a_time <= 1 THEN a_lon END, 6) AS lon
        FROM (SELECT n.clip_id, n.chain_id, n.time, a.time AS a_time, a.lat AS a_lat, a.lon AS a_lon FROM notes n ASOF JOIN gps a ON n.clip_id = a.clip_id AND n.time >= a.time) x
        LEFT JOIN (SELECT n.clip_id, n.chain_id, min(g.time) AS b_time, arg_min(g.lat, g.time) AS b_lat, arg_min(g.lon, g.time) AS b_lon FROM notes n JOIN gps g ON n.clip_id = g.clip_id AND g.time >= n.time GROUP BY ALL) y USING (clip_id, chain_id)"""),
    "unwrap_track": sql("""
        SELECT clip_id, chain_id, seq, CAST(sum(step) OVER (PARTITION BY clip_id, chain_id ORDER BY frame, seq) AS BIGINT) AS turns
        FROM (SELECT *, coalesce(round_even((lag((x1 + x2) / 2) OVER (PARTITION BY clip_id, chain_id ORDER BY frame, seq) - (x1 + x2) / 2) / 1900, 0), 0) AS step FROM chained)"""),
    "size_bucket": sql("SELECT cls, CASE WHEN y2 - y1 < 16 THEN '<16px' WHEN y2 - y1 < 32 THEN '16-32px' WHEN y2 - y1 < 96 THEN '32-96px' ELSE '>96px' END AS size, count(*) AS n FROM det GROUP BY ALL"),
    "seam_copies": sql("SELECT seq, k AS turn, x1 + k * 1900::DOUBLE AS x1, x2 + k * 1900::DOUBLE AS x2 FROM det, (VALUES (-1), (0), (1)) t(k)"),
    "fragmentation": sql("SELECT grp, count(*) AS detections, round(count(track_id) / count(*), 6) AS tracked_share, count(DISTINCT track_id || '@' || CAST(clip_id AS VARCHAR)) AS tracks FROM det GROUP BY grp"),
    "job_claim": sql("SELECT id, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1"),
    "job_counts": sql("SELECT s AS status, count(id) AS n FROM (VALUES ('queued'), ('running'), ('succeeded'), ('failed'), ('cancelled'), ('expired')) t(s) LEFT JOIN jobs ON status = s GROUP BY s"),
    "job_histogram": sql("SELECT le, count(*) FILTER (duration_s <= b) AS n FROM jobs, (VALUES ('60', 60), ('300', 300), ('900', 900), ('1800', 1800), ('3600', 3600), ('7200', 7200), ('21600', 21600), ('+Inf', 1000000000)) t(le, b) WHERE duration_s IS NOT NULL GROUP BY le"),
    "job_expiry": sql("SELECT id FROM jobs WHERE status = 'succeeded' AND created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 1440 MINUTE"),
    "job_latest": sql("SELECT clip_id AS job_id, arg_max(cls, seq) AS status, max(seq) AS seq FROM det GROUP BY clip_id"),
}
