"""Job-queue state and service metrics over a jobs table (id, status, created_at, frames, duration_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of a job and the bounds of the duration histogram in seconds.
STATES = ("queued", "running", "succeeded", "failed", "cancelled", "expired")
BOUNDS = (60, 300, 900, 1800, 3600, 7200, 21600)


def claim(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def counts(jobs: DataFrame) -> DataFrame:
    """Jobs per state, states without jobs included."""
    states = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "status string")
    return states.join(jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(jobs: DataFrame) -> DataFrame:
    """Cumulative counts of durations per bound, one pass over the jobs."""
    done = jobs.where("duration_s is not null").agg(*(F.count_if(F.col("duration_s") <= b).alias(str(b)) for b in BOUNDS), F.count(F.lit(1)).alias("+Inf"))
    return done.unpivot([], [str(b) for b in BOUNDS] + ["+Inf"], "le", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job by its sequence number, from (job_id, seq, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def expired(jobs: DataFrame, now, minutes: int) -> DataFrame:
    """Succeeded jobs whose results are older than ``minutes`` at ``now``."""
    return jobs.where((F.col("status") == "succeeded") & (F.col("created_at") < F.timestamp_add("MINUTE", F.lit(-minutes), now)))


def replay(events: DataFrame) -> DataFrame:
    """Jobs (job_id, status, phase, frames_done, frames_total, percent) from events (job_id, seq, kind, status, phase, frames_done, frames_total, percent).

    Kinds: insert, claim, progress, finish, expire. Guards are those of a row
    changed in place: the first claim and the first finish count, progress only
    between them, an expiry only after success. One window, one aggregate.
    """
    own = Window.partitionBy("job_id")
    end = F.min(F.when(F.col("kind") == "finish", F.col("seq"))).over(own)
    known = events.withColumn("_end", end).withColumn("_start", F.min(F.when((F.col("kind") == "claim") & (F.col("_end").isNull() | (F.col("seq") < F.col("_end"))), F.col("seq"))).over(own))
    runs = (F.col("kind") == "progress") & (F.col("seq") > F.col("_start")) & (F.col("_end").isNull() | (F.col("seq") < F.col("_end")))

    def last(name: str, where) -> Column:
        return F.max_by(name, F.when(where, F.col("seq")))

    jobs = known.groupBy("job_id").agg(
        F.max(F.when(F.col("seq") == F.col("_end"), F.col("status"))).alias("done"), F.max("_start").alias("start"), F.max(F.when((F.col("kind") == "expire") & (F.col("seq") > F.col("_end")), 1)).alias("old"),
        last("phase", runs).alias("phase"), last("frames_done", runs).alias("frames_done"), last("frames_total", runs & F.col("frames_total").isNotNull()).alias("frames_total"), last("percent", runs).alias("percent"),
    )
    status = F.when(F.col("done").isNull(), F.when(F.col("start").isNull(), "queued").otherwise("running")).when((F.col("done") == "succeeded") & (F.col("old") == 1), "expired").otherwise(F.col("done"))
    percent = F.when(F.col("done") == "succeeded", F.lit(100.0)).otherwise(F.coalesce("percent", F.lit(0.0)))
    return jobs.select("job_id", status.alias("status"), F.when(F.col("done").isNull(), F.col("phase")).alias("phase"), F.coalesce("frames_done", F.lit(0)).cast("long").alias("frames_done"), "frames_total", percent.alias("percent"))


def stale(jobs: DataFrame, now, minutes: int) -> DataFrame:
    """Running jobs without a heartbeat for ``minutes`` at ``now``."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < F.timestamp_add("MINUTE", F.lit(-minutes), now)))


def purged(jobs: DataFrame, now, minutes: int) -> DataFrame:
    """Jobs without the failed, cancelled and expired ones that finished more than ``minutes`` before ``now``."""
    gone = F.col("status").isin("failed", "cancelled", "expired") & (F.col("finished_at") < F.timestamp_add("MINUTE", F.lit(-minutes), now))
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def result_code(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``code``: why results can't be had, null where they can."""
    s = F.col("status")
    return jobs.withColumn("code", F.when(s == "expired", "job_expired").when(s.isin("failed", "cancelled"), "job_failed").when(s != "succeeded", "job_not_ready"))


def request_code(requests: DataFrame, hosts: tuple[str, ...], queue_max: int, max_bytes: int, sync_max_s: float) -> DataFrame:
    """``requests`` (start_frame, end_frame, callback_url, sync, queued, bytes) with ``code``: the first guard that refuses, else null."""
    host = F.coalesce(F.try_parse_url("callback_url", F.lit("HOST")), F.lit(""))
    allowed = F.lower(F.coalesce(F.try_parse_url("callback_url", F.lit("PROTOCOL")), F.lit(""))).isin("http", "https") & F.lower(host).isin(*hosts)
    code = (
        F.when(F.col("end_frame") <= F.col("start_frame"), "invalid_parameter").when(F.col("callback_url").isNotNull() & ~allowed, "callback_not_allowed")
        .when(F.col("sync") & F.lit(sync_max_s == 0), "sync_too_long").when(F.col("queued") >= queue_max, "queue_full").when(F.col("bytes") > max_bytes, "file_too_large")
    )
    return requests.withColumn("code", code)


def exposition(jobs: DataFrame) -> DataFrame:
    """(place, line): service metrics as text in the Prometheus format, one pass over jobs (status, duration_s, frames)."""
    counted = jobs.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in STATES), *(F.count_if(F.col("duration_s") <= b).alias(f"le{b}") for b in BOUNDS), F.count("duration_s").alias("done"),
        F.coalesce(F.sum("duration_s"), F.lit(0)).cast("double").alias("seconds"), F.coalesce(F.sum(F.when(F.col("duration_s").isNotNull(), F.col("frames"))), F.lit(0)).alias("total"),
    )
    lines = [F.format_string(f'jobs{{status="{s}"}} %d', s) for s in STATES] + [F.format_string("jobs_in_progress %d", "running"), F.format_string("queue_length %d", "queued")]
    lines += [F.format_string(f'job_duration_seconds_bucket{{le="{b}"}} %d', f"le{b}") for b in BOUNDS] + [F.format_string('job_duration_seconds_bucket{le="+Inf"} %d', "done")]
    lines += [F.format_string("job_duration_seconds_sum %.1f", "seconds"), F.format_string("job_duration_seconds_count %d", "done"), F.format_string("frames_processed_total %d", "total")]
    return counted.select(F.posexplode(F.array(*lines)).alias("place", "line"))


def markdown(table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(text): a small report as a Markdown table, rows in the order given."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns)
    rows = table.select(F.struct(F.col(order).alias("o"), row.alias("r")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select(F.concat_ws("\n", F.array(F.lit(head)), F.transform("x", lambda x: x["r"])).alias("text"))


def status_json(jobs: DataFrame) -> DataFrame:
    """(id, body): the public state of each job (id, status, phase, percent, frames_done, frames_total, eta_s, the four times, error_code, error_message, debug) as JSON, nulls written."""
    base = F.concat(F.lit("/jobs/"), F.col("id").cast("string"))
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) for c in ("created_at", "started_at", "finished_at", "expires_at")]
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")))
    places = F.map_concat(
        F.create_map(F.lit("self"), base, F.lit("video"), F.concat(base, F.lit("/video")), F.lit("metadata"), F.concat(base, F.lit("/metadata"))),
        F.when(F.col("debug"), F.create_map(F.lit("debug"), F.concat(base, F.lit("/debug")))).otherwise(F.create_map().cast("map<string,string>")),
    )
    progress = F.struct("percent", "frames_done", "frames_total").alias("progress")
    body = F.struct(F.col("id").cast("string").alias("job_id"), "status", "phase", progress, "eta_s", *times, error.alias("error"), places.alias("links"))
    return jobs.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def total_times(timings: DataFrame) -> DataFrame:
    """(key, seconds) summed over runs (clip_id, timings map<string,double>)."""
    return timings.select(F.explode("timings").alias("key", "s")).groupBy("key").agg(F.sum("s").alias("seconds"))
