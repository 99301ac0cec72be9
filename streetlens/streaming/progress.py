"""Progress of jobs: at most one report a job and second, over both phases of its work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The share of each phase before and in the work of a job.
BEFORE = {"analyzing": 0.0, "rendering": 0.7}
SHARE = {"analyzing": 0.7, "rendering": 0.3}


def _of(table: dict[str, float]):
    return F.element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), F.col("phase"))


def throttled(reports: DataFrame, late: str | None = "10 seconds") -> DataFrame:
    """(job_id, phase, at, done, total, percent, eta_s) from reports (job_id, phase, at, started_at, done, total).

    Of the reports of a job and phase in one second the last stays (of equal
    times the one that is furthest). Percent counts both phases; the rest takes
    as long a frame as the phase took so far; null where the total is unknown.
    Works on tables and, with ``late`` as the watermark, on streams.
    """
    timed = reports.withWatermark("at", late) if reports.isStreaming and late else reports
    last = F.max_by(F.struct("at", "started_at", "done", "total"), F.struct("at", "done"))
    kept = timed.groupBy("job_id", "phase", F.window("at", "1 second")).agg(last.alias("r")).select("job_id", "phase", "r.*")
    part = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0)
    elapsed = (F.unix_micros("at") - F.unix_micros("started_at")) / 1e6
    eta = F.when((F.col("total") > 0) & (F.col("done") > 0), F.rint(elapsed / F.col("done") * (F.col("total") - F.col("done"))).cast("long"))
    return kept.select("job_id", "phase", "at", "done", "total", (100 * (_of(BEFORE) + _of(SHARE) * part)).alias("percent"), eta.alias("eta_s"))
