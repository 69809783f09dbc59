"""Progress and status reports over the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import strip
from quire.functions.text import estimate_tokens
from quire.params import STATUS_NAMES

# Display rules.
RECENT_LOG = 30
SPEED_CLAMP = (0.5, 25.0)
DEFAULT_SPEED = 3.5
SLOW_FAMILY, SLOW_SPEED = "gemma", 9.0
MIN_HISTORY = 8


def _ratio(done: Column, total: Column) -> Column:
    return done * F.lit(100.0) / total


def progress_api(jobs: DataFrame) -> DataFrame:
    """Public status name and percent with half-even rounding."""
    names = F.create_map(*[F.lit(x) for pair in STATUS_NAMES.items() for x in pair])
    total = F.greatest("total_chunks", F.lit(0))
    percent = F.when(total > 0, F.bround(_ratio(F.col("completed_chunks"), total))).otherwise(0.0)
    return jobs.select(
        "job_id",
        F.coalesce(F.element_at(names, F.col("status")), F.lit("pending")).alias("status"),
        F.col("completed_chunks").alias("completed"),
        total.alias("total"),
        percent.cast("int").alias("percent"),
    )


def progress_ui(jobs: DataFrame) -> DataFrame:
    """Percent with half-up rounding."""
    total = F.col("total_chunks")
    percent = F.when(total > 0, F.floor(_ratio(F.col("completed_chunks"), total) + 0.5)).otherwise(0)
    return jobs.select("job_id", percent.cast("int").alias("percent"))


def status_counts(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    active = jobs.select(F.lit("active_jobs").alias("name"), (F.col("status") == "PROCESSING").alias("hit"))
    failed = segments.select(F.lit("failed_segments").alias("name"), (F.col("status") == "FAILED").alias("hit"))
    return active.unionByName(failed).groupBy("name").agg(F.count_if("hit").alias("n"))


def recent_log(segments: DataFrame, k: int = RECENT_LOG) -> DataFrame:
    """The last ``k`` finished segments per job as events; rank limits are applied before the shuffle."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("chunk_index"))
    return (
        segments.where(F.col("status").isin("DONE", "FAILED"))
        .select("job_id", "chunk_index", "status", "updated_at", F.row_number().over(newest).alias("rank"))
        .where(F.col("rank") <= k)
        .select(
            "job_id", "rank", "chunk_index",
            F.when(F.col("status") == "DONE", "segment_completed").otherwise("segment_failed").alias("type"),
            F.col("updated_at").alias("timestamp"),
        )
    )


def latest_segment(segments: DataFrame) -> DataFrame:
    seen = F.when(F.col("status").isin("DONE", "PROCESSING"), F.col("chunk_index"))
    return segments.groupBy("job_id").agg(F.coalesce(F.max(seen), F.lit(0)).alias("latest"))


def session_stats(events: DataFrame) -> DataFrame:
    """Per job: completions since its last start, and seconds until the last of them.

    ``events``: job_id, seq, type, timestamp. The last start is pre-aggregated per job.
    """
    starts = (
        events.where("type = 'job_started'").groupBy("job_id")
        .agg(F.max("seq").alias("_start_seq"), F.max_by("timestamp", "seq").alias("_start"))
    )
    done = events.where("type = 'segment_completed'").join(starts, "job_id").where("seq > _start_seq")
    stats = done.groupBy("job_id").agg(
        F.count("*").alias("session_done"),
        (F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1e6).alias("_last"),
    )
    return starts.join(stats, "job_id", "left").select(
        "job_id",
        F.coalesce("session_done", F.lit(0)).alias("session_done"),
        F.coalesce(F.col("_last") - F.unix_micros(F.col("_start").cast("timestamp")) / 1e6, F.lit(0.0)).alias("elapsed"),
    )


def job_eta(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Remaining-time text per job from its session statistics."""
    slow = F.contains(F.lower("model"), F.lit(SLOW_FAMILY))
    prior = F.when(slow, SLOW_SPEED).otherwise(DEFAULT_SPEED)
    observed = F.greatest(F.lit(SPEED_CLAMP[0]), F.least(F.lit(SPEED_CLAMP[1]), F.col("elapsed") / F.col("session_done")))
    speed = F.when((F.col("session_done") >= 1) & (F.col("elapsed") > 0), observed).otherwise(prior)
    remaining = F.col("total_chunks") - F.col("completed_chunks")
    seconds = F.floor(remaining * F.col("speed") + 0.5)
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    clock = F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest)).otherwise(
        F.format_string("%dm %ds", minutes, rest)
    )
    kind = F.when(F.col("job_type") == "proofreading", "proofreading").otherwise("translation")
    text = (
        F.when(F.col("total_chunks") == 0, "calculating speed")
        .when(F.col("status") == "COMPLETED", F.concat(kind, F.lit(" completed")))
        .when(F.col("status") == "PENDING", F.concat(F.lit("waiting for "), kind))
        .when(F.col("status") == "PAUSED", "paused")
        .when(F.col("completed_chunks") == 0, F.concat(F.lit("starting "), kind))
        .when(remaining <= 0, F.concat(kind, F.lit(" completed")))
        .when((F.col("status") != "PROCESSING") | F.col("session_done").isNull(), "calculating remaining time")
        .when(
            F.col("session_done") < MIN_HISTORY,
            F.format_string(f"calculating remaining time (history %d/{MIN_HISTORY})", F.col("session_done")),
        )
        .otherwise(F.concat(clock, F.format_string(" (%.1f seg/min)", 60 / F.col("speed"))))
    )
    return jobs.join(sessions, "job_id", "left").withColumn("speed", speed).select("job_id", text.alias("eta"))


def search_jobs(jobs: DataFrame, query: str) -> DataFrame:
    return jobs.where(F.contains(F.lower("file_name"), F.lower(strip(F.lit(query)))))


def segment_token_report(segments: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(F.col("tokens_est"), F.lit(0)), estimate_tokens(F.col("original_text")))
    return segments.select(
        "job_id", "chunk_index", source.alias("source_tokens"),
        estimate_tokens(F.col("translated_text")).alias("target_tokens"),
    )
