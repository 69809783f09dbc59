"""Job and segment state as immutable snapshots: every operator is f(snapshot, commands) -> snapshot.

Segments are keyed by (job_id, chunk_index), so updates join on the pair and a
job that owns a large share of all segments is spread over the cluster. Per-job
numbers are pre-aggregated before they meet the jobs table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.params import LOCAL_PROVIDERS, SCHEMA_VERSION, TOKEN_MAX_LENGTH, TOKEN_PREFIX
from quire.schemas import JOB_DEFAULTS, JOBS

SEGMENT_KEY = ["job_id", "chunk_index"]
CONFIG_FIELDS = (
    "temperature", "concurrency", "model", "chunk_size", "api_type", "endpoint",
    "enable_proofreading", "enable_prompt_caching",
)
PATH_FIELDS = ("source_path", "output_path")
ERROR_LENGTH = 1000
REFERENCE_LENGTH = 200


def segment_counts(segments: DataFrame) -> DataFrame:
    """Per job: total and finished segments (partial aggregation before the shuffle)."""
    return segments.groupBy("job_id").agg(
        F.count("*").cast("int").alias("total_chunks"),
        F.count_if(F.col("status") == "DONE").cast("int").alias("completed_chunks"),
    )


def create_jobs(requests: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests + their segments (both keyed by job_id) -> (jobs, segment rows), all PENDING.

    ``requests`` carries file_name, languages, model, prompt and options as columns;
    absent options get their defaults. Jobs without a segment are not created.
    """
    counts = segments.groupBy("job_id").agg(F.count("*").cast("int").alias("total_chunks"))
    jobs = requests.join(counts, "job_id").withColumns(
        {"status": F.lit("PENDING"), "completed_chunks": F.lit(0), "completed_at": F.lit(None).cast("timestamp_ntz")}
    )
    rows = segments.join(requests.select("job_id", "created_at"), "job_id").select(
        "job_id",
        "chunk_index",
        F.col("text").alias("original_text"),
        F.lit(None).cast("string").alias("translated_text"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        "node_indices",
        "tokens_est",
        F.col("created_at").alias("updated_at"),
    )
    return evolve_schema(jobs), rows


def list_jobs(jobs: DataFrame, job_id: str | None = None) -> DataFrame:
    picked = jobs if job_id is None else jobs.where(F.col("job_id") == job_id)
    return picked.orderBy(F.desc("created_at"), "job_id")


def job_segments(segments: DataFrame, job_id: str | None = None) -> DataFrame:
    """Segments in order, of one job (the filter reaches the scan) or of all jobs."""
    picked = segments if job_id is None else segments.where(F.col("job_id") == job_id)
    return picked.orderBy("job_id", "chunk_index")


def one_per_key(commands: DataFrame, keys: list[str]) -> DataFrame:
    """One command per key: the last by ``at`` or ``seq`` where there is such a column, any fixed one otherwise.

    Commands and results are delivered at least once, and two rows for a key would multiply
    the snapshot's rows in the join.
    """
    rest = [c for c in commands.columns if c not in keys]
    if not rest:
        return commands.distinct()
    order = F.struct(*[c for c in ("at", "seq") if c in rest], F.xxhash64(*rest))
    return commands.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def transition_jobs(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Conditional status change. ``commands``: job_id, allowed ARRAY<STRING>, new_status (and at or seq).

    The result is the new snapshot plus ``applied`` (NULL when no command was given).
    A job is changed only from an allowed status, so the same command succeeds once.
    """
    applied = F.when(F.col("new_status").isNotNull(), F.array_contains(F.coalesce("allowed", F.array()), F.col("status")))
    last = one_per_key(commands, ["job_id"]).select("job_id", "allowed", "new_status")
    out = jobs.join(last, "job_id", "left").withColumn("applied", applied)
    hit = F.coalesce("applied", F.lit(False))
    return out.withColumns(
        {
            "status": F.when(hit, F.col("new_status")).otherwise(F.col("status")),
            "completed_at": F.when(hit, F.lit(None)).otherwise(F.col("completed_at")),
        }
    ).drop("allowed", "new_status")


def set_job_status(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Unconditional status change (job_id, new_status, new_completed_at); the time is overwritten, NULL included."""
    hit = F.col("new_status").isNotNull()
    return (
        jobs.join(one_per_key(commands, ["job_id"]).select("job_id", "new_status", "new_completed_at"), "job_id", "left")
        .withColumns(
            {
                "status": F.coalesce("new_status", "status"),
                "completed_at": F.when(hit, F.col("new_completed_at")).otherwise(F.col("completed_at")),
            }
        )
        .drop("new_status", "new_completed_at")
    )


def _with_update(segments: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    last = one_per_key(updates.select(*SEGMENT_KEY, *columns), SEGMENT_KEY)
    marked = last.select(*SEGMENT_KEY, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    return segments.join(marked, SEGMENT_KEY, "left")


def claim_segments(segments: DataFrame, claims: DataFrame) -> DataFrame:
    """PENDING or FAILED segments named in ``claims`` (job_id, chunk_index, at) become PROCESSING."""
    joined = _with_update(segments, claims, ["at"])
    hit = F.coalesce("_hit", F.lit(False)) & F.col("status").isin("PENDING", "FAILED")
    return joined.withColumns(
        {
            "claimed": hit,
            "error_message": F.when(hit, F.lit(None)).otherwise(F.col("error_message")),
            "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
            "status": F.when(hit, F.lit("PROCESSING")).otherwise(F.col("status")),
        }
    ).drop("_at", "_hit")


def complete_segments(
    jobs: DataFrame, segments: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Results (job_id, chunk_index, result_text, at) -> DONE; finished counts recounted for touched jobs."""
    joined = _with_update(segments, results, ["result_text", "at"])
    hit = F.coalesce("_hit", F.lit(False))
    done = joined.withColumns(
        {
            "status": F.when(hit, F.lit("DONE")).otherwise(F.col("status")),
            "translated_text": F.when(hit, F.col("_result_text")).otherwise(F.col("translated_text")),
            "error_message": F.when(hit, F.lit(None)).otherwise(F.col("error_message")),
            "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
        }
    )
    recount = (
        done.groupBy("job_id")
        .agg(
            F.count_if(F.col("status") == "DONE").cast("int").alias("_done"),
            F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_touched"),
        )
    )
    new_jobs = jobs.join(recount, "job_id", "left").withColumn(
        "completed_chunks",
        F.when(F.col("_touched"), F.col("_done")).otherwise(F.col("completed_chunks")),
    ).drop("_done", "_touched")
    return new_jobs, done.drop("_result_text", "_at", "_hit")


def fail_segments(segments: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures (job_id, chunk_index, error, at) -> FAILED with a bounded message."""
    joined = _with_update(segments, failures, ["error", "at"])
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(hit, F.lit("FAILED")).otherwise(F.col("status")),
            "error_message": F.when(hit, F.substring("_error", 1, ERROR_LENGTH)).otherwise(F.col("error_message")),
            "updated_at": F.when(hit, F.col("_at")).otherwise(F.col("updated_at")),
        }
    ).drop("_error", "_at", "_hit")


def _reset_expressions(at: Column, failed: bool, processing: bool, hit: Column) -> dict[str, Column]:
    retry = (F.col("status") == "FAILED") & F.lit(failed) & hit
    pause = (F.col("status") == "PROCESSING") & F.lit(processing) & hit
    return {
        "error_message": F.when(retry, F.lit(None)).otherwise(F.col("error_message")),
        "updated_at": F.when(retry | pause, at).otherwise(F.col("updated_at")),
        "status": F.when(retry | pause, F.lit("PENDING")).otherwise(F.col("status")),
    }


def reset_segments(segments: DataFrame, at: Column, failed: bool = True, processing: bool = True) -> DataFrame:
    """FAILED (retry) and PROCESSING (pause) back to PENDING; only a retry clears the message. No shuffle."""
    return segments.withColumns(_reset_expressions(at, failed, processing, F.lit(True)))


def recover(jobs: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: running jobs are paused, running segments wait again."""
    job_status = F.when(F.col("status") == "PROCESSING", "PAUSED").otherwise(F.col("status"))
    segment_status = F.when(F.col("status") == "PROCESSING", "PENDING").otherwise(F.col("status"))
    return jobs.withColumn("status", job_status), segments.withColumn("status", segment_status)


def unfinished(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job_id").agg(F.count_if(F.col("status") != "DONE").alias("unfinished"))


def resolve_job_status(jobs: DataFrame, segments: DataFrame, at: Column) -> DataFrame:
    """After a run: FAILED while segments are unfinished, else COMPLETED; other jobs are untouched."""
    running = F.col("status") == "PROCESSING"
    open_segments = F.coalesce("unfinished", F.lit(0)) > 0
    return jobs.join(unfinished(segments), "job_id", "left").withColumns(
        {
            "completed_at": F.when(running & open_segments, F.lit(None)).when(running, at).otherwise(F.col("completed_at")),
            "status": F.when(running & open_segments, "FAILED").when(running, "COMPLETED").otherwise(F.col("status")),
        }
    ).drop("unfinished")


def path_references(jobs: DataFrame) -> DataFrame:
    """Per job and stored path: how many *other* jobs use the path; zero means it may be deleted.

    Counting is a pre-aggregated group per path, joined back, never a self-join of jobs.
    """
    paths = jobs.select("job_id", F.explode(F.array_distinct(F.array(*PATH_FIELDS))).alias("path")).where(
        F.col("path").isNotNull()
    )
    users = paths.groupBy("path").agg(F.count("*").alias("users"))
    return paths.join(users, "path").select(
        "job_id", "path", (F.col("users") - 1).alias("other_users"), (F.col("users") == 1).alias("deletable")
    )


def file_name_references(jobs: DataFrame) -> DataFrame:
    """The same by file name, for jobs without a stored source path."""
    users = jobs.groupBy("file_name").agg(F.count("*").alias("users"))
    return jobs.join(users, "file_name").select(
        "job_id", "file_name", (F.col("users") - 1).alias("other_users"),
        (F.col("source_path").isNull() & (F.col("users") == 1)).alias("deletable"),
    )


def patch_jobs(jobs: DataFrame, patches: DataFrame, fields: tuple[str, ...] = CONFIG_FIELDS) -> DataFrame:
    """Sparse update: only non-NULL patch fields overwrite. Paths need ``fields=PATH_FIELDS``."""
    if not set(fields) <= set(CONFIG_FIELDS) and not set(fields) <= set(PATH_FIELDS):
        raise ValueError("unsupported job field")
    present = [f for f in fields if f in patches.columns]
    order = F.struct(*[c for c in ("at", "seq") if c in patches.columns], F.xxhash64(*patches.columns))
    # Of several patches for a job, each field takes its last value that is not NULL.
    new = patches.groupBy("job_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in present]
    ) if present else patches.select("job_id").distinct()
    out = jobs.join(new, "job_id", "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in present}).drop(*[f"_{f}" for f in present])


def tag_origin(jobs: DataFrame, origins: DataFrame, clients: DataFrame) -> DataFrame:
    """Stamp client and external reference (origins: job_id, client_id, external_ref) on jobs."""
    known = one_per_key(origins, ["job_id"]).join(clients.select("client_id", F.col("name").alias("_name")), "client_id")
    marks = known.select("job_id", F.col("client_id").alias("_client"), "_name", F.col("external_ref").alias("_ref"))
    hit = F.col("_client").isNotNull()
    base = jobs
    for name in ("client_id", "client_name", "external_ref"):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    return base.join(marks, "job_id", "left").withColumns(
        {
            "client_id": F.coalesce("_client", "client_id"),
            "client_name": F.coalesce("_name", "client_name"),
            "external_ref": F.when(hit, F.col("_ref")).otherwise(F.col("external_ref")),
        }
    ).drop("_client", "_name", "_ref")


def client_jobs(jobs: DataFrame, client_id: str | None = None) -> DataFrame:
    """Jobs of one client (or of every client), newest first."""
    own = jobs.where(F.col("client_id").isNotNull() if client_id is None else F.col("client_id") == client_id)
    return own.orderBy("client_id", F.desc("created_at"), "job_id")


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def resolve_client(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests (token, at, …) -> client; unknown or malformed tokens leave ``client_id`` NULL."""
    valid = F.startswith("token", F.lit(TOKEN_PREFIX)) & (F.length("token") <= TOKEN_MAX_LENGTH)
    hashed = requests.withColumn("_hash", F.when(valid, token_hash(F.col("token"))))
    keys = clients.select(F.col("token_hash").alias("_hash"), "client_id", F.col("name").alias("client_name"))
    return hashed.join(keys, "_hash", "left").drop("_hash", "token")


def touch_clients(clients: DataFrame, resolved: DataFrame) -> DataFrame:
    """``last_used_at`` becomes the latest use."""
    used = resolved.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(F.max("at").alias("_at"))
    return clients.join(used, "client_id", "left").withColumn(
        "last_used_at", F.greatest("last_used_at", "_at")
    ).drop("_at")


def delete_jobs(jobs: DataFrame, segments: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = deleted.select("job_id").distinct()
    return jobs.join(gone, "job_id", "left_anti"), segments.join(gone, "job_id", "left_anti")


def evolve_schema(jobs: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Bring an older jobs snapshot to the current schema; refuse a newer one."""
    if version > SCHEMA_VERSION:
        raise RuntimeError(f"state has schema {version}, this build supports up to {SCHEMA_VERSION}")
    empty = jobs.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in JOBS]))
    merged = empty.unionByName(jobs.select([c for c in jobs.columns if c in JOBS.names]), allowMissingColumns=True)
    return merged.select(
        *[
            (F.coalesce(F.col(f.name), F.lit(JOB_DEFAULTS[f.name])) if f.name in JOB_DEFAULTS else F.col(f.name))
            .cast(f.dataType).alias(f.name)
            for f in JOBS
        ]
    )


def duplicate_keys(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*SEGMENT_KEY).agg(F.count("*").alias("copies")).where("copies > 1")


def request_defaults(requests: DataFrame, clients: DataFrame, global_provider: str = "openai") -> DataFrame:
    """Provider, model and presets of a request (client_id, provider, model, external_ref)."""
    defaults = clients.select(
        "client_id", F.col("default_provider").alias("_provider"), F.col("default_model").alias("_model")
    )
    joined = requests.join(defaults, "client_id", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    chosen = F.lower(F.trim(F.coalesce(given("provider"), given("_provider"), F.lit(global_provider))))
    own = F.when(chosen == F.lower(F.coalesce("_provider", F.lit(""))), given("_model"))
    model = F.coalesce(given("model"), own)
    local = F.col("chosen_provider").isin(*LOCAL_PROVIDERS)
    return (
        joined.withColumns({"chosen_provider": chosen, "chosen_model": model})
        .withColumns(
            {
                "concurrency": F.when(local, 1).otherwise(4),
                "chunk_size": F.when(local, 1000).otherwise(6000),
                "reject_reason": F.when(F.length("external_ref") > REFERENCE_LENGTH, "external_ref").when(
                    F.col("chosen_model").isNull(), "model"
                ),
            }
        )
        .drop("_provider", "_model")
    )


def start_jobs(jobs: DataFrame, patches: DataFrame) -> DataFrame:
    """Start = sparse config patch, then a conditional move to PROCESSING."""
    commands = patches.select(
        "job_id",
        F.array(F.lit("PENDING"), F.lit("PAUSED"), F.lit("FAILED")).alias("allowed"),
        F.lit("PROCESSING").alias("new_status"),
    )
    return transition_jobs(patch_jobs(jobs, patches), commands)


def pause_jobs(jobs: DataFrame, segments: DataFrame, paused: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Pause = status PAUSED and running segments of those jobs back to PENDING."""
    commands = paused.select(
        "job_id", F.lit("PAUSED").alias("new_status"), F.lit(None).cast("timestamp_ntz").alias("new_completed_at")
    )
    return set_job_status(jobs, commands), _reset_for(segments, paused, at, failed=False)


def retry_jobs(jobs: DataFrame, segments: DataFrame, retried: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Retry = failed and running segments back to PENDING and the job PENDING."""
    commands = retried.select(
        "job_id", F.lit("PENDING").alias("new_status"), F.lit(None).cast("timestamp_ntz").alias("new_completed_at")
    )
    return set_job_status(jobs, commands), _reset_for(segments, retried, at, failed=True)


def _reset_for(segments: DataFrame, chosen: DataFrame, at: Column, failed: bool) -> DataFrame:
    marks = chosen.select("job_id", F.lit(True).alias("_chosen")).distinct()
    hit = F.coalesce("_chosen", F.lit(False))
    return segments.join(marks, "job_id", "left").withColumns(_reset_expressions(at, failed, True, hit)).drop("_chosen")

