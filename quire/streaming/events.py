"""Progress events: live status, progress, log tail and admission control on Structured Streaming.

Keys with unbounded traffic are safe by construction: aggregates combine partially
before the shuffle, completions are deduplicated by (job, chunk) rather than by job,
and the stateful processors keep a bounded list per key while reading their input
as an iterator. ``seq`` is the arrival order; ``max_by`` over it makes replays and
out-of-order batches harmless.
"""

from __future__ import annotations

import heapq
import json
import logging
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quire.functions.prefix import running_sum
from quire.schemas import EVENTS
from quire.session import checkpoint_root

log = logging.getLogger(__name__)

# Status rules and limits.
JOB_STATUS = {"job_started": "PROCESSING", "job_paused": "PAUSED", "job_auto_paused": "PAUSED", "job_completed": "COMPLETED"}
SEGMENT_STATUS = {"segment_started": "PROCESSING", "segment_completed": "DONE", "segment_failed": "FAILED"}
TAIL_TYPES = ("segment_completed", "segment_failed")
TAIL_LENGTH = 50
RATE_WINDOW = 60
RATE_LIMITS = {"upload": 20, "sensitive": 40, "general": 240}


# ---- source and sinks --------------------------------------------------------------------------


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines -> typed events; malformed lines and lines without a type are dropped."""
    parsed = lines.select(F.from_json(value, EVENTS, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return parsed.where(F.col("type").isNotNull())


def event_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of events from a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_events(reader.load(path))


def without_replays(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Drop events delivered again within the watermark horizon; state older than it is released."""
    return events.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["job_id", "chunk_index", "type", "seq"])


def guarded(callback: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A listener for ``foreachBatch`` whose failure never stops the stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            callback(batch, batch_id)
        except Exception:
            log.warning("listener failed on batch %s", batch_id, exc_info=True)

    return run


def run_available(
    stream: DataFrame, label: str, mode: str = "update", listener: Callable[[DataFrame, int], None] | None = None, base: str | None = None
) -> DataFrame:
    """Process everything available and return the emitted rows with their ``batch_id``.

    Each batch is written to its own folder, overwritten when the batch is replayed,
    so the result is exactly-once. With ``base`` a stream goes on where it stopped there.
    """
    spark = stream.sparkSession
    base = base or f"{checkpoint_root(spark)}/stream-{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        if listener is not None:
            guarded(listener)(batch, batch_id)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return emitted_rows(spark, base, stream.schema)


def emitted_rows(spark: SparkSession, base: str, schema: StructType | str) -> DataFrame:
    """The rows that ``run_available`` has written below ``base``, with their ``batch_id``."""
    schema = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).add("batch_id", "long")
    return spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    others = [c for c in emitted.columns if c not in keys and c != "batch_id"]
    last = emitted.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in others])


# ---- status ------------------------------------------------------------------------------------


def _mapped(names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, F.col("type"))


def live_job_status(events: DataFrame) -> DataFrame:
    """Latest status per job; works on a stream (update mode) and on a table."""
    return (
        events.withColumn("status", _mapped(JOB_STATUS)).where("status is not null")
        .groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))
    )


def live_segment_status(events: DataFrame) -> DataFrame:
    """Latest status and text per segment; an event without text keeps the older text."""
    text = F.when(
        F.col("type").isin(*TAIL_TYPES) & (F.coalesce("translated_text", F.lit("")) != ""), F.col("translated_text")
    )
    return (
        events.withColumn("status", _mapped(SEGMENT_STATUS)).where("status is not null and chunk_index is not null")
        .withColumn("text_seq", F.when(text.isNotNull(), F.col("seq")))
        .groupBy("job_id", "chunk_index")
        .agg(F.max_by("status", "seq").alias("status"), F.max_by("translated_text", "text_seq").alias("translated_text"))
    )


def first_completions(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """First completion of each segment. State is one key per (job, chunk), never one list per job.

    With ``horizon``, keys older than the watermark are released.
    """
    done = events.where("type = 'segment_completed' and chunk_index is not null")
    if horizon:
        return done.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["job_id", "chunk_index"]).select("job_id")
    return done.select("job_id", "chunk_index").dropDuplicates(["job_id", "chunk_index"]).select("job_id")


def progress_from(completions: DataFrame, totals: DataFrame) -> DataFrame:
    """Completions (one row each, streamed batches included) and job totals -> count and fraction."""
    done = completions.groupBy("job_id").agg(F.count("*").alias("completed"))
    return totals.join(done, "job_id", "left").select(
        "job_id", F.coalesce("completed", F.lit(0)).alias("completed"),
        (F.coalesce("completed", F.lit(0)) / F.col("total_chunks")).alias("fraction"),
    )


def completions_by_slot(events: DataFrame, horizon: str, slot: str) -> DataFrame:
    """Stream form of the count: (slot, job_id, completed), updated with each batch; two stateful operators in a chain.

    The first drops completions of a (job, chunk) again within ``horizon`` of event time, the second counts
    what is left per job and slot of time. Both forget what lies ``horizon`` behind the newest event, so the
    state holds the open slots and the chunks of one horizon, whatever the stream has seen. A completion
    repeated later than that counts as a new run of its chunk.
    """
    done = events.where("type = 'segment_completed' and chunk_index is not null").withWatermark("timestamp", horizon)
    once = done.dropDuplicatesWithinWatermark(["job_id", "chunk_index"])
    return once.groupBy(F.window("timestamp", slot).alias("slot"), "job_id").agg(F.count("*").alias("completed"))


def streamed_progress(emitted: DataFrame, totals: DataFrame) -> DataFrame:
    """Emitted slot counts and job totals -> count and fraction per job; of a slot the last emission holds."""
    done = latest(emitted, ["slot", "job_id"]).groupBy("job_id").agg(F.sum("completed").alias("completed"))
    return totals.join(done, "job_id", "left").select(
        "job_id", F.coalesce("completed", F.lit(0)).alias("completed"),
        (F.coalesce("completed", F.lit(0)) / F.col("total_chunks")).alias("fraction"),
    )


# ---- log tail ----------------------------------------------------------------------------------


def tail_log(events: DataFrame, k: int = TAIL_LENGTH) -> DataFrame:
    """Table form: the last ``k`` finished-segment events per job, newest first."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return (
        events.where(F.col("type").isin(*TAIL_TYPES))
        .select("job_id", "seq", "type", "chunk_index", F.row_number().over(newest).alias("rank"))
        .where(F.col("rank") <= k)
    )


class _Tail(StatefulProcessor):
    """Keeps the ``k`` newest events of a job; reads any amount of input in constant memory."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = json.loads(self.kept.get()[0]) if self.kept.exists() else []
        newest = {tuple(r) for r in stored}
        for pdf in rows:
            fresh = zip(pdf["seq"].tolist(), pdf["type"].tolist(), pdf["chunk_index"].tolist())
            newest = set(heapq.nlargest(self.k, newest.union(fresh)))
        ordered = sorted(newest, reverse=True)
        self.kept.update((json.dumps(ordered),))
        yield pd.DataFrame(
            {
                "job_id": [key[0]] * len(ordered),
                "rank": range(1, len(ordered) + 1),
                "seq": [r[0] for r in ordered],
                "type": [r[1] for r in ordered],
                "chunk_index": [r[2] for r in ordered],
            }
        )

    def close(self) -> None:
        pass


def _state_store(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def tail_log_stream(events: DataFrame, k: int = TAIL_LENGTH) -> DataFrame:
    """Stream form: emits the whole (bounded) tail of every job that got new events."""
    _state_store(events.sparkSession)
    rows = events.where(F.col("type").isin(*TAIL_TYPES)).select("job_id", "seq", "type", "chunk_index")
    return rows.groupBy("job_id").transformWithStateInPandas(
        _Tail(k), "job_id string, rank int, seq long, type string, chunk_index int", "Update", "None"
    )


def latest_tail(emitted: DataFrame) -> DataFrame:
    """Rows of the newest emission per job."""
    newest = emitted.groupBy("job_id").agg(F.max("batch_id").alias("batch_id"))
    return emitted.join(newest, ["job_id", "batch_id"], "left_semi").drop("batch_id")


# ---- admission control -------------------------------------------------------------------------


def _admit(times: Iterator[int], admitted: deque, window: int, limit: int) -> list[bool]:
    """Sliding-window admission; ``admitted`` holds at most ``limit`` recent times."""
    verdicts = []
    for t in times:
        while admitted and admitted[0] <= t - window:
            admitted.popleft()
        ok = len(admitted) < limit
        if ok:
            admitted.append(t)
        verdicts.append(ok)
    return verdicts


def rate_limit(requests: DataFrame, limits: dict[str, int] | None = None, window_seconds: int = RATE_WINDOW) -> DataFrame:
    """Table form. ``requests``: client, class, seq, at (timestamp) -> the same plus ``admitted``.

    Admission is sequential per (client, class), but not over the whole history: in
    a slot of one window length whose own and previous counts together stay within
    the limit everything is admitted, so such a calm slot starts an independent
    run. Runs are found from per-slot counts and walked in parallel, each in
    constant memory; only truly overloaded stretches stay sequential.
    """
    limits = limits or RATE_LIMITS
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    window = window_seconds * 1_000_000
    keys = ["client", "class"]
    timed = requests.withColumns(
        {"us": F.unix_micros(F.col("at").cast("timestamp")), "limit": F.element_at(table, F.col("class"))}
    ).withColumn("slot", F.floor(F.col("us") / window).cast("long"))
    counts = timed.groupBy(*keys, "slot", "limit").agg(F.count("*").alias("n"))
    by_slot = Window.partitionBy(*keys).orderBy("slot")
    previous = F.when(F.lag("slot").over(by_slot) == F.col("slot") - 1, F.lag("n").over(by_slot)).otherwise(0)
    calm = counts.select(*keys, "slot", (F.col("n") + previous <= F.col("limit")).cast("int").alias("calm"))
    runs = running_sum(calm, keys, "slot", F.col("calm"), "run").select(*keys, "slot", "run")
    placed = timed.join(runs, [*keys, "slot"]).drop("slot")
    columns = requests.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, admitted = None, deque()
        for pdf in batches:
            verdicts = []
            for client, cls, run, us, limit in zip(pdf["client"], pdf["class"], pdf["run"], pdf["us"], pdf["limit"]):
                if (client, cls, run) != current:
                    current, admitted = (client, cls, run), deque()
                verdicts.extend(_admit(iter((us,)), admitted, window, limit))
            yield pdf[columns].assign(admitted=verdicts)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return (
        placed.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "us", "seq")
        .mapInPandas(walk, f"{fields}, admitted boolean")
    )


class _RateLimiter(StatefulProcessor):
    def __init__(self, limits: dict[str, int], window: int) -> None:
        self.limits, self.window = limits, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        admitted = deque(self.recent.get()[0]) if self.recent.exists() else deque()
        # Arrival order inside a micro-batch is restored from two integers per request;
        # the trigger size (files or bytes per trigger) bounds how many there are.
        arrived = np.concatenate([pdf[["us", "seq"]].to_numpy(dtype=np.int64) for pdf in rows])
        arrived = arrived[np.lexsort((arrived[:, 1], arrived[:, 0]))]
        verdicts = _admit(iter(arrived[:, 0].tolist()), admitted, self.window, self.limits[key[1]])
        self.recent.update((list(admitted),))
        yield pd.DataFrame({"client": key[0], "class": key[1], "seq": arrived[:, 1], "admitted": verdicts})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limits: dict[str, int] | None = None, window_seconds: int = RATE_WINDOW) -> DataFrame:
    """Stream form: state per (client, class) is the list of admitted times inside one window."""
    _state_store(requests.sparkSession)
    timed = requests.select("client", "class", "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    return timed.groupBy("client", "class").transformWithStateInPandas(
        _RateLimiter(limits or RATE_LIMITS, window_seconds * 1_000_000),
        "client string, class string, seq long, admitted boolean", "Append", "None",
    )


# ---- auto pause --------------------------------------------------------------------------------


def auto_pause(jobs: DataFrame, segments: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One provider-down result pauses the whole running job; its running segments wait again."""
    down = results.where("provider_down").select("job_id").distinct().withColumn("_down", F.lit(True))
    hit = F.coalesce("_down", F.lit(False)) & (F.col("status") == "PROCESSING")
    new_jobs = jobs.join(down, "job_id", "left").withColumn("status", F.when(hit, "PAUSED").otherwise(F.col("status")))
    new_segments = segments.join(down, "job_id", "left").withColumn(
        "status", F.when(hit, "PENDING").otherwise(F.col("status"))
    )
    return new_jobs.drop("_down"), new_segments.drop("_down")
