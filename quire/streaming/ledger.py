"""Streams that change stored snapshots exactly once.

Spark delivers a micro-batch again when it stopped before the batch was recorded. So a batch and the
snapshot that it leads to are one commit of a ``SnapshotLog``, which also notes (query, batch number);
a batch that the log has seen changes nothing. Listeners come after the commit, are called again when
the call is not known to have ended, and cannot stop the stream: what a listener failed on goes to a
table of dead letters with the error, one folder for each batch, replaced when the batch comes again.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import settle
from quire.sources.commits import Conflict, Reader, SnapshotLog
from quire.streaming.events import RATE_LIMITS, RATE_WINDOW, auto_pause, rate_limit

log = logging.getLogger(__name__)

#: (batch, its number, reader of the tables it starts from) -> the tables that change
Step = Callable[[DataFrame, int, Reader], dict[str, DataFrame]]
Listener = Callable[[DataFrame, int], None]
ATTEMPTS = 10


def on_batch(store: SnapshotLog, query: str, step: Step, listener: Listener | None = None) -> Listener:
    """A function for ``foreachBatch``: commits ``step(batch, number, read)`` once for each batch, then tells ``listener``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        for _ in range(ATTEMPTS):
            base = store.version()
            if store.entry(base)["batches"].get(query, -1) >= batch_id:
                return
            try:
                store.commit(step(batch, batch_id, lambda name: store.read(name, base)), base, {query: batch_id})  # noqa: B023
                return
            except Conflict:  # another writer was faster: the step is made again on its version
                continue
        raise Conflict(f"batch {batch_id} of {query} was refused {ATTEMPTS} times")

    def tell(batch: DataFrame, batch_id: int) -> None:
        told = store.path("_told", query, str(batch_id))
        if store.files.exists(told):
            return
        try:
            listener(batch, batch_id)
        except Exception as error:
            log.warning("listener of %s failed on batch %s", query, batch_id, exc_info=True)
            text = f"{type(error).__name__}: {error}"
            batch.withColumn("listener_error", F.lit(text)).write.mode("overwrite").parquet(f"{store.root}/_dead/{query}/batch_id={batch_id}")
        store.files.create(told, True).close()
        store.files.delete(store.path("_told", query, str(batch_id - 2)), False)

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read by the step, its checks and the listener
        try:
            apply(held, batch_id)
            if listener is not None:
                tell(held, batch_id)
        finally:
            held.unpersist()

    return run


def run_ledgered(stream: DataFrame, store: SnapshotLog, query: str, step: Step, listener: Listener | None = None, mode: str = "append") -> None:
    """Process everything available; the stream's own checkpoint lies beside the log."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(on_batch(store, query, step, listener))
        .option("checkpointLocation", f"{store.root}/_stream/{query}").trigger(availableNow=True).start()
    ).awaitTermination()


def forget_last_batch(store: SnapshotLog, query: str) -> int:
    """Make the stream believe that it stopped before its last batch was recorded, as after a crash; returns the batch number."""
    commits = store.path("_stream", query, "commits")
    last = max(int(s.getPath().getName()) for s in store.files.listStatus(commits) if s.getPath().getName().isdigit())
    store.files.delete(store.path("_stream", query, "commits", str(last)), False)
    return last


def dead_letters(store: SnapshotLog, query: str, schema) -> DataFrame:
    """(the columns of the stream, listener_error, batch_id) of all batches that the listener failed on."""
    base = f"{store.root}/_dead/{query}"
    fields = schema.add("listener_error", "string").add("batch_id", "long")
    if not store.files.exists(store.path("_dead", query)):
        return store.spark.createDataFrame([], fields)
    return store.spark.read.schema(fields).option("basePath", base).parquet(base)


# ---- steps -------------------------------------------------------------------------------------


def pause_step(results: Callable[[DataFrame], DataFrame]) -> Step:
    """Pauses the running jobs of a batch whose provider is down; ``results`` gives (job_id, provider_down) of a batch."""

    def step(batch: DataFrame, number: int, read: Reader) -> dict[str, DataFrame]:
        down = results(batch).where("provider_down")
        if down.isEmpty():
            return {}
        jobs, segments = auto_pause(read("jobs"), read("segments"), down)
        return {"jobs": jobs, "segments": segments}

    return step


def count_step(counted: Callable[[DataFrame], DataFrame], keys: list[str]) -> Step:
    """Adds the counts of a batch, (keys, n), to the table ``tally``."""

    def step(batch: DataFrame, number: int, read: Reader) -> dict[str, DataFrame]:
        both = read("tally").unionByName(counted(batch))
        return {"tally": both.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"))}

    return step


RECENT = "client string, class string, at timestamp"


def rate_step(
    requests: Callable[[DataFrame], DataFrame], out: str, limits: dict[str, int] | None = None, window_seconds: int = RATE_WINDOW
) -> Step:
    """Admission over batches: the table ``recent`` carries, per (client, class), the admitted requests of the last window.

    A batch is admitted in order of time behind what is carried, by the table form of ``rate_limit``: spread over
    stretches, each walked in constant memory, so that a hot client's batch is never held. Of a key at most its
    limit is carried, and nothing that is a window older than the newest request seen. Verdicts go to a
    folder of ``out`` per batch; the batch that is made again writes the same ones.
    """
    limits = limits or RATE_LIMITS

    def step(batch: DataFrame, number: int, read: Reader) -> dict[str, DataFrame]:
        new = requests(batch).select("client", "class", F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"))
        carried = read("recent").withColumn("seq", F.lit(None).cast("long"))
        judged = settle(rate_limit(carried.unionByName(new), limits, window_seconds), "judged")
        judged.where("seq is not null").write.mode("overwrite").parquet(f"{out}/batch_id={number}")
        newest = judged.agg(F.max(F.unix_micros("at")).alias("us")).first()["us"] or 0
        kept = judged.where(F.col("admitted") & (F.unix_micros("at") > newest - window_seconds * 1_000_000))
        return {"recent": kept.select("client", "class", "at")}

    return step
