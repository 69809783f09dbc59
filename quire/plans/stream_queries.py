"""Registered queries: the event operators, run as real streams over the ``events`` table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import report as I
from quire.plans import sql as Q
from quire.plans import tables as tb
from quire.session import checkpoint_root, scratch_folder
from quire.sources.commits import SnapshotLog
from quire.streaming import events as J
from quire.streaming import ledger as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


TYPES = {
    "signup": "job_started", "click": "segment_started", "view": "segment_completed", "error": "segment_failed",
    "purchase": "job_completed",
}


def as_events(df):
    """Driver events as progress events: job = user, chunk = event_id % 20, seq = event_id."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), F.col("event_type"))
    has_text = (F.col("event_type") == "view") & (F.col("event_id") % 3 != 0)
    return df.select(
        F.col("event_id").alias("seq"), kind.alias("type"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 20).cast("int").alias("chunk_index"),
        F.lit(None).cast("int").alias("completed_chunks"), F.lit(20).alias("total_chunks"),
        F.when(has_text, F.concat(F.lit("text "), F.col("value").cast("decimal(12,2)").cast("string"))).alias("translated_text"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason"),
    )


def event_stream(spark, sf):
    schema = tb.table(spark, sf, "events").schema
    return as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def event_lines(spark, sf):
    """The events as JSON lines in the shared folder, every 50th one broken."""
    path = f"{checkpoint_root(spark)}/event-lines-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*[F.col(c) for c in ("seq", "type", "timestamp", "job_id", "chunk_index", "translated_text")]))
    broken = F.when(F.col("seq") % 50 == 7, F.concat(F.lit("data: "), line)).otherwise(line)
    as_events(tb.table(spark, sf, "events")).select(broken.alias("value")).write.text(path)
    return path


_EVENTS = """ev AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'job_started' WHEN 'click' THEN 'segment_started'
   WHEN 'view' THEN 'segment_completed' WHEN 'error' THEN 'segment_failed' ELSE 'job_completed' END AS type, ts, CAST(user_id AS VARCHAR) AS job_id,
   CAST(event_id % 20 AS INTEGER) AS chunk_index, CASE WHEN event_type = 'view' AND event_id % 3 <> 0 THEN 'text ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS text FROM events)"""


@register(
    "event_source",
    f"WITH {_EVENTS} SELECT seq, type, job_id, chunk_index, text AS translated_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM ev WHERE seq % 50 <> 7",
)
def event_source(spark, sf):
    out = J.run_available(J.event_source(spark, event_lines(spark, sf)), "source", "append")
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return out.select("seq", "type", "job_id", "chunk_index", "translated_text", at.alias("at"))


@register(
    "live_job_status",
    f"WITH {_EVENTS} SELECT job_id, arg_max(CASE type WHEN 'job_started' THEN 'PROCESSING' ELSE 'COMPLETED' END, seq) AS status FROM ev WHERE type LIKE 'job%' GROUP BY job_id",
)
def live_job_status(spark, sf):
    return J.latest(J.run_available(J.live_job_status(event_stream(spark, sf)), "jobs"), ["job_id"])


@register(
    "live_segment_status",
    f"""WITH {_EVENTS}, s AS (SELECT *, CASE type WHEN 'segment_started' THEN 'PROCESSING' WHEN 'segment_completed' THEN 'DONE' ELSE 'FAILED' END AS status FROM ev WHERE type LIKE 'segment%')
    SELECT job_id, chunk_index, arg_max(status, seq) AS status, arg_max(text, seq) FILTER (text IS NOT NULL) AS translated_text FROM s GROUP BY job_id, chunk_index""",
)
def live_segment_status(spark, sf):
    stream = J.live_segment_status(event_stream(spark, sf))
    return J.latest(J.run_available(stream, "segments"), ["job_id", "chunk_index"])


@register(
    "live_progress",
    _PROGRESS := f"""WITH {_EVENTS} SELECT job_id, count(DISTINCT chunk_index) FILTER (type = 'segment_completed') AS completed,
        count(DISTINCT chunk_index) FILTER (type = 'segment_completed') / 20.0::DOUBLE AS fraction FROM ev GROUP BY job_id""",
)
def live_progress(spark, sf):
    completions = J.run_available(J.first_completions(event_stream(spark, sf)), "progress", "append")
    return J.progress_from(completions, job_totals(spark, sf))


def job_totals(spark, sf):
    return as_events(tb.table(spark, sf, "events")).groupBy("job_id").agg(F.max("total_chunks").alias("total_chunks"))


DELIVERIES = 4
#: Number of the delivery that an event comes with: by its number, so that repeats of a chunk lie in all of them; or by its day.
BY_NUMBER = f"seq % {DELIVERIES}"
BY_DAY = f"least({DELIVERIES - 1}, floor((dayofmonth(timestamp) - 1) / 8))"


def deliveries(spark, sf, part, run):
    """All events, delivered to a folder in parts; ``run(stream, number)`` starts its stream after each of them."""
    path = scratch_folder(spark, "deliveries")
    events = as_events(tb.table(spark, sf, "events"))
    for k in range(DELIVERIES):
        events.where(F.expr(part) == k).write.mode("append").parquet(path)
        run(spark.readStream.schema(events.schema).parquet(path), k)


@register("live_progress_stream", _PROGRESS)
def live_progress_stream(spark, sf):
    """Deduplicated and counted in the stream, over four batches that repeat each other's chunks."""
    base = scratch_folder(spark, "progress")

    def run(stream, number):
        J.run_available(J.completions_by_slot(stream, "60 days", "1 day"), "progress", base=base)

    deliveries(spark, sf, BY_NUMBER, run)
    return J.streamed_progress(J.emitted_rows(spark, base, "slot struct<start: timestamp, end: timestamp>, job_id string, completed long"), job_totals(spark, sf))


def _ledgered(spark, sf, name, tables, step, listener=None, part=BY_NUMBER):
    """A store after four deliveries, the third of which comes twice."""
    store = SnapshotLog(spark, scratch_folder(spark, name))
    store.commit(tables, 0)

    def run(stream, number):
        for _ in range(2 if number == 2 else 1):
            L.run_ledgered(stream, store, name, step, listener)
            if number == 2:
                L.forget_last_batch(store, name)

    deliveries(spark, sf, part, run)
    return store


@register(
    "on_batch",
    f"""WITH {_EVENTS} SELECT 'tally' AS kind, type, count(*) AS n, count(DISTINCT job_id) AS jobs FROM ev GROUP BY type
    UNION ALL SELECT 'dead', type, count(*), count(DISTINCT job_id) FROM ev WHERE seq % 4 = 1 GROUP BY type""",
)
def on_batch(spark, sf):
    """Counts that a batch delivered twice would double, and the batch that the listener fails on."""

    def listener(batch, batch_id):
        if not batch.where("seq % 4 = 1").isEmpty():
            raise RuntimeError("the display is gone")

    keys = ["type", "job_id"]
    count = L.count_step(lambda batch: batch.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    nothing = spark.createDataFrame([], "type string, job_id string, n long")
    store = _ledgered(spark, sf, "on_batch", {"tally": nothing}, count, listener)
    dead = L.dead_letters(store, "on_batch", as_events(tb.table(spark, sf, "events")).schema)
    jobs = F.count_distinct("job_id").alias("jobs")
    tally = store.read("tally").groupBy("type").agg(F.sum("n").alias("n"), jobs).select(F.lit("tally").alias("kind"), "*")
    return tally.unionByName(dead.groupBy("type").agg(F.count("*").alias("n"), jobs).select(F.lit("dead").alias("kind"), "*"))


@register(
    "auto_pause_stream",
    Q.STATE
    + f""", {_EVENTS}, down AS (SELECT DISTINCT job_id FROM ev WHERE type = 'segment_failed' AND seq % 3 = 0),
    s AS (SELECT job_id, count(*) FILTER (status = 'PENDING' OR (status = 'PROCESSING' AND job_id IN (SELECT job_id FROM down))) AS waiting FROM segments GROUP BY job_id)
    SELECT job_id, CASE WHEN status = 'PROCESSING' AND job_id IN (SELECT job_id FROM down) THEN 'PAUSED' ELSE status END AS status, coalesce(waiting, 0) AS waiting FROM jobs LEFT JOIN s USING (job_id)""",
)
def auto_pause_stream(spark, sf):
    store = paused_store(spark, sf)
    waiting = store.read("segments").groupBy("job_id").agg(F.count_if(F.col("status") == "PENDING").alias("waiting"))
    return store.read("jobs").join(waiting, "job_id", "left").select("job_id", "status", F.coalesce("waiting", F.lit(0)).alias("waiting"))


def paused_store(spark, sf):
    """The store holds what a pause changes and its keys; the texts stay in the snapshot and are not written again per batch."""
    jobs, segs = tb.snapshot(spark, sf)
    segs = segs.select("job_id", "chunk_index", "status")
    step = L.pause_step(lambda batch: batch.select("job_id", ((F.col("type") == "segment_failed") & (F.col("seq") % 3 == 0)).alias("provider_down")))
    return _ledgered(spark, sf, "auto_pause", {"jobs": jobs, "segments": segs}, step)


@register(
    "tail_log",
    f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rank FROM ev WHERE type IN ('segment_completed', 'segment_failed'))
    SELECT job_id, CAST(rank AS INTEGER) AS rank, seq, type, chunk_index FROM r WHERE rank <= 50""",
)
def tail_log(spark, sf):
    return J.latest_tail(J.run_available(J.tail_log_stream(event_stream(spark, sf)), "tail"))


def rate_requests(df):
    return df.select(
        F.col("user_id").cast("string").alias("client"),
        F.when(F.col("event_type") == "purchase", "upload").when(F.col("event_type") == "error", "sensitive").otherwise("general").alias("class"),
        F.col("event_id").alias("seq"), F.col("ts").alias("at"),
    )


# On this spread 60 seconds never fill up, so the window is one hour and the limits are small.
LIMITS = {"upload": 1, "sensitive": 1, "general": 2}
_RATE = """WITH RECURSIVE req AS (SELECT CAST(user_id AS VARCHAR) AS client, CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'error' THEN 'sensitive' ELSE 'general' END AS class, event_id AS seq, epoch_us(ts) AS us FROM events),
   n AS (SELECT *, row_number() OVER (PARTITION BY client, class ORDER BY us, seq) AS k, CASE class WHEN 'general' THEN 2 ELSE 1 END AS lim FROM req),
   w AS (SELECT client, class, seq, k, TRUE AS admitted, [us] AS recent FROM n WHERE k = 1
     UNION ALL SELECT client, class, seq, k, len(live) < lim, CASE WHEN len(live) < lim THEN list_append(live, us) ELSE live END
     FROM (SELECT n.client, n.class, n.seq, n.k, n.us, n.lim, list_filter(w.recent, lambda x: x > n.us - 3600000000) AS live
           FROM w JOIN n ON n.client = w.client AND n.class = w.class AND n.k = w.k + 1))
   SELECT client, class, seq, admitted FROM w"""


@register("rate_limit", _RATE)
def rate_limit(spark, sf):
    return J.rate_limit(rate_requests(tb.table(spark, sf, "events")), LIMITS, 3600).drop("at")


@register("rate_limit_stream", _RATE)
def rate_limit_stream(spark, sf):
    schema = tb.table(spark, sf, "events").schema
    stream = rate_requests(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    return J.run_available(J.rate_limit_stream(stream, LIMITS, 3600), "rate", "append").drop("batch_id")


def busy_requests(df):
    """Ten clients share all events, so that the real limits are reached within ten days."""
    return df.select(
        (F.col("job_id").cast("long") % 10).cast("string").alias("client"),
        F.when(F.col("type") == "job_completed", "upload").when(F.col("type") == "segment_failed", "sensitive").otherwise("general").alias("class"),
        "seq", F.col("timestamp").alias("at"),
    )


_BUSY = (
    _RATE.replace("CAST(user_id AS VARCHAR)", "CAST(user_id % 10 AS VARCHAR)").replace("3600000000", "864000000000")
    .replace("CASE class WHEN 'general' THEN 2 ELSE 1 END", "CASE class WHEN 'upload' THEN 20 WHEN 'sensitive' THEN 40 ELSE 240 END")
)


@register("rate_limit_batches", _BUSY)
def rate_limit_batches(spark, sf):
    """The limits of the service over four batches in order of time, one of them delivered twice."""
    out = scratch_folder(spark, "verdicts")
    recent = spark.createDataFrame([], L.RECENT)
    _ledgered(spark, sf, "rate", {"recent": recent}, L.rate_step(busy_requests, out, window_seconds=864_000), part=BY_DAY)
    return spark.read.schema("client string, class string, seq long, admitted boolean, batch_id long").parquet(out).drop("batch_id")


@register(
    "auto_pause",
    Q.STATE
    + """, down AS (SELECT DISTINCT job_id FROM segments WHERE (doc_id * 5 + chunk_index) % 9 = 0),
    s AS (SELECT job_id, count(*) FILTER (status = 'PENDING' OR (status = 'PROCESSING' AND job_id IN (SELECT job_id FROM down))) AS waiting FROM segments GROUP BY job_id)
    SELECT job_id, CASE WHEN status = 'PROCESSING' AND job_id IN (SELECT job_id FROM down) THEN 'PAUSED' ELSE status END AS status, waiting FROM jobs JOIN s USING (job_id)""",
)
def auto_pause(spark, sf):
    jobs, segs = tb.snapshot(spark, sf)
    results = segs.select("job_id", ((F.col("job_id").cast("long") * 5 + F.col("chunk_index")) % 9 == 0).alias("provider_down"))
    jobs, after = J.auto_pause(jobs, segs, results)
    waiting = after.groupBy("job_id").agg(F.count_if(F.col("status") == "PENDING").alias("waiting"))
    return jobs.join(waiting, "job_id").select("job_id", "status", "waiting")


_ETA_KIND = "CASE WHEN job_type = 'proofreading' THEN 'proofreading' ELSE 'translation' END"


@register(
    "job_eta",
    Q.STATE
    + f""", {_EVENTS}, starts AS (SELECT job_id, max(seq) AS s0, arg_max(epoch_us(ts), seq) AS t0 FROM ev WHERE type = 'job_started' GROUP BY job_id),
    sess AS (SELECT st.job_id, count(e.seq) AS n, coalesce((max(epoch_us(e.ts)) - any_value(t0)) / 1e6::DOUBLE, 0) AS elapsed
      FROM starts st LEFT JOIN ev e ON e.job_id = st.job_id AND e.type = 'segment_completed' AND e.seq > s0 GROUP BY st.job_id),
    k AS (SELECT jobs.*, {_ETA_KIND} AS kind, n, total_chunks * 10 - completed_chunks AS remaining,
        CASE WHEN n >= 1 AND elapsed > 0 THEN greatest(0.5::DOUBLE, least(25.0::DOUBLE, elapsed / n)) WHEN model LIKE '%gemma%' THEN 9.0::DOUBLE ELSE 3.5::DOUBLE END AS speed
      FROM jobs LEFT JOIN sess USING (job_id)),
    t AS (SELECT *, CAST(floor(remaining * speed + 0.5) AS BIGINT) AS secs FROM k)
    SELECT job_id, CASE WHEN total_chunks = 0 THEN 'calculating speed' WHEN status = 'COMPLETED' THEN kind || ' completed' WHEN status = 'PENDING' THEN 'waiting for ' || kind
      WHEN status = 'PAUSED' THEN 'paused' WHEN completed_chunks = 0 THEN 'starting ' || kind WHEN remaining <= 0 THEN kind || ' completed'
      WHEN status <> 'PROCESSING' OR n IS NULL THEN 'calculating remaining time'
      WHEN n < 8 THEN 'calculating remaining time (history ' || n || '/8)'
      ELSE CASE WHEN secs >= 3600 THEN (secs // 3600) || 'h ' ELSE '' END || (secs % 3600 // 60) || 'm ' || (secs % 60) || 's (' || printf('%.1f', 60 / speed) || ' seg/min)' END AS eta
    FROM t""",
)
def job_eta(spark, sf):
    # Ten times the segments, so that the remaining time of a job reaches minutes and hours.
    jobs = tb.state_jobs(spark, sf).withColumn("total_chunks", F.col("total_chunks") * 10)
    return I.job_eta(jobs, I.session_stats(as_events(tb.table(spark, sf, "events"))))
