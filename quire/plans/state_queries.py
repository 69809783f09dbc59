"""Registered queries: state snapshots, rebuild and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import rebuild as R
from quire.operators import report as I
from quire.operators import state as G
from quire.operators import extract as X
from quire.plans import sql as Q
from quire.plans import tables as tb
from quire.session import scratch_folder
from quire.sources.commits import SnapshotLog

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def jobs_of(spark, sf):
    return tb.state_jobs(spark, sf)


def segs_of(spark, sf):
    return tb.state_segments(spark, sf)


def both(spark, sf):
    return tb.snapshot(spark, sf)


def text_time(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def nodes_as_text(df):
    return df.withColumn("node_list", F.array_join(F.col("node_indices").cast("array<string>"), ",")).drop("node_indices")


SEG_SQL = f"job_id, chunk_index, status, error_message, translated_text, {Q.ts_text('updated_at')} AS updated_at"


def seg_view(df):
    return df.select("job_id", "chunk_index", "status", "error_message", "translated_text", text_time("updated_at"))


def picked(df, modulo, hit):
    """Commands for a share of the jobs; the operators still process every row."""
    return df.where(F.col("job_id").cast("long") % modulo == hit)


# ---- snapshots ---------------------------------------------------------------------------------


@register(
    "create_jobs",
    Q.segments_with(1000)
    + f""" SELECT CAST(d.doc_id AS VARCHAR) AS job_id, 'doc_' || d.doc_id || '.txt' AS file_name, d.lang AS source_lang, 'PENDING' AS status,
      CAST(count(s.chunk_index) AS INTEGER) AS total_chunks, 0 AS completed_chunks, 0.15::DOUBLE AS temperature, 5 AS parser_version,
      'openai' AS api_type, {Q.ts_text(Q.ts('d.doc_id'))} AS created_at, CAST(sum(s.tokens_est) AS BIGINT) AS tokens, count(s.chunk_index) AS rows_created
    FROM documents d JOIN segs s USING (doc_id) GROUP BY d.doc_id, d.lang""",
)
def create_jobs(spark, sf):
    d = F.col("doc_id")
    requests = tb.documents(spark, sf).select(
        d.cast("string").alias("job_id"), F.concat(F.lit("doc_"), d.cast("string"), F.lit(".txt")).alias("file_name"),
        F.lit("txt").alias("file_type"), F.col("lang").alias("source_lang"), F.lit("fr").alias("target_lang"),
        F.lit("base").alias("model"), tb.minute(d).alias("created_at"),
    )
    segs = tb.segments(spark, sf, 1000).withColumn("job_id", d.cast("string"))
    jobs, rows = G.create_jobs(requests, segs)
    sums = rows.groupBy("job_id").agg(F.sum("tokens_est").alias("tokens"), F.count("*").alias("rows_created"))
    return jobs.join(sums, "job_id").select(
        "job_id", "file_name", "source_lang", "status", "total_chunks", "completed_chunks", "temperature",
        "parser_version", "api_type", text_time("created_at"), "tokens", "rows_created",
    )


@register("list_jobs", Q.STATE + f" SELECT job_id, file_name, status, completed_chunks, {Q.ts_text('created_at')} AS created_at FROM jobs ORDER BY created_at DESC, job_id")
def list_jobs(spark, sf):
    return G.list_jobs(jobs_of(spark, sf)).select("job_id", "file_name", "status", "completed_chunks", text_time("created_at"))


@register("job_segments", Q.STATE + " SELECT job_id, chunk_index, original_text, status, tokens_est, node_list FROM segments ORDER BY job_id, chunk_index")
def job_segments(spark, sf):
    out = G.job_segments(segs_of(spark, sf))
    return nodes_as_text(out.select("job_id", "chunk_index", "original_text", "status", "tokens_est", "node_indices"))


@register(
    "transition_jobs",
    Q.STATE
    + f""" SELECT job_id, CASE WHEN doc_id % 3 < 2 AND status IN ('PENDING', 'PAUSED', 'FAILED') THEN 'PROCESSING' ELSE status END AS status,
      CASE WHEN doc_id % 3 < 2 THEN status IN ('PENDING', 'PAUSED', 'FAILED') END AS applied, {Q.ts_text('completed_at')} AS completed_at FROM jobs""",
)
def transition_jobs(spark, sf, copies=1):
    jobs = jobs_of(spark, sf)
    allowed = F.array(F.lit("PENDING"), F.lit("PAUSED"), F.lit("FAILED"))
    commands = jobs.where(F.col("job_id").cast("long") % 3 < 2).select(
        "job_id", allowed.alias("allowed"), F.lit("PROCESSING").alias("new_status")
    )
    commands = commands.select("*", F.explode(F.array(*map(F.lit, range(copies)))).alias("copy")).drop("copy")
    return G.transition_jobs(jobs, commands).select("job_id", "status", "applied", text_time("completed_at"))


@register("transition_jobs_repeated", ORACLES["transition_jobs"])
def transition_jobs_repeated(spark, sf):
    """The same commands, each delivered three times."""
    return transition_jobs(spark, sf, 3)


@register(
    "racing_transitions",
    Q.STATE
    + """ SELECT job_id, CASE WHEN status IN ('PENDING', 'PAUSED') AND doc_id % 3 < 2 THEN 'PROCESSING' WHEN status = 'PENDING' OR status = 'FAILED' THEN 'PAUSED' ELSE status END AS status,
      CASE WHEN doc_id % 3 < 2 THEN status IN ('PENDING', 'PAUSED') END AS first_applied,
      status = 'FAILED' OR (status = 'PENDING' AND doc_id % 3 = 2) AS second_applied, 1 AS refused, 3 AS version FROM jobs""",
)
def racing_transitions(spark, sf):
    """Two writers change the same version of the jobs; the slower one is refused and repeats its change on the new version."""
    store = SnapshotLog(spark, scratch_folder(spark, "race"))
    store.commit({"jobs": jobs_of(spark, sf)}, 0)
    command = lambda jobs, allowed, new: jobs.select("job_id", F.array(*map(F.lit, allowed)).alias("allowed"), F.lit(new).alias("new_status"))
    refused, base = 0, store.version()
    jobs = store.read("jobs", base)
    start = G.transition_jobs(jobs, command(jobs.where(F.col("job_id").cast("long") % 3 < 2), ["PENDING", "PAUSED"], "PROCESSING"))

    def pause(read):
        nonlocal refused
        now = read("jobs").drop("applied")
        refused += 1
        if refused == 1:  # the other writer comes in between
            store.commit({"jobs": start}, base)
        return {"jobs": G.transition_jobs(now, command(now, ["PENDING", "FAILED"], "PAUSED"))}

    version = store.update(pause)
    first = store.read("jobs", base + 1).select("job_id", F.col("applied").alias("first_applied"))
    return store.read("jobs").join(first, "job_id").select(
        "job_id", "status", "first_applied", F.col("applied").alias("second_applied"), F.lit(refused - 1).alias("refused"), F.lit(version).alias("version")
    )


CHUNK_HIT = "(doc_id + chunk_index) % 2 = 0"


def chunk_commands(segs, *extra):
    chosen = segs.where((F.col("job_id").cast("long") + F.col("chunk_index")) % 2 == 0)
    return chosen.select("job_id", "chunk_index", tb.minute(F.lit(999_999)).alias("at"), *extra)


@register(
    "claim_segments",
    Q.STATE
    + f""" SELECT job_id, chunk_index, CASE WHEN hit THEN 'PROCESSING' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE error_message END AS error_message,
      translated_text, {Q.ts_text(f"CASE WHEN hit THEN {Q.ts('999999')} ELSE updated_at END")} AS updated_at, hit AS claimed
    FROM (SELECT *, {CHUNK_HIT} AND status IN ('PENDING', 'FAILED') AS hit FROM segments)""",
)
def claim_segments(spark, sf):
    _, segs = both(spark, sf)
    out = G.claim_segments(segs, chunk_commands(segs))
    return out.select("job_id", "chunk_index", "status", "error_message", "translated_text", text_time("updated_at"), "claimed")


@register(
    "complete_segments",
    Q.STATE
    + f""", updated AS (SELECT *, {CHUNK_HIT} AS hit, CASE WHEN {CHUNK_HIT} THEN 'DONE' ELSE status END AS new_status FROM segments),
    per_job AS (SELECT job_id, bool_or(hit) AS touched, count(*) FILTER (new_status = 'DONE') AS done,
       count(*) FILTER (new_status = 'DONE' AND error_message IS NULL OR hit) AS clean,
       sum(length(CASE WHEN hit THEN 'R:' || original_text ELSE translated_text END)) AS chars FROM updated GROUP BY job_id)
    SELECT j.job_id, CAST(CASE WHEN touched THEN done ELSE completed_chunks END AS INTEGER) AS completed_chunks, total_chunks, done AS done_rows, chars
    FROM jobs j JOIN per_job USING (job_id)""",
)
def complete_segments(spark, sf, replayed=False):
    jobs, segs = both(spark, sf)
    results = chunk_commands(segs, F.concat(F.lit("R:"), "original_text").alias("result_text"))
    if replayed:  # the same results again, and older ones that must not win
        older = results.withColumns({"result_text": F.lit("older"), "at": F.lit(None).cast(results.schema["at"].dataType)})
        results = results.unionByName(results).unionByName(older)
    jobs, done = G.complete_segments(jobs, segs, results)
    sums = done.groupBy("job_id").agg(
        F.count_if(F.col("status") == "DONE").alias("done_rows"), F.sum(F.length("translated_text")).alias("chars")
    )
    return jobs.join(sums, "job_id").select("job_id", "completed_chunks", "total_chunks", "done_rows", "chars")


@register("complete_segments_replayed", ORACLES["complete_segments"])
def complete_segments_replayed(spark, sf):
    return complete_segments(spark, sf, replayed=True)


@register(
    "fail_segments",
    Q.STATE
    + f""" SELECT job_id, chunk_index, CASE WHEN hit THEN 'FAILED' ELSE status END AS status,
      CASE WHEN hit THEN substr('boom ' || original_text, 1, 1000) ELSE error_message END AS error_message, translated_text,
      {Q.ts_text(f"CASE WHEN hit THEN {Q.ts('999999')} ELSE updated_at END")} AS updated_at
    FROM (SELECT *, {CHUNK_HIT} AS hit FROM segments)""",
)
def fail_segments(spark, sf):
    _, segs = both(spark, sf)
    failures = chunk_commands(segs, F.concat(F.lit("boom "), "original_text").alias("error"))
    return seg_view(G.fail_segments(segs, failures))


@register(
    "reset_segments",
    Q.STATE
    + f""" SELECT job_id, chunk_index, CASE WHEN status IN ('FAILED', 'PROCESSING') THEN 'PENDING' ELSE status END AS status,
      NULL::VARCHAR AS error_message, translated_text,
      {Q.ts_text(f"CASE WHEN status IN ('FAILED', 'PROCESSING') THEN {Q.ts('999999')} ELSE updated_at END")} AS updated_at FROM segments""",
)
def reset_segments(spark, sf):
    return seg_view(G.reset_segments(segs_of(spark, sf), tb.minute(F.lit(999_999))))


@register(
    "recover",
    Q.STATE
    + """, s AS (SELECT job_id, count(*) FILTER (status IN ('PENDING', 'PROCESSING')) AS waiting FROM segments GROUP BY job_id)
    SELECT job_id, CASE WHEN status = 'PROCESSING' THEN 'PAUSED' ELSE status END AS status, waiting FROM jobs JOIN s USING (job_id)""",
)
def recover(spark, sf):
    jobs, segs = G.recover(*both(spark, sf))
    waiting = segs.groupBy("job_id").agg(F.count_if(F.col("status") == "PENDING").alias("waiting"))
    return jobs.join(waiting, "job_id").select("job_id", "status", "waiting")


@register("unfinished", Q.STATE + " SELECT job_id, count(*) FILTER (status <> 'DONE') AS unfinished FROM segments GROUP BY job_id")
def unfinished(spark, sf):
    return G.unfinished(segs_of(spark, sf))


@register(
    "resolve_job_status",
    Q.STATE
    + f""", u AS (SELECT job_id, count(*) FILTER (status <> 'DONE') AS n FROM segments GROUP BY job_id)
    SELECT job_id, CASE WHEN status <> 'PROCESSING' THEN status WHEN coalesce(n, 0) > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
      {Q.ts_text(f"CASE WHEN status <> 'PROCESSING' THEN completed_at WHEN coalesce(n, 0) = 0 THEN {Q.ts('999999')} END")} AS completed_at
    FROM jobs LEFT JOIN u USING (job_id)""",
)
def resolve_job_status(spark, sf):
    out = G.resolve_job_status(*both(spark, sf), tb.minute(F.lit(999_999)))
    return out.select("job_id", "status", text_time("completed_at"))


@register(
    "path_references",
    Q.STATE
    + """, p AS (SELECT job_id, source_path AS path FROM jobs UNION SELECT job_id, output_path FROM jobs)
    SELECT a.job_id, a.path, (SELECT count(*) FROM p b WHERE b.path = a.path AND b.job_id <> a.job_id) AS other_users,
           NOT EXISTS (SELECT 1 FROM p b WHERE b.path = a.path AND b.job_id <> a.job_id) AS deletable FROM p a""",
)
def path_references(spark, sf):
    return G.path_references(jobs_of(spark, sf))


@register(
    "patch_jobs",
    Q.STATE
    + """ SELECT job_id, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'new-model' ELSE model END AS model,
      CASE WHEN doc_id % 4 = 1 AND doc_id % 2 = 1 THEN 0.5 ELSE temperature END AS temperature, concurrency FROM jobs""",
)
def patch_jobs(spark, sf):
    jobs = jobs_of(spark, sf)
    n = F.col("job_id").cast("long")
    patches = picked(jobs, 4, 1).select(
        "job_id", F.when(n % 3 == 0, "new-model").alias("model"), F.when(n % 2 == 1, 0.5).alias("temperature"),
        F.lit(None).cast("int").alias("concurrency"),
    )
    return G.patch_jobs(jobs, patches).select("job_id", "model", "temperature", "concurrency")


# Clients are the customers; each job originates from the order and customer of its number.
def clients(spark, sf):
    c = F.col("c_custkey")
    return tb.table(spark, sf, "customer").select(
        c.cast("string").alias("client_id"), F.col("c_name").alias("name"),
        G.token_hash(F.concat(F.lit("tdk_"), "c_name")).alias("token_hash"),
        F.when(c % 3 != 0, F.lower("c_mktsegment")).alias("default_provider"),
        F.when(c % 2 == 0, F.concat(F.lit("model-"), F.col("c_nationkey").cast("string"))).alias("default_model"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
    )


_ORIGINS = """, origins AS (SELECT job_id, CAST(o_custkey AS VARCHAR) AS client_id, c_name AS client_name, 'ref-' || o_orderkey AS external_ref
  FROM jobs JOIN orders ON o_orderkey = doc_id JOIN customer ON c_custkey = o_custkey)"""


def tagged(spark, sf):
    orders = tb.table(spark, sf, "orders")
    origins = orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("client_id"),
        F.concat(F.lit("ref-"), F.col("o_orderkey").cast("string")).alias("external_ref"),
    )
    return G.tag_origin(jobs_of(spark, sf), origins, clients(spark, sf))


@register("tag_origin", Q.STATE + _ORIGINS + " SELECT j.job_id, client_id, client_name, external_ref FROM jobs j LEFT JOIN origins USING (job_id)")
def tag_origin(spark, sf):
    return tagged(spark, sf).select("job_id", "client_id", "client_name", "external_ref")


@register(
    "client_jobs",
    Q.STATE + _ORIGINS + f" SELECT client_id, job_id, status, {Q.ts_text('created_at')} AS created_at FROM jobs JOIN origins USING (job_id)",
)
def client_jobs(spark, sf):
    return G.client_jobs(tagged(spark, sf)).select("client_id", "job_id", "status", text_time("created_at"))


def token_requests(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    token = (
        F.when(k % 7 == 0, F.concat(F.lit("key_"), name)).when(k % 11 == 0, F.concat(F.lit("tdk_"), F.repeat(name, 20)))
        .when(k % 13 == 0, F.concat(F.lit("tdk_"), F.reverse(name))).otherwise(F.concat(F.lit("tdk_"), name))
    )
    return tb.table(spark, sf, "orders").select("o_orderkey", token.alias("token"), F.col("o_orderdate").cast("string").alias("at"))


@register(
    "resolve_client",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS client_id
       FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')""",
)
def resolve_client(spark, sf):
    return G.resolve_client(token_requests(spark, sf), clients(spark, sf)).select("o_orderkey", "client_id")


@register(
    "client_last_use",
    """SELECT CAST(c_custkey AS VARCHAR) AS client_id, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_used_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY c_custkey""",
)
def client_last_use(spark, sf):
    requests = token_requests(spark, sf).withColumn("at", F.to_timestamp_ntz("at"))
    resolved = G.resolve_client(requests, clients(spark, sf))
    return G.touch_clients(clients(spark, sf), resolved).select(
        "client_id", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used_at")
    )


@register(
    "delete_jobs",
    Q.STATE
    + """ SELECT job_id, status, n AS segment_rows FROM jobs JOIN (SELECT job_id, count(*) AS n FROM segments GROUP BY job_id) USING (job_id)
      WHERE doc_id % 6 <> 2""",
)
def delete_jobs(spark, sf):
    jobs, segs = both(spark, sf)
    left_jobs, left_segs = G.delete_jobs(jobs, segs, picked(jobs, 6, 2))
    counts = left_segs.groupBy("job_id").agg(F.count("*").alias("segment_rows"))
    return left_jobs.join(counts, "job_id").select("job_id", "status", "segment_rows")


@register(
    "evolve_schema",
    """SELECT CAST(doc_id AS VARCHAR) AS job_id, lang AS source_lang, 0.15::DOUBLE AS temperature, 1 AS concurrency, 1000 AS chunk_size, 'translation' AS job_type,
         5 AS parser_version, false AS enable_proofreading, NULL::VARCHAR AS client_id FROM documents""",
)
def evolve_schema(spark, sf):
    old = tb.documents(spark, sf).select(F.col("doc_id").cast("string").alias("job_id"), F.col("lang").alias("source_lang"))
    return G.evolve_schema(old).select(
        "job_id", "source_lang", "temperature", "concurrency", "chunk_size", "job_type", "parser_version",
        "enable_proofreading", "client_id",
    )


@register(
    "duplicate_keys",
    Q.STATE + " SELECT job_id, chunk_index, CAST(2 AS BIGINT) AS copies FROM segments WHERE chunk_index % 3 = 1",
)
def duplicate_keys(spark, sf):
    _, segs = both(spark, sf)
    return G.duplicate_keys(segs.unionByName(segs.where("chunk_index % 3 = 1")))


@register(
    "request_defaults",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ' OLLAMA ' WHEN o_orderkey % 5 = 1 THEN lower(c_mktsegment) ELSE '' END AS provider,
         CASE WHEN o_orderkey % 3 = 0 THEN 'asked' END AS model, CASE WHEN o_orderkey % 50 = 0 THEN 201 ELSE 10 END AS ref_len,
         CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS dp, CASE WHEN c_custkey % 2 = 0 THEN 'model-' || c_nationkey END AS dm
       FROM orders JOIN customer ON c_custkey = o_custkey),
    c AS (SELECT *, lower(trim(coalesce(nullif(provider, ''), dp, 'openai'))) AS chosen_provider FROM r),
    m AS (SELECT *, coalesce(model, CASE WHEN chosen_provider = coalesce(dp, '') THEN dm END) AS chosen_model FROM c)
    SELECT o_orderkey, chosen_provider, chosen_model, CASE WHEN chosen_provider IN ('lm-studio', 'ollama') THEN 1 ELSE 4 END AS concurrency,
      CASE WHEN chosen_provider IN ('lm-studio', 'ollama') THEN 1000 ELSE 6000 END AS chunk_size,
      CASE WHEN ref_len > 200 THEN 'external_ref' WHEN chosen_model IS NULL THEN 'model' END AS reject_reason FROM m""",
)
def request_defaults(spark, sf):
    k = F.col("o_orderkey")
    customers = tb.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = tb.table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    requests = orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("client_id"),
        F.when(k % 5 == 0, " OLLAMA ").when(k % 5 == 1, F.lower("c_mktsegment")).otherwise("").alias("provider"),
        F.when(k % 3 == 0, "asked").alias("model"),
        F.repeat(F.lit("r"), F.when(k % 50 == 0, 201).otherwise(10)).alias("external_ref"),
    )
    return G.request_defaults(requests, clients(spark, sf)).select(
        "o_orderkey", "chosen_provider", "chosen_model", "concurrency", "chunk_size", "reject_reason"
    )


@register(
    "start_jobs",
    Q.STATE
    + """ SELECT job_id, CASE WHEN doc_id % 4 = 1 THEN 'fast' ELSE model END AS model,
      CASE WHEN doc_id % 4 = 1 AND status IN ('PENDING', 'PAUSED', 'FAILED') THEN 'PROCESSING' ELSE status END AS status FROM jobs""",
)
def start_jobs(spark, sf):
    jobs = jobs_of(spark, sf)
    patches = picked(jobs, 4, 1).select("job_id", F.lit("fast").alias("model"))
    return G.start_jobs(jobs, patches).select("job_id", "model", "status")


def _after(word, failed):
    sets = "('FAILED', 'PROCESSING')" if failed else "('PROCESSING')"
    return (
        Q.STATE
        + f""", s AS (SELECT job_id, count(*) FILTER (status = 'PENDING' OR (doc_id % 4 = 1 AND status IN {sets})) AS waiting FROM segments GROUP BY job_id)
        SELECT job_id, CASE WHEN doc_id % 4 = 1 THEN '{word}' ELSE status END AS status, waiting FROM jobs JOIN s USING (job_id)"""
    )


def waiting_view(jobs, segs):
    waiting = segs.groupBy("job_id").agg(F.count_if(F.col("status") == "PENDING").alias("waiting"))
    return jobs.join(waiting, "job_id").select("job_id", "status", "waiting")


@register("pause_jobs", _after("PAUSED", False))
def pause_jobs(spark, sf):
    jobs, segs = both(spark, sf)
    return waiting_view(*G.pause_jobs(jobs, segs, picked(jobs, 4, 1), tb.minute(F.lit(9))))


@register("retry_jobs", _after("PENDING", True))
def retry_jobs(spark, sf):
    jobs, segs = both(spark, sf)
    return waiting_view(*G.retry_jobs(jobs, segs, picked(jobs, 4, 1), tb.minute(F.lit(9))))


# ---- rebuild -----------------------------------------------------------------------------------


def node_rows(spark, sf):
    return tb.line_node_rows(spark, sf).select(F.col("doc_id").cast("string").alias("job_id"), "node_idx", "html")


# Blocks of the segments come straight from the packed units, without re-parsing the text.
_BLOCKS = """, blocks AS (SELECT CAST(c.doc_id AS VARCHAR) AS job_id, c.doc_id, CAST(c.chunk AS INTEGER) AS chunk_index, p.k, p.node_idx, p.html,
  CAST(row_number() OVER (PARTITION BY c.doc_id, c.chunk ORDER BY p.k) - 1 AS INTEGER) AS pos
  FROM pack c JOIN placed p ON p.doc_id = c.doc_id AND p.k = c.k)"""


@register(
    "remap_blocks",
    Q.STATE
    + _BLOCKS
    + """ SELECT b.job_id, b.chunk_index, b.pos, b.node_idx, CASE WHEN bad THEN NULL ELSE 'p' END AS tag, CASE WHEN bad THEN NULL ELSE replace(b.html, 'the', 'le') END AS html,
      CASE WHEN bad THEN 'segment ' || (b.chunk_index + 1) || ': ' || (n + 1) || ' blocks for ' || n || ' nodes' END AS error
    FROM (SELECT *, (doc_id + chunk_index) % 11 = 0 AS bad, count(*) OVER (PARTITION BY job_id, chunk_index) AS n FROM blocks) b
    JOIN segments s USING (job_id, chunk_index) WHERE s.status = 'DONE'""",
)
def remap_blocks(spark, sf):
    bad = (F.col("job_id").cast("long") + F.col("chunk_index")) % 11 == 0
    segs = segs_of(spark, sf).where("status = 'DONE'").withColumn(
        "translated_text", F.when(bad, F.concat("translated_text", F.lit("<p>extra</p>"))).otherwise(F.col("translated_text"))
    )
    return R.remap_blocks(segs)


_MERGED = """, merged AS (SELECT job_id, doc_id, node_idx, CASE WHEN count(*) = 1 THEN any_value(html)
   ELSE '<p>' || string_agg(html[4:-5], ' ' ORDER BY k) || '</p>' END AS html FROM blocks GROUP BY job_id, doc_id, node_idx)"""


@register("merge_fragments", Q.STATE + _BLOCKS + _MERGED + " SELECT job_id, node_idx, html, NULL::VARCHAR AS error FROM merged")
def merge_fragments(spark, sf):
    return R.merge_fragments(R.remap_blocks(segs_of(spark, sf), "original_text"))


@register(
    "coverage",
    Q.STATE
    + _BLOCKS
    + """, done AS (SELECT DISTINCT b.job_id, b.node_idx + CASE WHEN b.doc_id % 10 = 9 THEN 100000 ELSE 0 END AS node_idx
      FROM blocks b JOIN segments s USING (job_id, chunk_index) WHERE s.status = 'DONE'),
    want AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, node_idx FROM nodes)
    SELECT job_id, node_idx, 'unknown' AS problem FROM (SELECT * FROM done EXCEPT SELECT * FROM want)
    UNION ALL SELECT job_id, node_idx, 'missing' FROM (SELECT * FROM want EXCEPT SELECT * FROM done)""",
)
def coverage(spark, sf):
    blocks = R.remap_blocks(segs_of(spark, sf).where("status = 'DONE'"))
    shifted = blocks.withColumn(
        "node_idx", F.col("node_idx") + F.when(F.col("job_id").cast("long") % 10 == 9, 100_000).otherwise(0)
    )
    return R.coverage(node_rows(spark, sf), shifted)


@register(
    "partial_preview",
    Q.STATE
    + _BLOCKS
    + """, typed AS (SELECT b.*, j.file_type IN ('epub', 'pdf', 'docx') AS copied, s.status = 'DONE' AS is_done,
         CASE WHEN s.status = 'DONE' THEN replace(b.html, 'the', 'le') ELSE b.html END AS chosen
       FROM blocks b JOIN segments s USING (job_id, chunk_index) JOIN jobs j USING (job_id)),
    touched AS (SELECT DISTINCT job_id, node_idx FROM typed WHERE is_done),
    merged AS (SELECT t.job_id, t.node_idx, CASE WHEN count(*) = 1 THEN any_value(chosen) ELSE '<p>' || string_agg(chosen[4:-5], ' ' ORDER BY k) || '</p>' END AS html
       FROM typed t LEFT JOIN touched USING (job_id, node_idx) WHERE NOT copied OR touched.job_id IS NOT NULL GROUP BY t.job_id, t.node_idx)
    SELECT CAST(n.doc_id AS VARCHAR) AS job_id, n.node_idx, coalesce(m.html, n.html) AS html, m.html IS NOT NULL AS replaced, NULL::VARCHAR AS error
    FROM nodes n LEFT JOIN merged m ON m.job_id = CAST(n.doc_id AS VARCHAR) AND m.node_idx = n.node_idx""",
)
def partial_preview(spark, sf):
    return R.partial_preview(*both(spark, sf), node_rows(spark, sf))


# Rendering the untranslated nodes gives the (normalised) source document back.
_PIECE = """CASE WHEN kind LIKE 'fence%' THEN CASE WHEN suppress_fence OR sub > 0 THEN '' ELSE fence_open || chr(10) END || plain
     || CASE WHEN suppress_fence OR sub < parts - 1 THEN '' ELSE chr(10) || '```' END
   ELSE CASE WHEN kind = 'list_item' THEN marker WHEN kind = 'blockquote' THEN '> ' WHEN kind = 'heading' THEN repeat('#', CAST(tag[2:2] AS INTEGER)) || ' ' ELSE '' END
     || coalesce(code_wrapper, '') || plain || coalesce(code_wrapper, '') END"""
_SEP = "chr(10) || CASE WHEN sub = 0 OR suppress_fence THEN chr(10) ELSE '' END"


@register(
    "render_text",
    f"""WITH {Q.MD_NODES} SELECT doc_id, 0 AS part, string_agg({_SEP} || {_PIECE}, '' ORDER BY node_idx)[3:] || chr(10) AS text
        FROM md_nodes GROUP BY doc_id""",
)
def render_text(spark, sf):
    nodes = tb.md_nodes(spark, sf).withColumn("file_type", F.lit("md"))
    return R.assemble_text(R.render_text(nodes))


@register(
    "render_fences",
    f"WITH {Q.MD_NODES} SELECT doc_id, node_idx, {_SEP} AS sep, {_PIECE} AS piece FROM md_nodes WHERE kind LIKE 'fence%'",
)
def render_fences(spark, sf):
    nodes = tb.md_nodes(spark, sf).where(F.startswith("kind", F.lit("fence"))).withColumn("file_type", F.lit("md"))
    return R.render_text(nodes)


# The "translation" is the block without attributes (page % 3 = 0), in another tag (1) or with one more inline tag (2).
@register(
    "restore_inline_attributes",
    f"""WITH RECURSIVE {Q.html_ctes('pages').lstrip()},
    b AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS block_idx, tag, html FROM html_all WHERE NOT nested)
    SELECT page_id, block_idx, CASE page_id % 3 WHEN 0 THEN html
      WHEN 1 THEN '<' || tag || '>' || {Q.escape_text("replace(replace(" + Q.tagless('html') + ", '&quot;', chr(34)), '&amp;', '&')")} || '</' || tag || '>'
      ELSE replace(regexp_replace(html, '<a [^>]*>', '<a>', 'g') || chr(1), '</' || tag || '>' || chr(1), '<i>x</i></' || tag || '>') END AS html
    FROM b WHERE {Q.strip(Q.tagless('html'))} <> ''""",
)
def restore_inline_attributes(spark, sf):
    from quire.functions import html as H

    blocks = X.html_blocks(tb.pages(spark, sf))
    inner = H.inner_html(H.strip_attributes(F.col("html")))

    def wrapped(tag, *content):
        return F.concat(F.lit("<"), tag, F.lit(">"), *content, F.lit("</"), tag, F.lit(">"))

    k = F.col("page_id") % 3
    translated = (
        F.when(k == 0, wrapped(F.col("tag"), inner)).when(k == 1, wrapped(F.lit("figcaption"), inner))
        .otherwise(wrapped(F.col("tag"), inner, F.lit("<i>x</i>")))
    )
    return blocks.withColumn("translated", translated).select(
        "page_id", "block_idx", R.restore_inline_attributes(F.col("html"), F.col("translated")).alias("html")
    )


@register(
    "clone_for_proofread",
    Q.STATE
    + """, u AS (SELECT job_id, count(*) FILTER (status <> 'DONE') AS n FROM segments GROUP BY job_id)
    SELECT job_id || '-proof' AS job_id, job_id AS parent_id, file_name, target_lang AS source_lang, target_lang, model, 0.15::DOUBLE AS temperature, 'proofreading' AS job_type,
      'relu_' || file_name AS output_name, CASE WHEN status = 'COMPLETED' AND coalesce(n, 0) = 0 THEN NULL ELSE 'unfinished' END AS reject_reason
    FROM jobs LEFT JOIN u USING (job_id)""",
)
def clone_for_proofread(spark, sf):
    return R.clone_for_proofread(*both(spark, sf)).select(
        "job_id", "parent_id", "file_name", "source_lang", "target_lang", "model", "temperature", "job_type",
        "output_name", "reject_reason",
    )


@register(
    "export_manifest",
    Q.STATE
    + """, u AS (SELECT job_id, count(*) FILTER (status <> 'DONE') AS n FROM segments GROUP BY job_id),
    p AS (SELECT jobs.*, status <> 'COMPLETED' OR coalesce(n, 0) > 0 AS partial FROM jobs LEFT JOIN u USING (job_id))
    SELECT job_id, CASE WHEN partial THEN 'partial' ELSE 'final' END AS export, NOT partial OR completed_chunks > 0 AS downloadable,
      CASE WHEN partial THEN 'apercu_partiel_' || file_name ELSE file_name END AS download_name,
      CASE file_type WHEN 'epub' THEN 'application/epub+zip' WHEN 'pdf' THEN 'application/pdf' WHEN 'md' THEN 'text/markdown; charset=utf-8'
        WHEN 'txt' THEN 'text/plain; charset=utf-8' ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS media_type FROM p""",
)
def export_manifest(spark, sf):
    return R.export_manifest(*both(spark, sf))


@register(
    "safe_filename",
    r"""WITH n AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base FROM (SELECT page_id, url || '/Ünï çode*' || page_id || '.TXT' AS url FROM pages)),
    s AS (SELECT page_id, regexp_extract(base, '^(.+)\.[^.]+$', 1) AS stem, lower(regexp_extract(base, '(\.[^.]+)$', 1)) AS suffix FROM n)
    SELECT page_id, coalesce(nullif(trim(regexp_replace(stem, '[^\p{L}\p{N}_ .()-]', '_', 'g'), ' .'), ''), 'document')[1:160] || suffix AS safe FROM s""",
)
def safe_filename(spark, sf):
    name = F.concat("url", F.lit("/Ünï çode*"), F.col("page_id").cast("string"), F.lit(".TXT"))
    return tb.pages(spark, sf).select("page_id", R.safe_filename(name).alias("safe"))


# ---- reports -----------------------------------------------------------------------------------


@register(
    "progress_api",
    Q.STATE
    + """ SELECT job_id, CASE status WHEN 'PROCESSING' THEN 'running' ELSE lower(status) END AS status, completed_chunks AS completed, total_chunks AS total,
      CASE WHEN total_chunks = 0 THEN 0 ELSE CAST(CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS INTEGER) END AS percent
    FROM (SELECT *, completed_chunks * 100.0::DOUBLE / nullif(total_chunks, 0) AS x FROM jobs)""",
)
def progress_api(spark, sf):
    return I.progress_api(jobs_of(spark, sf))


@register(
    "progress_ui",
    Q.STATE
    + " SELECT job_id, CASE WHEN total_chunks = 0 THEN 0 ELSE CAST(floor(completed_chunks * 100.0::DOUBLE / total_chunks + 0.5) AS INTEGER) END AS percent FROM jobs",
)
def progress_ui(spark, sf):
    return I.progress_ui(jobs_of(spark, sf))


@register(
    "status_counts",
    Q.STATE
    + """ SELECT 'active_jobs' AS name, count(*) FILTER (status = 'PROCESSING') AS n FROM jobs
      UNION ALL SELECT 'failed_segments', count(*) FILTER (status = 'FAILED') FROM segments""",
)
def status_counts(spark, sf):
    return I.status_counts(*both(spark, sf))


@register(
    "recent_log",
    Q.STATE
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chunk_index DESC) AS rank FROM segments WHERE status IN ('DONE', 'FAILED'))
    SELECT job_id, CAST(rank AS INTEGER) AS rank, chunk_index, CASE status WHEN 'DONE' THEN 'segment_completed' ELSE 'segment_failed' END AS type,
      {Q.ts_text('updated_at')} AS timestamp FROM ranked WHERE rank <= 30""",
)
def recent_log(spark, sf):
    return I.recent_log(segs_of(spark, sf)).select("job_id", "rank", "chunk_index", "type", text_time("timestamp"))


@register(
    "latest_segment",
    Q.STATE + " SELECT job_id, coalesce(max(chunk_index) FILTER (status IN ('DONE', 'PROCESSING')), 0) AS latest FROM segments GROUP BY job_id",
)
def latest_segment(spark, sf):
    return I.latest_segment(segs_of(spark, sf))


@register("search_jobs", Q.STATE + " SELECT job_id, file_name FROM jobs WHERE lower(file_name) LIKE '%5.e%'")
def search_jobs(spark, sf):
    return I.search_jobs(jobs_of(spark, sf), " 5.E ").select("job_id", "file_name")


@register(
    "segment_token_report",
    Q.STATE
    + f""" SELECT job_id, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN {Q.tokens('original_text')} ELSE tokens_est END AS source_tokens,
      coalesce({Q.tokens('translated_text')}, 0) AS target_tokens FROM segments""",
)
def segment_token_report(spark, sf):
    segs = segs_of(spark, sf).withColumn("tokens_est", F.when(F.col("chunk_index") % 3 == 0, 0).otherwise(F.col("tokens_est")))
    return I.segment_token_report(segs)
