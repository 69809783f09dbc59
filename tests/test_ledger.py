from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.sources.commits import Conflict, SnapshotLog
from quire.streaming import events as J
from quire.streaming import ledger as L


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = SnapshotLog(spark, str(tmp_path))
    assert store.version() == 0
    store.commit({"a": numbers(spark, 1), "b": numbers(spark, 7)}, 0)
    assert store.commit({"a": numbers(spark, 2)}, 1) == 2
    with pytest.raises(Conflict):
        store.commit({"a": numbers(spark, 3)}, 1)
    assert values(store.read("a")) == [2] and values(store.read("b")) == [7] and values(store.read("a", 1)) == [1]
    # A refused change is made again on the version that won.
    tries = []

    def change(read):
        tries.append(values(read("a")))
        if len(tries) == 1:
            store.commit({"a": numbers(spark, 10)}, 2)
        return {"a": read("a").withColumn("v", F.col("v") + 1)}

    assert store.update(change) == 4
    assert tries == [[2], [10]] and values(store.read("a")) == [11]


def test_a_file_of_the_log_is_never_replaced(spark, tmp_path):
    store = SnapshotLog(spark, str(tmp_path))
    assert store._publish("00000000000000000001.json", '{"x": 1}')
    assert not store._publish("00000000000000000001.json", '{"x": 2}')
    assert store.entry(1) == {"x": 1}
    assert [p.name for p in (tmp_path / "_log").iterdir() if not p.name.startswith(".")] == ["00000000000000000001.json"]


def test_data_of_a_refused_commit_goes_and_old_versions_expire(spark, tmp_path, monkeypatch):
    store = SnapshotLog(spark, str(tmp_path))
    store.commit({"a": numbers(spark, 1)}, 0)
    late = SnapshotLog(spark, str(tmp_path))
    monkeypatch.setattr(late, "version", lambda: 0)  # it has not seen the commit yet
    with pytest.raises(Conflict):
        late.commit({"a": numbers(spark, 5)}, 0)
    assert len(list((tmp_path / "a").iterdir())) == 1
    for k in range(3):
        store.commit({"a": numbers(spark, k)}, store.version())
    assert store.expire(2) == 2 and store.versions() == [3, 4]
    assert values(store.read("a")) == [2] and values(store.read("a", 3)) == [1]


def test_a_batch_counts_once(spark, tmp_path):
    """The same batch again, by another writer in between, and after a restart."""
    store = SnapshotLog(spark, str(tmp_path))
    store.commit({"tally": spark.createDataFrame([], "v int, n long")}, 0)
    told = []
    count = L.count_step(lambda batch: batch.groupBy("v").agg(F.count("*").alias("n")), ["v"])
    run = L.on_batch(store, "q", count, lambda batch, number: told.append(number))
    for number in (0, 0, 1, 1, 0):
        run(numbers(spark, 5, 5, 6), number)
    assert {r["v"]: r["n"] for r in store.read("tally").collect()} == {5: 4, 6: 2}
    assert told == [0, 1]
    raced = []

    def racing(batch, number, read):
        if not raced:
            raced.append(store.commit({"other": numbers(spark, 1)}, store.version()))
        return count(batch, number, read)

    L.on_batch(store, "q", racing)(numbers(spark, 6), 2)
    assert {r["v"]: r["n"] for r in store.read("tally").collect()} == {5: 4, 6: 3}
    assert store.entry(store.version())["batches"] == {"q": 2}


def test_dead_letters(spark, tmp_path):
    store = SnapshotLog(spark, str(tmp_path))
    schema = numbers(spark, 1).schema
    assert L.dead_letters(store, "q", schema).count() == 0

    def listener(batch, number):
        if number == 1:
            raise ValueError("no")

    run = L.on_batch(store, "q", lambda batch, number, read: {}, listener)
    for number in (0, 1, 1, 2):
        run(numbers(spark, number, 8), number)
    got = L.dead_letters(store, "q", numbers(spark, 1).schema).collect()
    assert sorted((r["v"], r["listener_error"], r["batch_id"]) for r in got) == [(1, "ValueError: no", 1), (8, "ValueError: no", 1)]


def completions(*rows):
    return [(i, "segment_completed", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), job, chunk) for i, (m, job, chunk) in enumerate(rows)]


def test_progress_state_is_released(spark, tmp_path):
    """Repeats over batches count once; keys that lie behind the horizon leave both operators."""
    schema = "seq long, type string, timestamp timestamp, job_id string, chunk_index int"
    batches = [
        completions(*[(0, "a", k) for k in range(50)]),
        completions(*[(5, "a", k) for k in range(60)]),
        completions(*[(600 * n, "b", n) for n in (1, 2)]),
        completions(*[(2000, "b", 9), (2001, "b", 9)]),
    ]
    base, sizes = str(tmp_path / "run"), []
    (tmp_path / "run" / "out").mkdir(parents=True)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = J.completions_by_slot(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "30 minutes", "10 minutes")
        query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append([sum(p["stateOperators"][k]["numRowsTotal"] for k in range(2)) for p in [query.lastProgress]][0])
    emitted = J.emitted_rows(spark, base, "slot struct<start: timestamp, end: timestamp>, job_id string, completed long")
    totals = spark.createDataFrame([("a", 60), ("b", 10)], "job_id string, total_chunks int")
    assert {r["job_id"]: r["completed"] for r in J.streamed_progress(emitted, totals).collect()} == {"a": 60, "b": 3}
    assert max(sizes) <= 63 and sizes[-1] <= 4


def test_rate_limit_over_batches(spark, tmp_path):
    """Verdicts over batches are those of one walk, and of a client at most its limit is carried."""
    import random

    rng = random.Random(2)
    rows, t = [], {"x": 0, "y": 0}
    for i in range(900):
        client = rng.choice("xxxy")
        t[client] += rng.choice([0, 0, 1, 2, 30])
        rows.append((client, "upload", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=max(t.values()))))
        t[client] = max(t.values())
    schema = "client string, class string, seq long, at timestamp"
    whole = J.rate_limit(spark.createDataFrame(rows, schema), {"upload": 3})
    store = SnapshotLog(spark, str(tmp_path / "store"))
    store.commit({"recent": spark.createDataFrame([], L.RECENT)}, 0)
    run = L.on_batch(store, "r", L.rate_step(lambda b: b, str(tmp_path / "out"), {"upload": 3}))
    for number in (0, 1, 1, 2):
        run(spark.createDataFrame(rows[300 * number : 300 * number + 300], schema), number)
        assert store.read("recent").groupBy("client").count().agg(F.max("count")).first()[0] <= 3
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((r["seq"], r["admitted"]) for r in df.collect())
    assert key(got) == key(whole)


# ---- published documents ------------------------------------------------------------------------


def test_library(spark, tmp_path):
    """Few files, byte ranges of single documents, partial ones unpublished, re-runs idempotent, changes picked up."""
    from quire.sources import library as D

    log = SnapshotLog(spark, str(tmp_path))
    text = lambda job, part: ("\n\n" if part else "") + f"é{job} part {part}\n\nmore" + ("\n" if part else "")
    rows = [(str(j), p, text(j, p)) for j in range(300) for p in range(2)] + [("big", p, "x" * 50_000 + "\n") for p in range(20)] + [("none", 0, "")]
    parts = spark.createDataFrame(rows, "job_id string, part int, text string")
    open_ = spark.createDataFrame([("7",), ("7",), ("8",)], "job_id string")
    assert D.publish_documents(log, parts, open_, files=6) == 299
    data = [p for p in (tmp_path / "files").rglob("part-*") if not p.name.endswith(".crc")]
    assert len(data) <= 6
    whole = {r["job_id"]: r["text"] for r in D.read_documents(log).collect()}
    assert set(whole) == {str(j) for j in range(300)} - {"7", "8"} | {"big"}
    assert whole["big"] == ("x" * 50_000 + "\n") * 20
    assert sum(p.stat().st_size for p in data) == sum(len(t.encode()) for t in whole.values())
    for job in ("0", "299", "big"):
        assert D.read_document(log, job) == whole[job]
    assert whole["5"] == "é5 part 0\n\nmore\n\né5 part 1\n\nmore\n"
    assert D.read_document(log, "7") is None
    # Again: nothing is written and no version made.
    assert D.publish_documents(log, parts, open_, files=6) == 0 and log.version() == 1
    # One text changes, one job is open again, another is done.
    changed = parts.withColumn("text", F.when((F.col("job_id") == "3") & (F.col("part") == 1), F.lit("new\n")).otherwise(F.col("text")))
    assert D.publish_documents(log, changed, spark.createDataFrame([("8",), ("9",)], "job_id string"), files=6) == 2
    assert D.read_document(log, "3").endswith("more\nnew\n") and D.read_document(log, "9") is None and D.read_document(log, "7")
    assert D.read_document(log, "5") == whole["5"]


def test_a_published_file_is_read_once_for_all_its_documents(spark, tmp_path):
    from quire.sources import library as D
    from quire.sources.commits import SnapshotLog

    log = SnapshotLog(spark, str(tmp_path / "library"))
    parts = spark.createDataFrame([(str(i), 0, f"a {i}\n") for i in range(20)], "job_id string, part int, text string")
    D.publish_documents(log, parts, parts.where("false").select("job_id"), files=2)
    plan = D.read_documents(log)._jdf.queryExecution().optimizedPlan().toString()
    places = plan[plan.index("Join") :]  # below the join: the index, one row for each file
    assert "Aggregate [file" in places
