"""Published documents in few large files, with an index of where each of them lies.

The texts of many documents follow one another in a text file; the index has (job, file, offset,
length, digest) in bytes. Files are new ones each time, and the index becomes visible as one commit
of a ``SnapshotLog``: readers see all documents of a publication or none. A document whose digest
has not changed stays where it is, so publishing the same documents again writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import let
from quire.session import settle
from quire.sources.commits import Reader, SnapshotLog

FILES = 64
FILE_BYTES = 256 << 20
_INDEX = "job_id string, file string, offset long, length long, first int, digest string"


def _files(log: SnapshotLog, folder: str, fields: str) -> DataFrame:
    """(slot, file) of the files that a publication has written, one for each slot."""
    found = []
    for slot in log.files.listStatus(log.path(folder)):
        name = slot.getPath().getName()
        if name.startswith("slot="):
            found += [
                (int(name.removeprefix("slot=")), f"{folder}/{name}/{f.getPath().getName()}")
                for f in log.files.listStatus(slot.getPath()) if f.getPath().getName().startswith("part-")
            ]
    return log.spark.createDataFrame(found, fields)


def _write(log: SnapshotLog, parts: DataFrame, digests: DataFrame, files: int | None) -> DataFrame:
    """Write the texts of ``parts`` (job_id, part, line, bytes) and return their index."""
    size = parts.agg(F.sum("bytes")).first()[0] or 0
    count = files or max(1, -(-size // FILE_BYTES))
    dealt = parts.repartitionByRange(count, "job_id", "part").withColumn("slot", F.spark_partition_id())
    rows = settle(dealt, "publish-rows")  # the slot of a row is fixed from here on
    folder = f"files/{uuid.uuid4().hex}"
    ordered = rows.repartition(count, "slot").sortWithinPartitions("slot", "job_id", "part")
    ordered.select("slot", F.col("line").alias("value")).write.partitionBy("slot").text(f"{log.root}/{folder}")
    # Sizes only: a document lies in one slot or, at a border, goes on at the start of the next ones.
    sizes = rows.groupBy("slot", "job_id").agg(F.sum("bytes").alias("length"), F.min("part").alias("first"))
    before = Window.partitionBy("slot").orderBy("job_id").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return (
        places.join(F.broadcast(_files(log, folder, "slot int, file string")), "slot").join(digests, "job_id")
        .select("job_id", "file", "offset", "length", "first", "digest")
    )


def publish_documents(log: SnapshotLog, parts: DataFrame, incomplete: DataFrame, key: str = "job_id", files: int | None = FILES) -> int:
    """Publish complete, non-empty documents; returns how many were new or changed.

    ``parts`` is the output of ``assemble_text`` (key, part, text), ``incomplete`` holds the keys that may
    not be published; what was published of them before is taken back. At most ``files`` files are
    written, or with None as many as the bytes need.
    """
    done = parts.join(incomplete.select(key).distinct(), key, "left_anti").where("text <> ''")
    # The text sink ends every row with a newline: it stands for the last newline of a document
    # and for the first one of the separator between two parts.
    line = F.regexp_replace("text", r"^\n|\n\z", "")
    done = settle(
        done.select(F.col(key).cast("string").alias("job_id"), "part", line.alias("line"), (F.octet_length(line) + 1).cast("long").alias("bytes")),
        "publish-parts",
    )
    parts_digest = F.array_sort(F.collect_list(F.struct("part", F.sha2("line", 256).alias("d"))))
    digests = done.groupBy("job_id").agg(F.sha2(F.array_join(F.transform(parts_digest, lambda x: x["d"]), ","), 256).alias("digest"))
    digests = settle(digests, "publish-digests")
    changed = 0

    def change(read: Reader) -> dict[str, DataFrame]:
        nonlocal changed
        known = read("index") if log.version() else log.spark.createDataFrame([], _INDEX)
        same = known.join(digests, ["job_id", "digest"], "left_semi")
        new = settle(digests.join(known, ["job_id", "digest"], "left_anti"), "publish-new")
        gone = incomplete.select(F.col(key).cast("string").alias("job_id")).distinct()
        stay = known.join(digests, "job_id", "left_anti").join(gone, "job_id", "left_anti")
        changed = new.count()
        if not changed and stay.unionByName(same).count() == known.count():
            return {}
        index = stay.unionByName(same)
        if changed:
            index = index.unionByName(_write(log, done.join(new.select("job_id"), "job_id", "left_semi"), new, files))
        return {"index": index}

    base = log.version()
    tables = change(lambda name: log.read(name, base))
    if tables or base == 0:
        log.commit(tables or {"index": log.spark.createDataFrame([], _INDEX)}, base)
    return changed


def document_index(log: SnapshotLog) -> DataFrame:
    """(job_id, file, offset, length, first, digest); a document over several files has a row for each, ordered by ``first``."""
    return log.read("index")


def read_document(log: SnapshotLog, job_id: str) -> str | None:
    """One document by its index rows: only its own bytes are read."""
    rows = document_index(log).where(F.col("job_id") == job_id).orderBy("first").collect()
    out = bytearray()
    for r in rows:
        stream = log.files.open(log.path(r["file"]))
        try:
            stream.seek(r["offset"])
            out += log._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r["length"])
        finally:
            stream.close()
    return out.decode() if rows else None


def read_documents(log: SnapshotLog) -> DataFrame:
    """(job_id, text) of all documents, cut from the files by the index; a file is one row and so at most ``FILE_BYTES`` or so.

    A file meets the list of its documents once: joined to each of them it would be copied for each of them.
    """
    files = log.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{log.root}/files")
    name = F.regexp_extract("path", r"(files/[^/]+/slot=\d+/[^/]+)$", 1)
    whole = files.select(name.alias("file"), "content")
    places = document_index(log).groupBy("file").agg(F.collect_list(F.struct("job_id", "first", "offset", "length")).alias("places"))

    def cut(content: Column, places: Column) -> Column:
        def piece(p: Column) -> Column:
            found = F.substr(content, (p["offset"] + 1).cast("int"), p["length"].cast("int"))
            return F.struct(p["job_id"].alias("job_id"), p["first"].alias("first"), F.decode(found, "UTF-8").alias("text"))

        return F.transform(places, piece)

    # ``let`` also keeps the bytes as one object; read from the row they would be copied for each piece.
    cuts = places.join(whole, "file").select(F.explode(let(F.col("content"), lambda c: cut(c, F.col("places")))).alias("p")).select("p.*")
    pieces = F.array_sort(F.collect_list(F.struct("first", "text")))
    return cuts.groupBy("job_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))
