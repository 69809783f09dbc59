"""Registered queries: intake, glossary files, snapshots and published documents."""

from __future__ import annotations

import html
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import rebuild as R
from quire.operators import extract as X
from quire.plans import sql as Q
from quire.plans import tables as tb
from quire.plans import text_queries as tq
from quire.session import checkpoint_root, settle
from quire.sources import files as A
from quire.sources import library as D
from quire.sources import store as S
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


def scratch(spark, label):
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


SUFFIXES = (".epub", ".PDF", ".docx", ".md", ".txt", ".exe", "")
_PATH_SQL = "'/in/v1.2/doc_' || doc_id || (['.epub', '.PDF', '.docx', '.md', '.txt', '.exe', ''])[CAST(doc_id % 7 AS INTEGER) + 1]"
_TYPE_SQL = "(['epub', 'pdf', 'docx', 'md', 'txt', 'exe', ''])[CAST(doc_id % 7 AS INTEGER) + 1]"


def uploads(spark, sf):
    """Every document as an upload: a mixed set of suffixes and contents, some of them not what they claim."""
    d = F.col("doc_id")
    body = F.col("text").cast("binary")
    content = (
        F.when(d % 11 == 0, F.concat(F.lit(b"PK\x03\x04"), body))
        .when(d % 11 == 1, F.concat(F.lit(b"%PDF-1.7\n"), body))
        .when(d % 11 == 2, F.concat(body, F.lit(b"\x00")))
        .when(d % 11 == 3, F.concat(body, F.lit(b"\xff")))
        .otherwise(body)
    )
    return tb.documents(spark, sf).select(
        "doc_id", F.concat(F.lit("/in/v1.2/doc_"), d.cast("string"), tb.cycle(d, SUFFIXES)).alias("path"),
        content.alias("content"),
    ).withColumn("length", F.octet_length("content"))


@register("format_gate", f"SELECT doc_id, {_TYPE_SQL} AS file_type, doc_id % 7 < 5 AS accepted FROM documents")
def format_gate(spark, sf):
    return A.format_gate(uploads(spark, sf)).select("doc_id", "file_type", "accepted")


@register(
    "decode_text",
    """SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(65533) || '(' WHEN doc_id % 5 = 1 THEN chr(65533) ELSE '' END AS text FROM documents""",
)
def decode_text(spark, sf):
    d = F.col("doc_id")
    newline = F.when(d % 3 == 0, "\r\n").when(d % 3 == 1, "\r").otherwise("\n")
    tail = F.when(d % 5 == 0, F.lit(b"\xe2(")).when(d % 5 == 1, F.lit(b"\xf0\x9f\x98")).otherwise(F.lit(b""))
    raw = F.concat(F.replace("text", F.lit("\n"), newline).cast("binary"), tail)
    return tb.documents(spark, sf).select("doc_id", A.decode_text(raw).alias("text"))


@register(
    "sniff_content",
    f"""SELECT doc_id, reason IS NULL AS ok, reason FROM (SELECT doc_id, CASE WHEN doc_id % 7 >= 5 THEN 'unsupported format'
      WHEN doc_id % 7 IN (0, 2) THEN CASE WHEN doc_id % 11 <> 0 THEN 'not an archive' END WHEN doc_id % 7 = 1 THEN CASE WHEN doc_id % 11 <> 1 THEN 'not a PDF' END
      WHEN doc_id % 11 = 2 THEN 'binary data' WHEN doc_id % 11 = 3 THEN 'not UTF-8' END AS reason FROM documents)""",
)
def sniff_content(spark, sf):
    return A.sniff_content(A.format_gate(uploads(spark, sf))).select("doc_id", "ok", "reason")


@register("size_gate", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) <= 5000")
def size_gate(spark, sf):
    rows = tb.documents(spark, sf).select("doc_id", F.octet_length("text").alias("length"))
    return A.size_gate(rows, "length", 5000).select("doc_id", F.col("length").alias("bytes"))


def _zip(doc_id: int, text: str | None) -> bytes:
    """One small archive per document; the number of the document chooses its defect.

    The text itself is never one: it is character data (no declaration in it) and stored as it is (any ratio is 1).
    """
    text = html.escape(text or "").replace("[", "&#91;")
    out = io.BytesIO()
    case = doc_id % 9
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        mime = "application/zip" if case == 1 else "application/epub+zip"
        z.writestr("mimetype", mime, zipfile.ZIP_STORED)
        if doc_id % 2:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml" if case != 1 else "word/other.xml", f"<w>{text}</w>", zipfile.ZIP_STORED)
        if case == 2:
            z.writestr("../escape.txt", "x")
        if case == 3:
            link = zipfile.ZipInfo("link")
            link.external_attr = 0o120777 << 16
            z.writestr(link, "target")
        if case == 4:
            z.writestr("zeros.bin", b"\0" * 2_000_000)
        if case == 5:
            z.writestr("a.opf", '<!DOCTYPE p [<!ENTITY x "y">]><p/>')
        if case == 6:
            z.writestr("same.txt", "1")
            z.writestr("same2.txt", "1")
        z.writestr("chapter.xhtml", "<!DOCTYPE html><p>the currency system was</p>" + text, zipfile.ZIP_STORED)
    data = out.getvalue()
    if case == 6:
        data = data.replace(b"same2.txt", b"same.txt\0")
    return data[:-30] if case == 7 else data


def archives(spark, sf):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "path": pdf["doc_id"].astype(str),
                    "file_type": ["docx" if d % 2 else "epub" for d in pdf["doc_id"]],
                    "content": [_zip(int(d), t) for d, t in zip(pdf["doc_id"], pdf["text"])],
                }
            )

    return tb.documents(spark, sf).select("doc_id", "text").mapInPandas(build, "path string, file_type string, content binary")


@register(
    "archive_audit",
    """SELECT CAST(doc_id AS VARCHAR) AS archive, CASE WHEN doc_id % 2 = 1 THEN 'docx' ELSE 'epub' END AS file_type,
      CASE doc_id % 9 WHEN 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'not a DOCX' ELSE 'not an EPUB' END WHEN 2 THEN 'dangerous path' WHEN 3 THEN 'symbolic link'
        WHEN 4 THEN 'compression ratio' WHEN 5 THEN 'entity declaration' WHEN 6 THEN 'duplicate entry' WHEN 7 THEN 'not a readable archive' END AS reason FROM documents""",
)
def archive_audit(spark, sf):
    return A.archive_audit(A.archive_entries(archives(spark, sf))).select("archive", "file_type", "reason")


@register("read_glossary", f"WITH {tq._PARSED} SELECT glossary, CAST(pos - 2 AS INTEGER) AS pos, source, target, category, note, 'about ' || glossary AS description FROM parsed")
def read_glossary(spark, sf):
    path = scratch(spark, "glossaries")
    S.write_glossary(described(spark, sf), path)
    return S.read_glossary(spark, path, multi_line=False)


def described(spark, sf):
    return tq.parsed(spark, sf).withColumn("description", F.concat(F.lit("about "), "glossary"))


@register(
    "write_glossary",
    f"WITH {tq._PARSED} SELECT glossary AS name, count(*) AS items, sum(length(source) + length(target) + length(note)) AS chars, 'about ' || glossary AS description FROM parsed GROUP BY glossary",
)
def write_glossary(spark, sf):
    path = scratch(spark, "glossaries")
    S.write_glossary(described(spark, sf), path)
    docs = spark.read.schema(S.GLOSSARY_SCHEMA).json(path)
    chars = F.aggregate(
        "items", F.lit(0).cast("long"),
        lambda a, i: a + F.length(i["source"]) + F.length(i["target"]) + F.length(i["note"]),
    )
    return docs.select("name", F.size("items").alias("items"), chars.alias("chars"), "description")


@register(
    "read_state",
    Q.STATE
    + """ SELECT job_id, chunk_index, original_text, translated_text, status, tokens_est, CASE WHEN doc_id % 8 = 0 THEN '' ELSE node_list END AS node_list FROM segments""",
)
def read_state(spark, sf):
    root = scratch(spark, "state")
    broken = F.when(F.col("job_id").cast("long") % 8 == 0, F.lit("[1, oops")).otherwise(F.to_json("node_indices"))
    stored = tb.state_segments(spark, sf).withColumn("node_indices_json", broken).drop("node_indices")
    S.write_state(stored, root, "segments", 1)
    back = S.read_state(spark, root, "segments", 1)
    return back.select(
        "job_id", "chunk_index", "original_text", "translated_text", "status", "tokens_est",
        F.array_join(F.col("node_indices").cast("array<string>"), ",").alias("node_list"),
    )


def _published(spark, sf):
    docs = tb.line_docs(spark, sf)
    nodes = X.text_nodes(docs, ["doc_id", "file_type"])
    parts = R.assemble_text(R.render_text(nodes)).withColumnRenamed("doc_id", "job_id")
    incomplete = tb.documents(spark, sf).where("lang = 'de'").select(F.col("doc_id").alias("job_id"))
    return parts, incomplete


@register(
    "write_document",
    f"""WITH {Q.LINES} SELECT doc_id AS job_id, string_agg(block, chr(10) || chr(10) ORDER BY node_idx) || chr(10) AS text FROM lines WHERE lang <> 'de' GROUP BY doc_id""",
)
def write_document(spark, sf):
    path = scratch(spark, "documents")
    S.write_document(*_published(spark, sf), path)
    return S.read_written(spark, path, kind="long")


@register(
    "publish_documents",
    f"""WITH {Q.LINES} SELECT CAST(doc_id AS VARCHAR) AS job_id, string_agg(block, chr(10) || chr(10) ORDER BY node_idx) || chr(10) AS text, TRUE AS few_files, 0 AS changed_again
      FROM lines WHERE lang <> 'de' GROUP BY doc_id""",
)
def publish_documents(spark, sf):
    """Half of the documents first, then all, then all again; partial jobs stay out and the last call writes nothing."""
    log = SnapshotLog(spark, scratch(spark, "library"))
    parts, incomplete = _published(spark, sf)
    parts = settle(parts, "parts")
    D.publish_documents(log, parts.where("job_id % 2 = 0"), incomplete)
    D.publish_documents(log, parts, incomplete)
    again = D.publish_documents(log, parts, incomplete)
    files = D.document_index(log).agg(F.count_distinct("file")).first()[0]
    return D.read_documents(log).withColumns({"few_files": F.lit(files <= 2 * D.FILES), "changed_again": F.lit(again)})
