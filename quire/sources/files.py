"""File intake: format gate, decoding, content sniffing, size gate and archive audit.

Inputs are rows of ``spark.read.format("binaryFile")`` (path, length, content) or any
table with the same columns. All gates are narrow column rules; only the directory of
a ZIP archive is listed by a small Python step.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.params import (
    FILE_TYPES, MAX_ARCHIVE_BYTES, MAX_ARCHIVE_ENTRIES, MAX_COMPRESSION_RATIO, MAX_UPLOAD_BYTES,
)

# Signatures and archive rules.
ZIP_MAGIC, PDF_MAGIC = b"PK", b"%PDF-"
EPUB_MIME = b"application/epub+zip"
DOCX_MEMBERS = ("[Content_Types].xml", "word/document.xml")
MARKUP_SUFFIXES = (".xml", ".xhtml", ".html", ".opf", ".ncx")
PREFIX_BYTES = 8192
ENTRY_SCHEMA = (
    "archive string, file_type string, readable boolean, entry string, size bigint, compressed bigint, "
    "flag_bits int, external_attr bigint, declares boolean, is_mime boolean"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_type_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def format_gate(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``file_type`` and ``accepted`` by file name suffix."""
    typed = files.withColumn("file_type", file_type_of(F.col(path)))
    return typed.withColumn("accepted", F.coalesce(F.col("file_type").isin(*FILE_TYPES), F.lit(False)))


def decode_text(content: Column) -> Column:
    """Bytes -> text: UTF-8 with U+FFFD for invalid sequences, universal newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def sniff_content(files: DataFrame, content: str = "content", file_type: str = "file_type") -> DataFrame:
    """Add ``ok, reason``: does the content match the declared type? The whole value is validated."""
    c, kind = F.col(content), F.col(file_type)

    def starts(magic: bytes) -> Column:
        return F.substring(c, 1, len(magic)) == F.lit(magic)

    reason = (
        F.when(~F.coalesce(kind.isin(*FILE_TYPES), F.lit(False)), "unsupported format")
        .when(c.isNull(), "no content")
        .when(kind.isin("epub", "docx"), F.when(~starts(ZIP_MAGIC), "not an archive"))
        .when(kind == "pdf", F.when(~starts(PDF_MAGIC), "not a PDF"))
        .when(F.contains(c, F.lit(b"\x00")), "binary data")
        .when(~F.is_valid_utf8(c.cast("string")), "not UTF-8")
    )
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def size_gate(files: DataFrame, length: str = "length", max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Keep files up to ``max_bytes``; on ``binaryFile`` the filter reaches the scan, content is never read."""
    return files.where(F.col(length) <= max_bytes)


def _list_archive(name: str, file_type: str, content: bytes, prefix_bytes: int) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            rows = []
            for e in archive.infolist():
                markup = e.filename.lower().endswith(MARKUP_SUFFIXES) and e.file_size and not e.flag_bits & 1
                head = archive.open(e).read(prefix_bytes).upper() if markup else b""
                declares = b"<!ENTITY" in head or (b"<!DOCTYPE" in head and b"[" in head)
                mime = e.filename == "mimetype" and not e.flag_bits & 1 and archive.open(e).read(40) == EPUB_MIME
                rows.append((name, file_type, True, e.filename, e.file_size, e.compress_size, e.flag_bits,
                             e.external_attr, declares, mime))
            return rows or [(name, file_type, True) + (None,) * 7]
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError):
        return [(name, file_type, False) + (None,) * 7]


def archive_entries(files: DataFrame, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """ZIP directories as rows (archive = path); an unreadable archive, NULL content included, keeps one row.

    Entity declarations are sought in the first ``prefix_bytes`` of each markup member. Archives
    reach Python in batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows: with large
    archives set it low, as ``build_session(arrow_rows=...)`` does.
    """
    names = [f.split()[0] for f in ENTRY_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, kind, content in zip(pdf["path"], pdf["file_type"], pdf["content"]):
                yield pd.DataFrame(_list_archive(path, kind, content or b"", prefix_bytes), columns=names).astype(
                    {"size": "Int64", "compressed": "Int64", "flag_bits": "Int32", "external_attr": "Int64"}
                )

    return files.select("path", "file_type", "content").mapInPandas(run, ENTRY_SCHEMA)


def archive_audit(
    entries: DataFrame,
    max_entries: int = MAX_ARCHIVE_ENTRIES,
    max_bytes: int = MAX_ARCHIVE_BYTES,
    max_ratio: int = MAX_COMPRESSION_RATIO,
) -> DataFrame:
    """Entry rows -> one verdict per archive; ``reason`` is the first violated rule, NULL when clean.

    Only aggregates meet per archive (partial aggregation), never a list of entries.
    """
    name = F.replace("entry", F.lit("\\"), F.lit("/"))
    has = lambda member: F.coalesce(F.bool_or(name == member), F.lit(False))
    facts = entries.groupBy("archive", "file_type").agg(
        F.bool_and("readable").alias("readable"),
        F.count("entry").alias("entries"),
        F.bool_or(F.startswith(name, F.lit("/")) | F.rlike(name, F.lit(r"(^|/)\.\.(/|$)"))).alias("bad_path"),
        F.bool_or(F.col("flag_bits").bitwiseAND(1) == 1).alias("encrypted"),
        F.bool_or(F.shiftright(F.col("external_attr"), 16).bitwiseAND(0o170000) == 0o120000).alias("link"),
        F.bool_or((F.col("compressed") > 0) & (F.col("size") / F.col("compressed") > max_ratio)).alias("bomb"),
        F.bool_or("declares").alias("declares"),
        F.count_distinct(name).alias("names"),
        F.sum("size").alias("total"),
        F.bool_or("is_mime").alias("mime"),
        *[has(m).alias(f"has_{i}") for i, m in enumerate(DOCX_MEMBERS)],
    )
    missing = (F.col("file_type") == "docx") & ~(F.col("has_0") & F.col("has_1"))
    reason = (
        F.when(~F.col("readable"), "not a readable archive")
        .when(F.col("entries") > max_entries, "too many entries")
        .when(F.col("bad_path"), "dangerous path")
        .when(F.col("encrypted"), "encrypted entry")
        .when(F.col("link"), "symbolic link")
        .when(F.col("bomb"), "compression ratio")
        .when(F.col("declares"), "entity declaration")
        .when(F.col("names") != F.col("entries"), "duplicate entry")
        .when(F.col("total") > max_bytes, "uncompressed size")
        .when((F.col("file_type") == "epub") & ~F.coalesce("mime", F.lit(False)), "not an EPUB")
        .when(missing, "not a DOCX")
    )
    return facts.select(
        "archive", "file_type", "entries", F.coalesce("total", F.lit(0)).alias("total_size"), reason.alias("reason")
    )
