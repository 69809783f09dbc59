"""Inputs of the registered queries, derived from the driver tables with DataFrame code.

Every derivation covers its whole source table; the SQL twins are in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.core import strip
from quire.functions.text import escape_html, inline_html, paragraph_blocks
from quire.operators.extract import text_nodes
from quire.operators.segment import segment_documents
from quire.operators.state import segment_counts
from quire.session import settle, spread

STATE_TARGET = 200
JOB_STATUSES = ("PENDING", "PROCESSING", "PAUSED", "COMPLETED", "FAILED")
FILE_TYPE_CYCLE = ("epub", "pdf", "docx", "md", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text documents with one paragraph per line of the source."""
    return documents(spark, sf_dir).withColumns(
        {"text": F.replace("text", F.lit("\n"), F.lit("\n\n")), "file_type": F.lit("txt")}
    )


def line_nodes(text: Column = None) -> Column:
    """Node HTML array of a ``line_docs`` row."""
    text = F.col("text") if text is None else text
    return F.transform(paragraph_blocks(text), lambda b: F.concat(F.lit("<p>"), inline_html(b), F.lit("</p>")))


def line_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_docs(spark, sf_dir).select("doc_id", F.posexplode(line_nodes()).alias("node_idx", "html"))


def cycle(key: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents: the lines of the source dressed as headings, lists, quotes, code and fences."""
    d = F.col("doc_id")

    def dress(line: Column, i: Column) -> Column:
        chapter = lambda n: F.concat(F.lit("CHAPTER "), n.cast("string"), F.lit(": "), line)
        fence = (
            F.when(i % 13 == 0, F.concat(F.lit("```\n"), chapter(i), F.lit("\n"), chapter(i + 1), F.lit("\n```")))
            .when(i % 6 == 0, F.concat(F.lit("```text\n"), line, F.lit("\n```")))
            .otherwise(F.concat(F.lit("```\n"), line, F.lit("\n```")))
        )
        prose = (
            F.when(i % 11 == 0, F.concat(F.lit("# "), line))
            .when(i % 5 == 0, F.concat(F.lit("- "), line))
            .when(i % 7 == 0, F.concat(F.lit("> "), line))
            .when(i % 3 == 0, F.concat(F.lit("`"), line, F.lit("`")))
            .otherwise(line)
        )
        return F.when(d % 4 == 0, fence).otherwise(prose)

    # Not ``F.trim`` itself: ``transform`` hands a function of two parameters the index as the characters to trim.
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return documents(spark, sf_dir).select(
        "doc_id", "lang", "source", F.array_join(F.transform(lines, dress), "\n\n").alias("text"),
        F.lit("md").alias("file_type"),
    )


def md_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_nodes(md_docs(spark, sf_dir), ["doc_id"])


def segments(spark: SparkSession, sf_dir: str, target: int = STATE_TARGET) -> DataFrame:
    return segment_documents(line_docs(spark, sf_dir), ["doc_id", "lang"], line_nodes(), target)


def whole_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>")).alias("html")
    )


def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment snapshot: one job per document, a deterministic mix of statuses."""
    s = (F.col("doc_id") * 7 + F.col("chunk_index") * 3) % 10
    status = (
        F.when(s == 0, "FAILED").when(s == 1, "PROCESSING").when(s.isin(2, 3), "PENDING").otherwise("DONE")
    )
    return segments(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("job_id"),
        "chunk_index",
        F.col("text").alias("original_text"),
        F.when(status == "DONE", F.replace("text", F.lit("the"), F.lit("le"))).alias("translated_text"),
        status.alias("status"),
        F.when(s == 0, F.lit("timeout")).alias("error_message"),
        "node_indices",
        "tokens_est",
        minute(F.col("doc_id")).alias("updated_at"),
    )


def minute(n: Column) -> Column:
    """2024-01-01 plus n minutes, without a time zone."""
    return F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=n.cast("int"))


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, segments) over one stored segment snapshot, for queries that read it several times."""
    segs = settle(state_segments(spark, sf_dir), "segments")
    return state_jobs(spark, sf_dir, segs), segs


def state_jobs(spark: SparkSession, sf_dir: str, segs: DataFrame | None = None) -> DataFrame:
    """Job snapshot with counts taken from the segment snapshot."""
    counts = segment_counts(state_segments(spark, sf_dir) if segs is None else segs)
    d = F.col("doc_id")
    file_type = cycle(d, FILE_TYPE_CYCLE)
    name = F.concat(F.lit("doc_"), d.cast("string"), F.lit("."), file_type)
    base = documents(spark, sf_dir).select(
        d.cast("string").alias("job_id"),
        name.alias("file_name"),
        file_type.alias("file_type"),
        F.col("lang").alias("source_lang"),
        F.when(F.col("lang") == "fr", "en").otherwise("fr").alias("target_lang"),
        F.when(d % 3 == 0, "gemma-base").otherwise("base").alias("model"),
        cycle(d, JOB_STATUSES).alias("status"),
        F.col("source").alias("glossary_name"),
        F.lit(0.15).alias("temperature"),
        (d % 4 + 1).cast("int").alias("concurrency"),
        F.lit(STATE_TARGET).alias("chunk_size"),
        F.when(d % 10 == 3, "proofreading").otherwise("translation").alias("job_type"),
        F.concat(F.lit("shared/"), (d % 50).cast("string")).alias("source_path"),
        F.concat(F.lit("out/"), name).alias("output_path"),
        F.when(d % 2 == 0, "lm-studio").otherwise("openai").alias("api_type"),
        minute(d).alias("created_at"),
        F.when(d % 5 == 3, minute(d + 30)).alias("completed_at"),
    )
    return base.join(counts, "job_id", "left").withColumns(
        {
            "total_chunks": F.coalesce("total_chunks", F.lit(0)),
            "completed_chunks": F.coalesce("completed_chunks", F.lit(0)),
        }
    )
