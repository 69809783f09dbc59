"""Schemas of the state tables and of the progress events."""

from __future__ import annotations

from pyspark.sql import types as T

JOBS = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("source_lang", T.StringType()),
        T.StructField("target_lang", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("completed_chunks", T.IntegerType()),
        T.StructField("glossary_name", T.StringType()),
        T.StructField("system_prompt", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("concurrency", T.IntegerType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("job_type", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("parser_version", T.IntegerType()),
        T.StructField("api_type", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("enable_proofreading", T.BooleanType()),
        T.StructField("enable_prompt_caching", T.BooleanType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("external_ref", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
    ]
)

# Values of columns that an older snapshot may lack.
JOB_DEFAULTS = {
    "temperature": 0.15,
    "concurrency": 1,
    "chunk_size": 1000,
    "job_type": "translation",
    "parser_version": 5,
    "api_type": "openai",
    "enable_proofreading": False,
    "enable_prompt_caching": False,
}

SEGMENTS = T.StructType(
    [
        T.StructField("job_id", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("original_text", T.StringType()),
        T.StructField("translated_text", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("node_indices", T.ArrayType(T.IntegerType())),
        T.StructField("tokens_est", T.IntegerType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

CLIENTS = T.StructType(
    [
        T.StructField("client_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("token_hash", T.StringType()),
        T.StructField("token_prefix", T.StringType()),
        T.StructField("default_provider", T.StringType()),
        T.StructField("default_model", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("last_used_at", T.TimestampNTZType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("completed_chunks", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("translated_text", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
