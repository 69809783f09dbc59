"""The training-data pipeline over ``documents``: classify, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and calls one operator; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import pieces
from quire.llm.exact_dedup import exact_dedup
from quire.llm.mixing import mixed_documents
from quire.llm.near_dedup import near_dedup
from quire.llm.quality_model import keep_good
from quire.session import clear_scratch, settle, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents come whole, in part or up to three times."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of their decoding."""
    coded = pieces.encode(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    sums = pieces.digests(coded, ["ids"])
    return sums.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


_LEFT: list[str] = []
#: Long texts fill Arrow batches quickly; small ones keep the memory of all Python workers low from the first stage on.
BATCH_BYTES = 4 << 20


def _tidy(stage):
    """A stage that first deletes the scratch tables of the one before, whose result has been written and read again."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        clear_scratch(spark, _LEFT)
        before = set(written())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [p for p in written() if p not in before]
        return out

    return run_stage


STAGES = [
    ("quality classifier", _tidy(quality)),
    ("exact dedup", _tidy(exact)),
    ("MinHash near-dedup", _tidy(near)),
    ("mixing sources to target weights", _tidy(mix)),
    ("SentencePiece encoding and decoding", _tidy(encode)),
]

#: Learned scores, signatures and tokenisation cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs, f"pipeline-{number}")
    return docs
