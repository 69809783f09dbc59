"""Exact deduplication with two passes over Bloom cells.

Pass 1 counts, per Bloom cell, whether it was hit never, once or more often. Every task
reports the cells of its own distinct hashes (a cell at most twice), tasks meet per filter
segment, and a segment keeps one bit per cell: "hit at least twice". A hash is possibly
repeated when all its cells have that bit: no repeated hash is missed, and about one unique
hash in 400 is suspected.

Pass 2 tests each row against that filter. Only possibly repeated rows are written out and
grouped; all others pass straight through with a group of one.

The filter takes two bytes per row. Rows whose filter would pass ``filter_bytes`` are split
by hash range, written once, and each range is treated in turn with its own filter, so what
is broadcast stays below that limit at any size.

Hot groups: a task reports a cell twice at most, groups are aggregated on the map side, and
the settled join of rows with their groups can be split by AQE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from quire.llm.text import row
from quire.session import discard, settle

CELLS_PER_ROW = 16
CELLS = 4
SEGMENT_BITS = 20
FILTER_BYTES = 128 << 20


@F.pandas_udf(BinaryType())
def _digest(texts: pd.Series) -> pd.Series:
    # bytes.lower() changes A-Z only
    return texts.map(lambda t: hashlib.sha256(t.encode("utf-8", "replace").lower()).digest())


def text_digest(text) -> F.Column:
    """SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return _digest(F.coalesce(text.cast("string"), F.lit("")))


def _cells(digests: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its cells inside the segment; digests as rows of four 64-bit numbers."""
    segment = (digests[:, 0] >> np.uint64(32)) % np.uint64(segments)
    return segment.astype(np.int64), (digests[:, :CELLS] ^ (digests[:, :CELLS] >> np.uint64(43))) & np.uint64((1 << SEGMENT_BITS) - 1)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _filter(digests: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): one bit per cell, set when two different rows hit the cell."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distinct, counts = np.unique(_numbers(batch.column(0)), axis=0, return_counts=True)
            distinct = np.repeat(distinct, np.minimum(counts, 2), axis=0)
            segment, cells = _cells(distinct, segments)
            cells = np.sort(np.repeat(segment, CELLS) << SEGMENT_BITS | cells.ravel().astype(np.int64))
            third = np.zeros(len(cells), bool)
            third[2:] = cells[2:] == cells[:-2]
            cells = cells[~third]
            cuts = np.flatnonzero(np.diff(cells >> SEGMENT_BITS, prepend=-1))
            parts = np.split((cells & ((1 << SEGMENT_BITS) - 1)).astype("<u4"), cuts[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[cuts] >> SEGMENT_BITS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["segment", "hits"],
            )

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hits = np.frombuffer(b"".join(table.column("hits").to_pylist()), "<u4")
        bits = np.packbits(np.bincount(hits, minlength=1 << SEGMENT_BITS) > 1)
        return pa.table({"segment": [key[0].as_py()], "bits": pa.array([bits.tobytes()], pa.binary())})

    hits = digests.mapInArrow(report, "segment long, hits binary")
    return hits.groupBy("segment").applyInArrow(merge, "segment long, bits binary")


def _suspect(bits, segments: int):
    """Column function: may this hash occur twice?"""

    @F.pandas_udf(BooleanType())
    def suspect(digests: pd.Series) -> pd.Series:
        numbers = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
        segment, cells = _cells(numbers, segments)
        out = np.ones(len(numbers), bool)
        for s in np.unique(segment):
            at = np.flatnonzero(segment == s)
            table = np.frombuffer(bits.value.get(int(s), bytes((1 << SEGMENT_BITS) // 8)), np.uint8)
            c = cells[at].astype(np.int64)
            out[at] = (table[c >> 3] >> (7 - (c & 7)) & 1).all(axis=1)
        return pd.Series(out)

    return suspect


def mark_exact(
    docs: DataFrame, carry: list[str], text: str = "text", order: str = "doc_id", filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``row`` is a struct of the columns in ``carry``. Of rows with equal text (A-Z folded, null
    as empty) the one with the largest ``order`` stays; null is the lowest, and of rows equal in
    ``order`` too exactly one stays. No rows give no rows.
    """
    spark = docs.sparkSession
    hashed = docs.select(
        row(docs, carry).alias("row"), docs[f"`{order}`"].alias("ord"), text_digest(docs[f"`{text}`"]).alias("digest")
    )
    hashed = settle(hashed, "exact-hashes")
    segments = max(1, -(-docs.count() * CELLS_PER_ROW >> SEGMENT_BITS))
    per_range = max(1, (filter_bytes << 3) >> SEGMENT_BITS)
    ranges = -(-segments // per_range)
    if ranges > 1:
        of_range = F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("long") % ranges
        ranged = settle(hashed.withColumn("range", of_range), "exact-ranges", by="range")
        discard(hashed)
        segments = -(-segments // ranges)
    parts = []
    for k in range(ranges):
        part = ranged.where(F.col("range") == k).drop("range") if ranges > 1 else hashed  # a folder of its own
        bits = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in _filter(part.select("digest"), segments).collect()})
        done = _one_range(part.withColumn("suspect", _suspect(bits, segments)("digest")))
        if ranges > 1:  # then the filter of the range can go before that of the next comes
            done = settle(done, "exact-done")
            bits.unpersist()
        parts.append(done)
    return reduce(DataFrame.unionByName, parts)


def _one_range(part: DataFrame) -> DataFrame:
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = part.where(~F.col("suspect")).select(
        "row", F.col("ord").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    repeats = settle(
        part.where("suspect").drop("suspect").withColumn("rid", F.monotonically_increasing_id()), "exact-repeats"
    )
    groups = settle(
        repeats.groupBy("digest").agg(F.max(F.struct("ord", "rid")).alias("best"), F.count("*").alias("group_size")),
        "exact-groups",
    )
    joined = repeats.join(groups, "digest").select(
        "row", F.col("best.ord").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), sha
    )
    return alone.unionByName(joined)


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text repeats that of a kept row; same columns."""
    marked = mark_exact(docs, docs.columns, text, order)
    return marked.where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
