"""Quality rules with thresholds that adapt to each language and source.

A text is measured once (Arrow, numpy). The measures go into quantile sketches with
logarithmic buckets: a sketch is a table (language, source, measure, bucket) -> count, so
sketches merge by adding counts, in any order and with the same result, and a group's sketch
is never larger than its few hundred buckets. Each (language, source) gets an upper fence per
measure, ``q75 + spread * (q75 - q25)``; groups with few texts use the merged sketch of their
language, and small languages that of the whole table. The few fences are joined back to the
documents.

No fence has a fixed part. Most texts hold no symbol and no repeat, so plain shares would have
quartiles of zero; the sketched share counts one more event (a symbol, a repeated line, a pair of
repeated windows) than was found. Its quartiles tell how much a single event weighs in texts of
the group's sizes. A text is held to the fence by its plain share, so one without events passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import joined, mix, per_text, row, slices, utf8, words
from quire.session import settle

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Measures with an adaptive upper fence, and the number of words or lines that one event of the measure holds.
MEASURES = {"symbols_per_100_words": 1, "dup_lines_per_100_lines": 1, "chars_per_word": 0, "repeats_per_100_words": 2 * WINDOW}
_SHARES = {
    "symbols_per_100_words": ("n_symbols", "n_words"), "dup_lines_per_100_lines": ("n_dup_lines", "n_lines"),
    "repeats_per_100_words": ("n_repeat_words", "n_words"),
}
SPREAD = 6.0
MIN_GROUP = 50
#: Buckets grow by this factor, so a quantile is known to about 2 %.
GROWTH = 1.04
BASE = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeat_words(hashes: np.ndarray, text: np.ndarray, n: int, width: int = WINDOW) -> np.ndarray:
    """Per text: words covered by a window of ``width`` words that occurs twice or more in the same text."""
    if len(hashes) < width:
        return np.zeros(n, np.int64)
    windows = joined(hashes, width)
    whole = text[: len(windows)] == text[width - 1 :]
    key = mix(windows + text[: len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    _, inverse, counts = np.unique(key[at], return_inverse=True, return_counts=True)
    again = at[counts[inverse] > 1]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return per_text(None, text[np.cumsum(edge[:-1]) > 0], n)


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of a column of texts."""
    n = len(texts)
    data, offsets = utf8(texts)
    start, _, text, hashes = words(data, offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    wide = np.zeros(256, bool)
    wide[[9, 10, 11, 12, 13, 32]] = True
    wide[128:192] = True  # continuation bytes are no code points of their own
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    first = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line = np.unique(np.searchsorted(first, start, "right") - 1)  # lines with a word
    begin, end = first[line], np.append(first[1:], len(data))[line]
    end = end - (data[end - 1] == 10)
    view = data.tobytes()
    digests = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(begin, end))
    owner = np.searchsorted(offsets, begin, "right") - 1
    key = mix(np.frombuffer(digests, np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, one = np.unique(key, return_index=True)
    lines = per_text(None, owner, n)
    return {
        "n_words": per_text(None, text, n),
        "word_chars": count(~wide[data]),
        "n_symbols": count(symbol[data]),
        "n_lines": lines,
        "n_dup_lines": lines - per_text(None, owner[one], n),
        "n_repeat_words": repeat_words(hashes, text, n),
    }


def measured(docs: DataFrame, carry: list[str], text: str, lang: str, source: str) -> DataFrame:
    """(row, lang, source, base measures, one column per rule measure)."""
    chosen = docs.select(
        row(docs, carry).alias("row"), docs[f"`{lang}`"].alias("lang"), docs[f"`{source}`"].alias("source"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    keep = chosen.drop("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = measure_texts(part.column("text"))
            arrays = [part.column(c) for c in ("row", "lang", "source")] + [pa.array(v, pa.int64()) for v in found.values()]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "lang", "source", *found])

    base = chosen.mapInArrow(measure, f"{_ddl(keep)}, {BASE}")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(0.0)
    return base.withColumns(
        {
            "symbols_per_100_words": per("n_symbols", "n_words"),
            "dup_lines_per_100_lines": per("n_dup_lines", "n_lines"),
            "chars_per_word": per("word_chars", "n_words") / 100,
            "repeats_per_100_words": per("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
        }
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def bucket(value: Column) -> Column:
    """Sketch bucket of a measure: 0 for nothing, else its logarithm in steps of ``GROWTH``."""
    return F.when(value > 0, F.greatest(F.lit(1), F.ceil(F.log(value * 100) / float(np.log(GROWTH))) + 1)).otherwise(0)


def bucket_value(b: Column) -> Column:
    """Upper edge of a bucket."""
    return F.when(b > 0, F.pow(F.lit(GROWTH), b - 1) / 100).otherwise(0.0)


def sketched(measure: str) -> Column:
    """The value of a measure that goes into the sketches: a share with one event more, or the measure itself."""
    if measure not in _SHARES:
        return F.col(measure)
    part, whole = (F.col(c) + MEASURES[measure] for c in _SHARES[measure])
    return part * 100.0 / whole


def sketches(base: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, measure, bucket, n) of the texts that pass the base rules."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(sketched(m)).cast("long").alias("bucket")) for m in MEASURES])
    return (
        base.where(~F.col("base_failed"))
        .select("lang", "source", F.inline(entries))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, spread: float = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, one upper fence per measure) from merged sketches; small groups use a wider sketch."""
    wide = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    all_of = wide.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def limits(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
        by = Window.partitionBy(*keys, "measure")
        counts = counts.withColumns(
            {"seen": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)}
        )
        at = lambda q: F.min(F.when(F.col("seen") >= F.col("total") * q, F.col("bucket")))
        # From edge to edge: equal quartiles are one bucket apart, the least that a sketch can tell.
        low, high = bucket_value(F.greatest(at(0.25) - 1, F.lit(0))), bucket_value(at(0.75))
        return (
            counts.groupBy(*keys, "measure").agg(low.alias("low"), high.alias("high"), F.max("total").alias(f"{name}_n"))
            .withColumn(name, F.col("high") + F.lit(spread) * (F.col("high") - F.col("low")))
            .drop("low", "high")
        )

    own, lang, whole = limits(sketch, ["lang", "source"], "own"), limits(wide, ["lang"], "wide"), limits(all_of, [], "whole")
    lang = lang.withColumnsRenamed({"lang": "l_lang", "measure": "l_measure"})
    joined_up = (
        own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["measure"] == lang["l_measure"]), "left")
        .join(whole, "measure", "left")
        .withColumn(
            "fence",
            F.when(F.col("own_n") >= min_group, F.col("own")).when(F.col("wide_n") >= min_group, F.col("wide")).otherwise(F.col("whole")),
        )
    )
    return joined_up.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES]
    )


def apply_rules(
    docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source",
    spread: float = SPREAD, min_group: int = MIN_GROUP,
) -> DataFrame:
    """(row, base measures, rule measures, fences, base_failed, kept) for every row of ``docs``.

    Null and empty texts have no words and fail the base rules. Null languages and sources
    are groups like any other. A group without any text that passes the base rules has no
    fences, and none of its texts is kept anyway. Rows that repeat get equal results.
    """
    base = settle(measured(docs, carry, text, lang, source), "rule-measures")
    limits = settle(fences(settle(sketches(base), "rule-sketches"), spread, min_group), "rule-fences")
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    inside = reduce(lambda a, b: a & b, [F.col(m) <= F.col(f"max_{m}") for m in MEASURES])
    match = base["lang"].eqNullSafe(limits["f_lang"]) & base["source"].eqNullSafe(limits["f_source"])
    return (
        base.join(limits, match, "left").drop("f_lang", "f_source")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    )
