"""Phrase collocations by SON partitioning.

The corpus is dealt to ``shards`` shards, each mined completely with a local support in proportion:
a phrase that the corpus holds ``least`` times must be found ``least / shards`` times, rounded up, in
at least one of them, however uneven they are. Mining goes level by level: words and pairs first,
then phrases of k words both of whose parts of k - 1 words are frequent in some shard. A shard is
spread over many tasks; tasks count keys (64-bit hashes with the language) in numpy and Spark sums
them by shard and key.

The union of what is frequent somewhere becomes a bit filter, the only thing that tasks are sent:
at most ``filter_bits`` bits at any size of the corpus. A last pass over the texts counts every phrase
that passes, by its words and not by a hash, so neither hash collisions nor a filter that lets too
much through can change a result; beyond about 20 million local phrases the filter only saves less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import joined, mix, slices, utf8, words
from quire.session import arrow_batches, settle

LEAST = 10
LONGEST = 3
TOP = 2000
SHARDS = 4
FILTER_BITS = 1 << 28
PART_BYTES = 2 << 20
HELD_KEYS = 3 << 20
BATCH_BYTES = 8 << 20
SALTS = 8
NO_LANG = "und"
_ROWS = 1 << 16
_BITMAP = 32768
_CELLS = 4
#: Fixed by the definition of pieces and words.
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, offsets, language of each text); a text of more than a few parts is cut between pieces."""
    for part in slices(batches, "text", PART_BYTES):
        data, offsets = utf8(part.column("text"))
        langs = part.column("lang").to_pylist()
        if part.num_rows > 1 or len(data) <= 2 * PART_BYTES:
            yield data, offsets, langs
            continue
        start = 0
        while start < len(data):
            end = min(len(data), start + PART_BYTES)
            while end < len(data) and not BREAKS[data[end - 1]]:
                step = np.flatnonzero(BREAKS[data[end : end + 65536]])
                end = end + int(step[0]) + 1 if len(step) else min(len(data), end + 65536)
            yield data[start:end], np.array([0, end - start]), langs
            start = end


class _Words:
    """The words of a part; ``keys(k)`` are the places and hashes of its phrases of k words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data, self.langs = data, langs
        self.start, self.end, self.text, self.hash = words(data, offsets, fold=True, white=GAPS)
        piece = np.cumsum(BREAKS[data], dtype=np.int64)[self.start]
        self.same = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        known = {name: int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little") for name in set(langs)}
        self.salt = np.array([known[name] for name in langs], np.uint64)[self.text]

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(self.start) - k + 1)
        whole = np.ones(n, bool)
        for j in range(k - 1):
            whole &= self.same[j : j + n]
        at = np.flatnonzero(whole)
        return at, mix(joined(self.hash, k)[at] + self.salt[at] + np.uint64(k))

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from the given words on, A-Z folded, with single blanks."""
        size = self.end - self.start
        place = np.cumsum(size + 1) - (size + 1)
        flat = np.full(int((size + 1).sum()), 0x20, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[inside + np.repeat(place, size)] = _LOWER[self.data[inside + np.repeat(self.start, size)]]
        last = first + k - 1
        length = place[last] + size[last] - place[first]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        chosen = flat[inside + np.repeat(place[first], length)]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chosen.tobytes()))


class _Filter:
    """Bits of the keys that may be frequent."""

    def __init__(self, bits: bytes):
        self.table = np.frombuffer(bits, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        low, step = keys & np.uint64(2**31 - 1), keys >> np.uint64(33) | np.uint64(1)
        for k in range(_CELLS):
            cell = (low + np.uint64(k) * step) & np.uint64(len(self.table) * 8 - 1)
            out &= (self.table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _filter(keys: DataFrame, most: int):
    """A broadcast filter of the settled ``keys``, of at least 12 bits a key but at most ``most`` bits."""
    count = keys.count()
    bits = min(most, max(1 << 18, 1 << (12 * count).bit_length()))
    key = F.col("key")
    low, step = key.bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned(key, 33).bitwiseOR(F.lit(1))
    cells = [(low + k * step).bitwiseAND(F.lit(bits - 1)) + 1 for k in range(_CELLS)]
    maps = (
        keys.select(F.explode(F.array(*cells)).alias("cell"))
        .groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    )
    table = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        at = (r["bucket"] - 1) * _BITMAP // 8
        table[at : at + _BITMAP // 8] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(bytes(table))


def _frequent(texts: DataFrame, lengths: tuple[int, ...], shorter, shards: int, support: int) -> DataFrame:
    """(key) of the phrases with ``lengths`` words that some shard holds ``support`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        passes = _Filter(shorter.value) if shorter else None
        held, count = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), _ROWS):
                part = keys[a : a + _ROWS].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part), pa.array(n[a : a + _ROWS])], ["shard", "key", "n"])

        for data, offsets, langs in _parts(batches):
            found = _Words(data, offsets, langs)
            for k in lengths:
                at, keys = found.keys(k)
                if passes:
                    before, parts = found.keys(k - 1)
                    good = np.zeros(len(found.start) + 1, bool)
                    good[before] = passes(parts)
                    keys = keys[good[at] & good[at + 1]]
                held.append(keys)
                count += len(keys)
            if count >= HELD_KEYS:
                yield from counted()
                held, count = [], 0
        if count:
            yield from counted()

    counts = texts.mapInArrow(run, "shard int, key long, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))
    return settle(counts.where(F.col("n") >= support).select("key"), "phrase-keys")


def _counted(texts: DataFrame, filters: dict) -> DataFrame:
    """(lang, phrase, n) by task, of all phrases that pass; a null phrase counts all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = {k: _Filter(f.value) for k, f in filters.items()}
        for data, offsets, langs in _parts(batches):
            found = _Words(data, offsets, langs)
            names = pa.array(langs, pa.string())
            total = np.bincount(found.text, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(langs), pa.string()), pa.array(total)], ["lang", "phrase", "n"])
            for k, good in passes.items():
                at, keys = found.keys(k)
                chosen = good(keys)
                keys, first, n = np.unique(keys[chosen], return_index=True, return_counts=True)
                if len(first):
                    first = at[chosen][first]
                    lang = names.take(pa.array(found.text[first]))
                    yield pa.RecordBatch.from_arrays([lang, found.phrases(first, k), pa.array(n)], ["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, phrase, n): how often each phrase of 1 to ``longest`` words that occurs ``least`` times or more occurs.

    Texts are A-Z folded, cut in pieces at ``.,;:!?`` and line ends, and in words at blanks and tabs; a
    phrase lies in one piece. The row with a null phrase has the number of all words of its language.
    A null language is ``und``; null and empty texts have no words; no rows give no rows.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _phrase_counts(docs, text, lang, least, longest, shards, filter_bits)


def _phrase_counts(docs: DataFrame, text: str, lang: str, least: int, longest: int, shards: int, filter_bits: int) -> DataFrame:
    texts = docs.select(
        F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"),
    )
    support = -(-least // shards)
    keys = _frequent(texts, (1, 2)[:longest], None, shards, support)
    filters = dict.fromkeys((1, 2)[:longest], _filter(keys, filter_bits))
    for k in range(3, longest + 1):
        filters[k] = _filter(_frequent(texts, (k,), filters[k - 1], shards, support), filter_bits)
    counts = _counted(texts, filters).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return settle(counts.where((F.col("n") >= least) | F.col("phrase").isNull() & (F.col("n") > 0)), "phrase-counts")


def _inside(n: int) -> Column:
    """The phrases of ``n`` words inside a longer one."""
    found = F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    return F.when(F.col("size") > n, found).otherwise(F.array().cast("array<string>"))


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two words or more of each language.

    A phrase with count a is cut after each of its words; a cut scores floor(10^6 a^2 / (l r)) with the counts
    of its two parts, and the lowest one counts (of equal ones that with the shorter first part). A phrase
    inside a longer candidate that has at least half its count is left out. Order: score, a, then phrase
    in byte order. ``how`` goes to ``phrase_counts``. Counts below 10^13 are exact.
    """
    counts = phrase_counts(docs, longest=longest, **how)
    size = F.size(F.split("phrase", " ")).alias("size")
    found = counts.where("phrase is not null").select("lang", "phrase", F.col("n").alias("a"), size)
    long = settle(found.where("size > 1").withColumn("words", F.split("phrase", " ")), "phrase-candidates")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = long.select("*", cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    score = F.expr(
        "(cast(1000000 as decimal(7,0)) * cast(a as decimal(13,0)) * cast(a as decimal(13,0))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))"
    )
    scored = (
        cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
        .withColumn("score", score).groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best"))
        .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    )
    inner = [_inside(n) for n in range(2, longest)]
    inside = long.select("lang", "a", F.explode(F.concat(*inner) if inner else F.array().cast("array<string>")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where("outer is null or 100 * outer < 50 * a").drop("outer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language of any size first keeps its best of each salt, so the last sort holds a bounded number of rows.
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("phrase is null").select("lang", "n")
    return left.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
