"""Token ids in a bit-plane file format.

The ids of all documents, in ascending document order and each document closed by an end id,
are one sequence, cut in shards (one per task) and in blocks of a fixed number of ids. A block
is transposed into byte planes (or bit planes), which puts the slowly changing high parts of
neighbouring ids together; each plane is compressed with zstandard. A file is a Parquet file
with one row per block. Its narrow columns are the chunk index: place of the block, sizes of
its planes, and the documents that have ids in it, so a reader finds any document or range
without touching other payloads, and Spark's commit protocol makes lost tasks harmless.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.text import POWERS, WHITE, per_text, slices, utf8, words

BLOCK_IDS = 1 << 16
LEVEL = 3
SHARD_BYTES = 48 << 20
TABLE_WORDS = 1_500_000
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("size", pa.int64())]))
_BLOCK = (
    "shard int, block int, first long, n int, plane_bytes array<int>, payload binary, "
    "docs array<struct<doc_id: long, first: long, size: long>>"
)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """4 byte planes (or 32 bit planes, highest first) of unsigned 32-bit ids."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [p.tobytes() for p in parts]
    return [np.packbits(parts[k] >> b & 1).tobytes() for k in (3, 2, 1, 0) for b in range(7, -1, -1)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((4, n), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            out[k] = np.frombuffer(p, np.uint8)
    else:
        for i, p in enumerate(planes):
            out[3 - i // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (7 - i % 8)
    return np.ascontiguousarray(out.T).view("<u4").ravel()


_PROBES = (
    "ab,", "Ab7!?", "x.", "a\u00e9;", "it's", "\u00c9a b,c", "W\u030a T\u0308.", "aY\u030ab,", "3.14, 2;", "A.B!c", "a,\u030a", "...", "x</w> y",
)
JOINED = 256
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in ".,!?;:"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def prepared(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with A-Z folded and a blank before the punctuation that ends a word, so that fewer words differ.

    A capital in front of a character beyond ASCII stays, as the two may be composed before the library
    folds them. Texts with the mark of a special token's name stay as they are.
    """
    n = len(data)
    if not n:
        return data, offsets
    open_ = np.ones(n, bool)
    marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    for t in np.unique(np.searchsorted(offsets, marks, side="right") - 1):
        open_[offsets[t] : offsets[t + 1]] = False
    beyond = np.zeros(n, bool)
    beyond[:-1] = data[1:] >= 128
    capital = (data >= 65) & (data <= 90) & ~beyond & open_
    data = data + (capital * np.uint8(32))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    marks = PUNCTUATION[data] & open_
    before, behind = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], behind[:-1] = marks[:-1], marks[1:]
    starts = np.flatnonzero(marks & (~before | first[:-1]))
    ends = np.flatnonzero(marks & (~behind | first[1:])) + 1
    closed = first[ends] | WHITE[data[np.minimum(ends, n - 1)]]
    at = starts[closed & ~first[starts] & _ALNUM[data[starts - 1]]]
    return np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)


class WordTable:
    """Ids of distinct words by the tokenizers library, found by their 64-bit hashes; bounded, and empty again when full.

    The tokenizer must be a word-end model: it drops white space, keeps letters and punctuation apart and
    marks the last piece of every run. So words of letters only go to the library many at a time, as one
    text that is cut behind each end mark.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def check(self) -> None:
        """Raise unless texts can be encoded word by word, folded, and with their trailing punctuation apart."""
        for text, whole in zip(_PROBES, self.plain(list(_PROBES))):
            if self.encode(pa.array([text]))[0].tolist() != whole:
                raise ValueError("this tokenizer is not a word-end model, so words cannot be encoded alone")

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        names = [w.decode() for w in words]
        parts: list = [None] * len(names)
        alone = []
        letters = [k for k, n in enumerate(names) if n.isalpha()]
        groups = [letters[k : k + JOINED] for k in range(0, len(letters), JOINED)]
        for group, ids in zip(groups, self.plain([" ".join([names[k] for k in group]) for group in groups])):
            ids = np.array(ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                for k, a, b in zip(group, [0, *ends.tolist()], ends.tolist()):
                    parts[k] = ids[a:b]
            else:
                alone += group
        alone += [k for k, n in enumerate(names) if not n.isalpha()]
        for k, ids in zip(alone, self.plain([names[k] for k in alone])):
            parts[k] = np.array(ids, np.int32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _add(self, at: np.ndarray, keys: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self._learn(words)
        first, self.used = self.used, self.used + len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[first : self.used] = ids
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, first + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, at, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        data, offsets = prepared(*utf8(texts))
        start, end, text, hashes = words(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(end - start > len(POWERS)):  # the hash repeats its weights from there on
            hashes[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        keys, first, row = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        new[inside] = self.keys[at[inside]] != keys[inside]
        if len(self.keys) + int(new.sum()) > self.limit:
            self._clear()
            at, new = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        if new.any():
            raw, of = data.tobytes(), first[new]
            self._add(at[new], keys[new], [raw[a:b] for a, b in zip(start[of].tolist(), end[of].tolist())])
        row = np.searchsorted(self.keys, keys)[row]
        size, begin = self.size[row], self.begin[row]
        ends = np.cumsum(size)
        flat = np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)
        return self.ids[flat], per_text(size, text, len(texts)).astype(np.int64)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", order: str = "doc_id",
    block: int = BLOCK_IDS, bits: bool = False,
) -> None:
    """Encode every whole text and write the id file to ``path`` (a new folder).

    The tokenizer must be a word-end model; then a text is encoded word by word, each distinct word
    once per task while the table of words lasts. Null and empty texts have the end id only. Null ids come first; equal ids follow one another, ordered by text hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        shard = TaskContext.get().partitionId()
        number, first, held, waiting = 0, 0, np.zeros(0, np.int64), []  # waiting: (doc_id, first, size) not yet closed

        def emit(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal number, first, waiting
            planes = [pack.compress(p) for p in to_planes(ids, bits)]
            last = first + len(ids)
            here = [d for d in waiting if d[1] < last]
            waiting = [d for d in waiting if d[1] + d[2] > last]
            columns = [
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                pa.array([len(ids)], pa.int32()), pa.array([list(map(len, planes))], pa.list_(pa.int32())),
                pa.array([b"".join(planes)], pa.binary()),
                pa.array([[dict(zip(("doc_id", "first", "size"), d)) for d in here]], _DOCS),
            ]
            number, first = number + 1, last
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "first", "n", "plane_bytes", "payload", "docs"])

        total = 0
        for part in slices(batches, "text"):
            ids, sizes = table.encode(part.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            closed = np.insert(ids.astype(np.int64), ends[1:], end_id)
            for doc_id, size in zip(part.column("doc_id").to_pylist(), np.diff(ends).tolist()):
                waiting.append((doc_id, total, size + 1))
                total += size + 1
            held = np.concatenate([held, closed])
            while len(held) >= block:
                yield emit(held[:block])
                held = held[block:]
        if len(held):
            yield emit(held)

    WordTable(tokenizer).check()
    chosen = docs.select(docs[f"`{order}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    size = chosen.select(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    ordered = chosen.repartitionByRange(int(size // SHARD_BYTES) + 1, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(path)


def _documents(blocks: DataFrame, whole: bool) -> DataFrame:
    """Rows of the blocks' documents: those that lie in one block, or the parts of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                first, last = r["first"], r["first"] + r["n"]
                chosen = [d for d in r["docs"] if (d["first"] >= first and d["first"] + d["size"] <= last) == whole]
                if not chosen:
                    continue
                cuts = np.cumsum([0, *r["plane_bytes"]])
                ids = from_planes([unpack.decompress(r["payload"][a:b]) for a, b in zip(cuts, cuts[1:])], r["n"])
                at = [(max(0, d["first"] - first), min(r["n"], d["first"] + d["size"] - first)) for d in chosen]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * len(chosen), pa.int32()), pa.array([d["first"] for d in chosen], pa.int64()),
                        pa.array([d["doc_id"] for d in chosen], pa.int64()), pa.array([first] * len(chosen), pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in at], pa.binary()),
                    ],
                    ["shard", "first", "doc_id", "place", "ids"],
                )

    return blocks.mapInArrow(run, "shard int, first long, doc_id long, place long, ids binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
        names = ["shard", "first", "doc_id"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(ids, pa.binary())], [*names, "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the file.

    ``ids`` holds little-endian unsigned 32-bit integers; ``start`` counts the ids of all documents before.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("ids"))  # one narrow row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    whole = _documents(blocks, True).drop("place")
    parts = (
        _documents(blocks, False).groupBy("shard", "first", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))
        .mapInArrow(_joined, "shard int, first long, doc_id long, ids binary")
    )
    return (
        whole.unionByName(parts).join(F.broadcast(base), "shard")  # by estimates alone all ids would be shuffled to meet it
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "ids")
    )


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read back."""
    return read.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
