"""Mixing sources to target weights, in blocks of words.

The words of a source, documents in order, form one stream that is packed in blocks of
``block`` words. The mix is a sequence of slots, one block each, cut in output shards. How
many slots of a shard each source gets is a multinomial draw under the condition that the
source's slots of all shards make up its target: the draw goes down a binary tree over the
shards, at every node splitting the counts by a multivariate hypergeometric draw seeded with
the node's place, so every shard finds its counts and its first slot of each source alone,
without any other shard. A source's k-th slot takes block ``permutation(epoch)(k mod blocks)``:
a keyed pseudorandom permutation per source and pass, so each pass uses every block once.
Slots and blocks meet in an ordinary join by (source, block).

Only the table of sources (one row each) is on the driver. A hot source is many blocks, so it
is spread over all tasks. Reruns give the same mix: documents are ordered by id and text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.prefix import running_sum
from quire.llm.text import mix, row, word_count
from quire.session import settle

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
MAX_PASSES = 3
SHARD_SLOTS = 4096
SEED = 17


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> list[float]:
    """Words per source: shares of all words by repeating weights; none above ``passes`` times its size."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > passes * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        left = float(sum(sizes)) - sum(out[i] for i in set(range(len(sizes))) - open_ | set(over))
        open_ -= set(over)
    return out


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed pseudorandom permutation of 0..n-1: a Feistel network, walked until inside the range."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _split(counts: np.ndarray, share: int, node: tuple[int, int], seed: int) -> np.ndarray:
    """Counts of ``share`` slots drawn without replacement out of a node's slots: exact at any size.

    Every slot is drawn on its own with the chance ``share / total``, a binomial count per source. Given how
    many came out, they are a uniform choice of that many slots, and stay one when the few too many are put back
    or the few missing ones are added by a draw of the same kind. Each draw is short by about the root of the last.
    """
    rng = np.random.Generator(np.random.Philox(key=_key(seed, *node)))
    taken, pool, wanted, sign = np.zeros_like(counts), counts, share, 1
    while wanted:
        drawn = rng.binomial(pool, wanted / int(pool.sum()))
        taken = taken + sign * drawn
        off = wanted - int(drawn.sum())
        # Too few: more out of the rest of the pool. Too many: back out of those just drawn.
        pool, sign = (pool - drawn, sign) if off > 0 else (drawn, -sign)
        wanted = abs(off)
    return taken


def shard_counts(counts: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in all shards before it)."""
    before, low, high = np.zeros_like(counts), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        first = _split(counts, min(int(counts.sum()), (middle - low) * size), (low, high), seed)
        if shard < middle:
            counts, high = first, middle
        else:
            before, counts, low = before + first, counts - first, middle
    return counts, before


def mix_plan(
    docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", order: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots, sources) of the mix.

    documents: row, rid, source, size, s (number of the source, null last). pieces: rid, s, block,
    from_word, n_words (a document's share of a block). slots: shard, slot, s, pass, block, the mix
    itself. sources: s, source, source_size, target. Null and empty texts have size 0 and are in no
    block; if no document has a word there are no slots.
    """
    spark = docs.sparkSession
    at = docs[f"`{text}`"].cast("string")
    sized = docs.select(
        row(docs, carry).alias("row"), docs[f"`{source}`"].cast("string").alias("source"), word_count(at).alias("size"),
        docs[f"`{order}`"].alias("ord"), F.xxhash64(at).alias("tie"),
    )
    sized = settle(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-documents")
    # The number of sources is small by nature: weights are given per source.
    found = [(r["source"], r["size"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda f: (f[0] is None, f[0] or ""))
    sizes = [n for _, n in found]
    goal = targets(sizes, weights)
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    slots = np.array([round(g * b / n) if n else 0 for g, b, n in zip(goal, blocks, sizes)], np.int64)
    sources = spark.createDataFrame(
        [(i, s, n, g) for i, ((s, n), g) in enumerate(zip(found, goal))],
        "s int, source string, source_size long, target double",
    )
    named = sized.join(
        F.broadcast(sources.select("s", F.col("source").alias("of"))), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of")
    ranked = _ranked(named)
    ended = running_sum(ranked, ["s"], "place", F.col("size"), "end_word")
    first, last = F.col("end_word") - F.col("size"), F.col("end_word") - 1
    touched = F.sequence(F.floor(first / block), F.floor(last / block))
    begin = F.greatest(first, F.col("block") * block)
    end = F.least(F.col("end_word"), (F.col("block") + 1) * block)
    pieces = (
        ended.where("size > 0").withColumn("block", F.explode(touched))
        .select("rid", "s", "block", (begin - first).alias("from_word"), (end - begin).alias("n_words"))
    )
    # Written, so that its true size is known to the joins that follow.
    chosen = settle(_slots(spark, [f[0] for f in found], slots, blocks, seed), "mix-slots")
    return named, pieces, chosen, sources


def _ranked(named: DataFrame) -> DataFrame:
    """Number the documents of each source in order, without a window over a whole source."""
    spread = named.repartitionByRange("s", "ord", "tie", "rid").sortWithinPartitions("s", "ord", "tie", "rid")
    spread = settle(spread.withColumn("place", F.monotonically_increasing_id()), "mix-order")
    return spread.select("row", "rid", "s", "size", "place")


def _slots(spark, names: list, counts: np.ndarray, blocks: np.ndarray, seed: int) -> DataFrame:
    total = int(counts.sum())
    shards = -(-total // SHARD_SLOTS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                mine, before = shard_counts(counts, shard, shards, SHARD_SLOTS, seed)
                s = np.repeat(np.arange(len(mine)), mine)
                k = np.concatenate([np.arange(b, b + m) for b, m in zip(before, mine)])
                of = k // np.maximum(1, blocks[s])
                chosen = np.empty(len(s), np.int64)
                for i, e in set(zip(s.tolist(), of.tolist())):
                    here = np.flatnonzero((s == i) & (of == e))
                    chosen[here] = permute(k[here] - e * blocks[i], int(blocks[i]), _key(seed, names[i], e))
                place = permute(np.arange(len(s)), max(1, len(s)), _key(seed, "shard", shard))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(s), shard), pa.int64()), pa.array(place, pa.int64()),
                        pa.array(s, pa.int32()), pa.array(of, pa.int64()), pa.array(chosen, pa.int64()),
                    ],
                    ["shard", "slot", "s", "pass", "block"],
                )

    tasks = max(1, min(shards, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInArrow(fill, "shard long, slot long, s int, pass long, block long")


def taken_words(docs: DataFrame, carry: list[str], **how) -> DataFrame:
    """(row, size, source_size, target, taken): how many words of each document the mix takes, repeats counted."""
    named, pieces, slots, sources = mix_plan(docs, carry, **how)
    uses = slots.groupBy("s", "block").agg(F.count("*").alias("uses"))
    taken = pieces.join(uses, ["s", "block"]).groupBy("rid").agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
    return (
        named.join(taken, "rid", "left").join(F.broadcast(sources.drop("source")), "s")
        .select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id", n_chars: str = "n_chars", **how
) -> DataFrame:
    """The mix as documents: per pass, one row for each document of which words are taken.

    A document taken whole keeps its text; else its text is the taken stretches in order, joined by
    a line break. ``n_chars``, where there is such a column, follows. Columns are those of ``docs``.
    """
    named, pieces, slots, _ = mix_plan(docs, docs.columns, text, source, order, **how)
    stretch = F.struct("from_word", "n_words")
    cut = (
        pieces.join(slots.select("s", "block", "pass"), ["s", "block"])
        .groupBy("rid", "pass").agg(F.array_sort(F.collect_list(stretch)).alias("parts"), F.sum("n_words").alias("n"))
    )
    body = F.col("row")[text]
    w = F.regexp_extract_all(body, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    # Neighbouring pieces are one stretch: join with a space inside, a line break where words are missing.
    parts = F.transform(
        "parts",
        lambda p, i: F.concat(
            F.when(i == 0, "").when(
                F.col("parts")[i - 1]["from_word"] + F.col("parts")[i - 1]["n_words"] == p["from_word"], " "
            ).otherwise("\n"),
            F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), " "),
        ),
    )
    new = F.when(F.col("n") == F.col("size"), body).otherwise(F.array_join(parts, ""))
    out = named.join(cut, "rid").withColumn("new", new)
    values = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("new")}
    if n_chars in docs.columns:
        values[n_chars] = F.length("new").cast(docs.schema[n_chars].dataType)
    return out.select(*[v.alias(c) for c, v in values.items()])
