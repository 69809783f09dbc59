"""Nodes -> token-bounded segments, and the checks around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import let, slices, strip
from quire.functions.segment import fragments, oversize_limit, pack_nodes, pack_starts
from quire.functions.text import estimate_tokens
from quire.params import EXCERPT_LIMITS, FRONT_MATTER_TERMS, MAX_NODES_PER_SEGMENT, TARGET_TOKENS
from quire.session import settle

# Nodes per block of the two-level packing: the largest group one task ever holds.
PACK_BLOCK_NODES = 1024


def split_oversized(nodes: DataFrame, keep: list[str], html: str = "html", limit: int = oversize_limit(TARGET_TOKENS)) -> DataFrame:
    """Nodes above ``limit`` become sentence-packed fragments in the same tag; narrow."""
    return nodes.select(*keep, F.posexplode(fragments(strip(F.col(html)), limit)).alias("frag_idx", "html")).where(
        F.col("html") != ""
    )


def segment_documents(docs: DataFrame, keep: list[str], nodes: Column, target: int = TARGET_TOKENS) -> DataFrame:
    """Segments of documents whose nodes derive from their own row.

    Extraction, splitting and packing stay inside the row, so a whole corpus is
    segmented without any shuffle. Use ``pack_segments`` when the nodes of one
    document are spread over many rows.
    """
    return docs.select(*keep, F.explode(pack_nodes(nodes, target)).alias("s")).select(*keep, "s.*")


def _exit_maps(target: int, max_nodes: int):
    """Vectorised transition map of one block: where packing leaves it, for every way to enter it.

    ``entry`` e means "the first segment start in this block is at position e". As
    a segment holds at most ``max_nodes`` nodes, there are only ``max_nodes``
    entries, which makes packing a finite-state walk over blocks.
    """

    def exits(tokens: np.ndarray, halo: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(tokens)
        sums = np.concatenate(([0], np.cumsum(np.concatenate((tokens, halo)))))
        reach = np.searchsorted(sums, sums[:n] + target, side="right") - 1
        nxt = np.minimum(np.maximum(reach, np.arange(n) + 1), np.arange(n) + max_nodes)
        leave, starts = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            inside = nxt[i] < n
            leave[i] = leave[nxt[i]] if inside else int(nxt[i]) - n
            starts[i] = (starts[nxt[i]] if inside else 0) + 1
        late = range(n, max_nodes)
        return (leave + [e - n for e in late])[:max_nodes], (starts + [0 for _ in late])[:max_nodes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = [exits(np.asarray(t, dtype=np.int64), np.asarray(h, dtype=np.int64))
                    for t, h in zip(pdf["tokens"], pdf["halo"])]
            yield pdf.drop(columns=["tokens", "halo"]).assign(
                leave=[m[0] for m in maps], starts=[m[1] for m in maps]
            )

    return run


def _walk(key: str):
    """Follow the transition maps along the blocks of each document; constant state per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, entry, base = None, 0, 0
        for pdf in batches:
            entries, bases = [], []
            for doc, leave, starts in zip(pdf[key], pdf["leave"], pdf["starts"]):
                if doc != current:
                    current, entry, base = doc, 0, 0
                entries.append(entry)
                bases.append(base)
                entry, base = int(leave[entry]), base + int(starts[entry])
            yield pdf[[key, "blk"]].assign(entry=entries, base=bases)

    return run


def pack_segments(
    nodes: DataFrame,
    key: str = "doc_id",
    target: int = TARGET_TOKENS,
    max_nodes: int = MAX_NODES_PER_SEGMENT,
    block_nodes: int = PACK_BLOCK_NODES,
) -> DataFrame:
    """Greedy, order-preserving packing of a node table (``key, node_idx, html``).

    Exact even when one document holds a large share of all rows: documents are
    cut in blocks of ``block_nodes`` nodes, every block of a long document is
    summarised in parallel as a transition map, one light pass over those maps
    finds where each block is entered, and the blocks are then packed in parallel.
    No task holds more than one block of text.
    """
    limit = oversize_limit(target)
    units = split_oversized(nodes, [key, "node_idx"], "html", limit).select(
        key, "node_idx", "frag_idx", "html", estimate_tokens(F.col("html")).alias("tokens"),
        F.floor(F.col("node_idx") / block_nodes).cast("int").alias("blk"),
    )

    # Grouped and written once; the token counts are a narrow column of the same rows.
    texts = settle(
        units.groupBy(key, "blk").agg(F.array_sort(F.collect_list(F.struct("node_idx", "frag_idx", "tokens", "html"))).alias("u")),
        "pack-units",
    )
    heads = texts.select(key, "blk", F.col("u.tokens").alias("tokens"))
    # One row per block from here on, and only for documents longer than one block.
    ahead = Window.partitionBy(key).orderBy("blk").rowsBetween(1, max_nodes)
    per_doc = Window.partitionBy(key)
    long_docs = heads.withColumn("blocks", F.count("*").over(per_doc)).where("blocks > 1").withColumn(
        "halo", F.slice(F.flatten(F.collect_list(F.slice("tokens", 1, max_nodes)).over(ahead)), 1, max_nodes)
    ).select(key, "blk", "tokens", "halo")
    key_type = nodes.schema[key].dataType.simpleString()
    maps = long_docs.mapInPandas(
        _exit_maps(target, max_nodes), f"{key} {key_type}, blk int, leave array<int>, starts array<int>"
    )
    entries = (
        maps.repartition(key).sortWithinPartitions(key, "blk")
        .mapInPandas(_walk(key), f"{key} {key_type}, blk int, entry int, base int")
    )

    placed = texts.join(entries, [key, "blk"], "left").withColumns(
        {"entry": F.coalesce("entry", F.lit(0)), "base": F.coalesce("base", F.lit(0))}
    )
    # Units before the entry belong to the segment that the previous block left open.
    lead = F.when(F.col("entry") > 0, F.array(F.slice("u", F.lit(1), F.col("entry")))).otherwise(
        F.slice(F.array("u"), 1, 0)
    )
    groups = let(
        F.slice("u", F.col("entry") + 1, F.greatest(F.size("u") - F.col("entry"), F.lit(0))),
        lambda us: slices(us, pack_starts(F.transform(us, lambda x: x["tokens"]), target, max_nodes)),
    )
    first = F.col("base") - F.size(lead)
    pieces = placed.select(key, first.alias("first"), F.posexplode(F.concat(lead, groups)).alias("k", "g")).select(
        key,
        (F.col("first") + F.col("k")).cast("int").alias("chunk_index"),
        "g",
    )
    # A segment is bounded by max_nodes, so this group is small whatever the document size.
    return pieces.groupBy(key, "chunk_index").agg(
        F.array_sort(F.flatten(F.collect_list("g"))).alias("g")
    ).select(
        key,
        "chunk_index",
        F.array_join(F.transform("g", lambda x: x["html"]), "\n\n").alias("text"),
        F.aggregate("g", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens_est"),
        F.transform("g", lambda x: x["node_idx"]).alias("node_indices"),
    )


def limit_segments(segments: DataFrame, max_segments: int) -> DataFrame:
    """Keep the first ``max_segments`` segments of every document (a setting of the job)."""
    return segments.where(F.col("chunk_index") < max_segments) if max_segments and max_segments > 0 else segments


def validate_params(requests: DataFrame) -> DataFrame:
    """Range checks on job requests -> ``reject_reason`` (NULL when accepted).

    Job type, languages, model, size, concurrency and temperature are required; the rest may be NULL.
    """

    def required(bad: Column) -> Column:
        return F.coalesce(bad, F.lit(True))

    def outside(name: str, low, high) -> Column:
        return ~F.col(name).between(low, high)

    def bad_language(name: str) -> Column:
        return required(~F.rlike(F.col(name), F.lit(r"^[a-zA-Z-]{2,20}\z")))

    reason = (
        F.when(required(~F.col("job_type").isin("translation", "proofreading")), "job_type")
        .when(bad_language("source_lang") | bad_language("target_lang"), "language")
        .when(required((strip(F.col("model")) == "") | (F.length("model") > 300)), "model")
        .when(F.length("system_prompt") > 100_000, "system_prompt")
        .when(outside("max_segments", 1, 100_000), "max_segments")
        .when((F.length("api_type") > 50) | (F.length("endpoint") > 2_000), "provider")
        .when(required(outside("chunk_size", 200, 10_000)), "chunk_size")
        .when(required(outside("concurrency", 1, 32)), "concurrency")
        .when(required(outside("temperature", 0.0, 2.0)), "temperature")
    )
    return requests.withColumn("reject_reason", reason)


def excerpt(docs: DataFrame, keep: list[str], nodes: Column, limit: int = TARGET_TOKENS) -> DataFrame:
    """First readable passage of each document: front matter skipped, then nodes up to ``limit`` tokens."""
    bounded = max(EXCERPT_LIMITS[0], min(EXCERPT_LIMITS[1], limit))

    def front_matter(html: Column) -> Column:
        plain = strip(F.regexp_replace(html, "<[^>]*>", ""))
        terms = "|".join(FRONT_MATTER_TERMS)
        return (
            F.rlike(F.lower(plain), F.lit(terms))
            | (F.length(plain) < 40)
            | F.contains(F.lower(html), F.lit("href="))
        )

    def pick(ns: Column) -> Column:
        indexed = F.transform(ns, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
        body = F.get(F.filter(indexed, lambda x: ~front_matter(x["h"])), F.lit(0))
        # Nothing readable: fall back to the non-blank nodes from the start.
        rest = F.when(
            body.isNotNull(), F.slice(ns, F.coalesce(body["i"], F.lit(0)) + 1, F.size(ns))
        ).otherwise(F.filter(ns, lambda h: strip(h) != ""))
        zero = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("taken"))
        return let(
            rest,
            lambda rs: let(
                F.aggregate(
                    rs, zero,
                    lambda acc, h: F.when(acc["tokens"] >= bounded, acc).otherwise(
                        F.struct((acc["tokens"] + estimate_tokens(h)).alias("tokens"), (acc["taken"] + 1).alias("taken"))
                    ),
                ),
                lambda got: F.struct(
                    F.array_join(F.transform(F.slice(rs, F.lit(1), got["taken"]), strip), "\n\n").alias("text"),
                    got["tokens"].alias("tokens"),
                ),
            ),
        )

    return docs.select(*keep, let(nodes, pick).alias("e")).select(*keep, "e.text", "e.tokens")


def empty_document(docs: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a single segment; only keys are shuffled."""
    return docs.join(segments.select(key).distinct(), key, "left_anti")
