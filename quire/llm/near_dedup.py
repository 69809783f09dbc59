"""Near-duplicate detection with BagMinHash signatures of weighted shingles.

A text is a multiset of five-word shingles. Its signature has one register per hash function;
every unit of weight of every shingle is a Poisson process of points (time, register), and a
register keeps the earliest time that hits it, so two registers agree with a probability equal
to the weighted Jaccard similarity. Weights are cut at 1, 2, 4, 8, ...: each stretch is one
process of the rate of its length whose points carry a level, and points above the shingle's
weight are thinned out. A shingle thus costs one process per doubling of its weight, and all
texts that share it share the points. Points are drawn in order of time and only up to the
latest register filled so far, so most processes end with their first point.

Texts with equal word sequences are one text from the start. Signatures are cut in bands;
texts that share a band meet in a bucket. A bucket does not emit its pairs: its members are
verified against a leader, the member that shares most bands with others, and verified links
make components. What is left, members of a bucket in different components, is compared in
blocks inside the tasks by signatures of many more registers, each pair in the first band that
it shares, and only pairs near the similarity come out and are verified. No pair that could
join two components is left out, and copies inside a component cost one check each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.quality_rules import _ddl
from quire.llm.text import joined, mix, row, slices, utf8, words
from quire.session import arrow_batches, clear_scratch, discard, settle, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128
BAND_ROWS = 4
LEADER_ROUNDS = 2
FINE_REGISTERS = 1024
BLOCK = 1024
BROADCAST_IDS = 1_000_000
BATCH_BYTES = 4 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _nth(k: int) -> np.uint64:
    """k-th seed of a sequence."""
    return np.uint64(k * 0xD1B54A32D192ED03 % 2**64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text number, shingle, weight) of the distinct shingles of each text, and a digest of each word sequence.

    A text of one to four words is one shingle; a text without words has none.
    """
    data, offsets = utf8(texts)
    _, _, text, hashes = words(data, offsets)
    n = len(texts)
    cuts = np.searchsorted(text, np.arange(n + 1))
    digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]
    windows = joined(hashes, SHINGLE_WORDS)
    inside = np.flatnonzero(text[: len(windows)] == text[SHINGLE_WORDS - 1 :]) if len(windows) else np.zeros(0, np.int64)
    size = np.diff(cuts)
    short = np.flatnonzero((size > 0) & (size < SHINGLE_WORDS))
    whole = np.array([int.from_bytes(digests[i][:8], "little") for i in short], np.uint64)
    owner, found = np.concatenate([text[inside], short]), np.concatenate([windows[inside], whole])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(new)
    return owner[at], found[at], np.diff(np.append(at, len(owner))), digests


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers earliest times; rows of texts without shingles are infinite."""
    times = np.full((n, registers), np.inf)
    mass = np.bincount(owner, weight, n)
    with np.errstate(divide="ignore"):
        limit = (np.log(registers) + 4) * registers / mass
    open_ = mass > 0
    while open_.any():
        chosen = open_[owner]
        _draw(times, owner[chosen], shingle[chosen], weight[chosen], limit)
        open_ = np.isinf(times).any(axis=1) & (mass > 0)
        times[open_] = np.inf
        limit = limit * 2
    return times


def _draw(times: np.ndarray, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> None:
    """Draw all points of the texts' processes up to ``limit`` that can still lower a register."""
    registers = times.shape[1]
    low, stretch = 0, 0
    while len(owner):
        high = max(1, 2 * low)
        rate = float(high - low)
        seed = mix(shingle ^ _nth(-stretch - 1))
        own, w, seeds = owner, weight, seed
        time, step = np.zeros(len(own)), 0
        bound = np.minimum(limit, times.max(axis=1))
        while len(own):
            step += 1
            base = mix(seeds + _nth(step))
            time = time - np.log(_uniform(base)) / rate
            alive = time <= bound[own]
            own, w, seeds, time, base = own[alive], w[alive], seeds[alive], time[alive], base[alive]
            if not len(own):
                break
            hit = mix(base + _GOLD)
            register = (hit % np.uint64(registers)).astype(np.int64)
            level = low + 1 + ((hit >> np.uint64(20)) % np.uint64(high - low)).astype(np.int64)
            counts = level <= w
            np.minimum.at(times.reshape(-1), own[counts] * registers + register[counts], time[counts])
            if step % 4 == 0:
                bound = np.minimum(limit, times.max(axis=1))
        low, stretch = high, stretch + 1
        more = weight > low
        owner, shingle, weight = owner[more], shingle[more], weight[more]


def signed(texts: DataFrame) -> DataFrame:
    """(rid, ord, digest, sig) of ``texts`` (rid, ord, text): the word-sequence digest and, where there is a word, the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, shingle, weight, digests = shingles(part.column("text"))
            times = bag_min_hash(owner, shingle, weight, part.num_rows)
            sig = (mix(times.view(np.uint64)) >> np.uint64(32)).astype("<u4")
            inked = np.isfinite(times[:, 0]).tolist()
            columns = [pa.array(digests, pa.binary()), pa.array([s.tobytes() if ink else None for s, ink in zip(sig, inked)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("ord"), *columns], ["rid", "ord", "digest", "sig"])

    return texts.mapInArrow(run, f"{_ddl(texts.select('rid', 'ord'))}, digest binary, sig binary")


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """Key of each band of signatures shaped (text, band, row)."""
    key = np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * _GOLD + np.zeros((len(sig), 1), np.uint64)
    for k in range(sig.shape[2]):
        key = mix(key + sig[:, :, k].astype(np.uint64))
    return key


def _bands(signatures: DataFrame) -> DataFrame:
    """(bucket, band, rid): one row per band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(batch.num_rows, -1, BAND_ROWS)
            key = _band_keys(sig)
            rid = np.repeat(batch.column("rid").to_numpy(), sig.shape[1])
            band = np.tile(np.arange(sig.shape[1], dtype=np.int32), len(sig))
            columns = [pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(rid)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "band", "rid"])

    return signatures.select("rid", "sig").mapInArrow(run, "bucket long, band int, rid long")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of a[i] and b[i]."""
    n = len(a)
    (ao, ash, aw, _), (bo, bsh, bw, _) = shingles(a), shingles(b)
    owner, shingle = np.concatenate([ao, bo]), np.concatenate([ash, bsh])
    left, right = np.concatenate([aw, np.zeros_like(bw)]), np.concatenate([np.zeros_like(aw), bw])
    order = np.lexsort((shingle, owner))
    owner, shingle, left, right = owner[order], shingle[order], left[order], right[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(n)
    x, y = np.add.reduceat(left, at), np.add.reduceat(right, at)
    both, any_ = np.bincount(owner[at], np.minimum(x, y), n), np.bincount(owner[at], np.maximum(x, y), n)
    return both / np.maximum(any_, 1)


def _few(ids: DataFrame) -> DataFrame:
    """A settled table of narrow rows, broadcast if it has few; a larger one is joined by shuffling."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _floor(registers: int, similarity: float, chance: float = 0.0) -> float:
    """Five standard deviations below the expected number of equal registers: less than one link in a million is lost."""
    p = similarity + (1 - similarity) * chance
    return registers * p - 5 * (registers * p * (1 - p)) ** 0.5


def _verified(pairs: DataFrame, info: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts really have the similarity."""
    least = _floor(REGISTERS, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(slices(iter([batch]), "text_a"), "text_b"):
                sig = [np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").reshape(part.num_rows, -1) for c in ("sig_a", "sig_b")]
                near = np.flatnonzero((sig[0] == sig[1]).sum(axis=1) >= least)
                if len(near):
                    part = part.take(pa.array(near))
                    good = np.flatnonzero(overlap(part.column("text_a"), part.column("text_b")) >= similarity)
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    ids = settle(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), "near-ids")
    info = info.join(_few(ids), "rid", "left_semi")  # before the texts move
    side = lambda s: info.select(F.col("rid").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("text").alias(f"text_{s}"))
    met = side("a").join(_few(pairs), "a").join(side("b"), "b")
    return met.select("a", "b", "sig_a", "text_a", "sig_b", "text_b").mapInArrow(run, "a long, b long")


def _fine(info: DataFrame) -> DataFrame:
    """(rid, bands, fine): 32-bit band hashes, and a second signature with more registers of four bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, shingle, weight, _ = shingles(part.column("text"))
            times = bag_min_hash(owner, shingle, weight, part.num_rows, FINE_REGISTERS)
            nibbles = (mix(times.view(np.uint64)) >> np.uint64(60)).astype(np.uint8)
            fine = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(part.num_rows, -1, BAND_ROWS)
            bands = (_band_keys(sig) >> np.uint64(32)).astype("<u4")
            columns = [part.column("rid"), *(pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (bands, fine))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "bands", "fine"])

    return info.select("rid", "sig", "text").mapInArrow(run, "rid long, bands binary, fine binary")


def _compared(rest: DataFrame, info: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``rest`` (bucket, band, rid, c) in one bucket, of different components, that may have the similarity."""
    least = _floor(FINE_REGISTERS, similarity, 1 / 16)
    fine = settle(_fine(info.join(rest.select("rid").distinct(), "rid", "left_semi")), "near-fine")
    # Only buckets of more than one block need their size, and there are few: the rows of a hot bucket are not brought together for it.
    large = settle(rest.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "near-large")
    sized = rest.join(_few(large), "bucket", "left")
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK)
    # A member goes to every pair of blocks that its own block is part of: once, in a bucket of one block.
    dealt = sized.withColumns({"block": F.pmod(F.xxhash64("rid", "bucket"), blocks), "blocks": blocks}).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    member = F.struct("rid", "c", "block", "bands", "fine").alias("m")
    met = (
        dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .join(fine, "rid").groupBy("bucket", "band", "low", "high").agg(F.collect_list(member).alias("m"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band, low, high = (batch.column(c)[k].as_py() for c in ("band", "low", "high"))
                members = batch.column("m")[k].values
                rid, c, block = (members.field(f).to_numpy() for f in ("rid", "c", "block"))
                bands, fine = (
                    np.frombuffer(b"".join(members.field(f).to_pylist()), kind).reshape(len(rid), -1)
                    for f, kind in (("bands", "<u4"), ("fine", np.uint8))
                )
                out: list[tuple[int, int]] = []
                for i in range(len(rid)):
                    if low < high and block[i] != low:
                        continue
                    j = np.flatnonzero(block == high) if low < high else np.arange(i + 1, len(rid))
                    j = j[c[j] != c[i]]
                    unlike = fine[j] ^ fine[i]
                    j = j[((unlike & 0xF0) == 0).sum(axis=1) + ((unlike & 0x0F) == 0).sum(axis=1) >= least]
                    if len(j):
                        j = j[(bands[j] == bands[i]).argmax(axis=1) == band]
                        out += [(min(x, y), max(x, y)) for x, y in zip([rid[i].item()] * len(j), rid[j].tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return met.select("band", "low", "high", "m").mapInArrow(run, "a long, b long")


def _links(members: DataFrame, info: DataFrame, similarity: float, rounds: int) -> DataFrame | None:
    """(node, root) of all texts that have a link."""
    roots, links, tested = None, [], []
    for step in range(rounds + 1):
        if roots is None:
            placed = members.withColumn("c", F.col("rid"))
        else:
            placed = members.join(_few(roots.withColumnRenamed("node", "rid")), "rid", "left").select(
                "bucket", "band", "rid", F.coalesce("root", "rid").alias("c")
            )
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
        placed = settle(placed.join(_few(settle(mixed.select("bucket", "n"), "near-mixed")), "bucket"), "near-placed")
        if step < rounds:
            weight = settle(placed.groupBy("rid").agg(F.sum("n").alias("weight")), "near-weights")
            lead = F.max(F.struct("weight", F.xxhash64("rid", F.lit(step)).alias("h"), "rid", "c")).alias("lead")
            leaders = placed.join(_few(weight), "rid").groupBy("bucket").agg(lead)
            leaders = settle(
                leaders.select("bucket", F.col("lead.rid").alias("b"), F.col("lead.c").alias("cb"), F.col("lead.weight").alias("of"), F.col("lead.h").alias("h")),
                "near-leaders",
            )
            met = placed.withColumnRenamed("rid", "a").join(leaders, "bucket").where("c <> cb")
            if step == 0:  # at first only the best connected leader of all its buckets: most copies are linked by that
                met = met.groupBy("a").agg(F.max(F.struct("of", "h", "b")).alias("best")).select("a", "best.b")
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = _compared(placed.drop("n"), info, similarity)
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = settle(pairs, "near-pairs")
        if pairs.isEmpty():
            continue
        tested.append(pairs)
        found = settle(_verified(pairs, info, similarity), "near-links")
        if not found.isEmpty():
            links.append(found)
            roots = settle(components(reduce(DataFrame.unionByName, links)), "near-roots")
    return roots


def mark_near(
    docs: DataFrame, carry: list[str], text: str = "text", order: str = "doc_id", similarity: float = SIMILARITY,
    rounds: int = LEADER_ROUNDS,
) -> DataFrame:
    """(row, class_id, class_size, kept) for every row of ``docs``.

    A class is a component of the links "weighted Jaccard of five-word shingles >= similarity";
    the row with the smallest ``order`` stays (null is the largest; of equal ones exactly one stays)
    and names the class. Texts with the same words in the same order are always one class, texts
    without words too. No rows give no rows.
    """
    base, verdicts = _marked(docs, carry, text, order, similarity, rounds)
    return base.select("rid", "row").join(verdicts, "rid").select("row", "class_id", "class_size", "kept")


def _marked(
    docs: DataFrame, carry: list[str], text: str, order: str, similarity: float = SIMILARITY, rounds: int = LEADER_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Settled rows (rid, row) and verdicts (rid, class_id, class_size, kept)."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _classed(docs, carry, text, order, similarity, rounds)


def _classed(docs: DataFrame, carry: list[str], text: str, order: str, similarity: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    before = written()
    kept_text = [] if text in carry else [docs[f"`{text}`"].cast("string").alias("text")]
    base = docs.select(row(docs, carry).alias("row"), docs[f"`{order}`"].alias("ord"), *kept_text)
    base = settle(base.withColumn("rid", F.monotonically_increasing_id()), "near-rows")
    texts = base.select("rid", "ord", ("text" if kept_text else F.col("row")[text].cast("string").alias("text")))
    signatures = settle(signed(texts), "near-signed")
    same = settle(signatures.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "near-texts")
    reps = signatures.where("sig is not null").join(_few(same.select(F.col("rep").alias("rid"))), "rid", "left_semi")
    bands = settle(_bands(reps.select("rid", "sig")), "near-bands")
    shared = settle(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-shared")
    members = settle(bands.join(_few(shared), "bucket"), "near-buckets")
    discard(bands, shared)
    # Texts are needed only where some band is shared.
    wanted = _few(settle(members.select("rid").distinct(), "near-wanted"))
    info = texts.select("rid", "text").join(wanted, "rid", "left_semi").join(signatures.select("rid", "sig").join(wanted, "rid", "left_semi"), "rid")
    info = settle(info.select("rid", "sig", "text"), "near-info")
    roots = _links(members, info, similarity, rounds)
    at = same.select("digest", "rep")
    if roots is not None:
        at = at.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("rep"))
    placed = settle(signatures.select("rid", "ord", "digest").join(_few(settle(at, "near-classes")), "digest").drop("digest"), "near-placed")
    first = F.min(F.struct(F.col("ord").isNull().alias("none"), "ord", "rid")).alias("first")
    classes = settle(placed.groupBy("rep").agg(first, F.count("*").alias("class_size")), "near-sizes")
    verdicts = placed.join(_few(classes), "rep").select(
        "rid", F.col("first.ord").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept")
    )
    verdicts = settle(verdicts, "near-verdicts")
    clear_scratch(docs.sparkSession, [p for p in written() if p not in {*before, base.scratch, verdicts.scratch}])
    return base, verdicts


def near_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate class; same columns. Where few rows go, only their numbers move."""
    base, verdicts = _marked(docs, docs.columns, text, order, **how)
    gone = _few(settle(verdicts.where("not kept").select("rid"), "near-gone"))
    return base.join(gone, "rid", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
