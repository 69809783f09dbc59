from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.mixing import _split, mix_plan, mixed_documents, permute, shard_counts, taken_words, targets

SCHEMA = "doc_id long, text string, source string, size string, s int, n_chars long"


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(permute(np.arange(n), n, 99).tolist()) == list(range(n))
    assert permute(np.arange(50), 1000, 5).tolist() == permute(np.arange(1000), 1000, 5)[:50].tolist()


def test_shards_share_out_all_slots():
    counts = np.array([1000, 0, 37, 1, 5000], np.int64)
    shards = -(-int(counts.sum()) // 256)
    total = np.zeros(5, np.int64)
    for shard in range(shards):
        mine, before = shard_counts(counts, shard, shards, 256, 3)
        assert (before == total).all()
        total = total + mine
        assert mine.sum() == (256 if shard < shards - 1 else counts.sum() - 256 * (shards - 1))
    assert (total == counts).all()


def test_split_is_a_hypergeometric_draw():
    """Mean and covariance of many draws are those of the distribution."""
    counts, share = np.array([50, 0, 7, 143, 1], np.int64), 60
    draws = np.array([_split(counts, share, (0, k), 11) for k in range(20_000)])
    assert (draws >= 0).all() and (draws <= counts).all() and (draws.sum(axis=1) == share).all()
    n, p = int(counts.sum()), counts / counts.sum()
    cov = share * (n - share) / (n - 1) * (np.diag(p) - np.outer(p, p))
    assert np.abs(draws.mean(axis=0) - share * p).max() < 0.1
    assert np.abs(np.cov(draws.T) - cov).max() < 0.3


@pytest.mark.parametrize("total", [10**3, 10**9, 10**12, 10**15])
def test_split_at_any_size(total):
    """Far above half a billion slots draws still vary as they should, by the root of their number."""
    counts = np.array([total // 3, 5, total - total // 3 - 5], np.int64)
    share = total // 2
    draws = np.array([_split(counts, share, (k, 9), 1) for k in range(300)])
    assert (draws >= 0).all() and (draws <= counts).all() and (draws.sum(axis=1) == share).all()
    spread = (total * 2 / 9 / 4) ** 0.5
    assert 0.8 < draws[:, 0].std() / spread < 1.2 and abs(draws[:, 0].mean() - counts[0] / 2) < spread / 3
    assert 0.8 < draws[:, 1].std() / (5 / 4) ** 0.5 < 1.2
    assert (_split(counts, share, (0, 9), 1) == draws[0]).all()
    assert (_split(counts, 0, (0, 9), 1) == 0).all() and (_split(counts, total, (0, 9), 1) == counts).all()


def test_targets():
    assert targets([1000, 10, 1000]) == pytest.approx([1980 * 5 / 6, 30, 1980 / 6])
    assert sum(targets([5, 100, 7, 900])) == pytest.approx(1012)
    assert targets([0, 0]) == [0, 0] and targets([]) == []


def documents(spark, n=3000):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}"
        rows.append((i, " ".join(f"d{i}w{k}" for k in range(i % 90)), source, "x", 1, None))
    rows += [(None, None, "hot", "x", 1, 0), (5, "", None, "x", 1, 0), (7, "a b", "s1", "", 2, 3), (7, "a b", "s1", "", 2, 3)]
    rows.append((n, " ".join("long" for _ in range(20_000)), "s2", "", 0, 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_taken_words(spark):
    docs = documents(spark)
    got = taken_words(docs, ["doc_id", "source"]).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["row"]["source"], [0, r["source_size"], r["target"]])[0] += r["taken"]
    for taken, size, target in by.values():
        assert abs(taken - target) <= 3 * 128 and target <= 3 * size
    again = taken_words(docs.repartition(7), ["doc_id", "source"]).collect()
    key = lambda r: (str(r["row"]["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_every_pass_uses_a_block_once(spark):
    _, _, slots, _ = mix_plan(documents(spark), ["doc_id"])
    rows = slots.collect()
    assert max(Counter((r["s"], r["pass"], r["block"]) for r in rows).values()) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_mixed_documents_match_the_plan(spark):
    docs = documents(spark, 900)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    taken = {}
    for r in taken_words(docs, ["doc_id"]).collect():
        taken[r["row"]["doc_id"]] = taken.get(r["row"]["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in taken.items() if v} == words


def test_taken_matches_a_plain_recomputation(spark):
    """Blocks, slots and documents counted word by word in plain Python."""
    docs = documents(spark, 700)
    _, _, slots, sources = mix_plan(docs, ["doc_id"])
    uses = Counter((r["s"], r["block"]) for r in slots.collect())
    name = {r["source"]: r["s"] for r in sources.collect()}
    rows = docs.withColumn("tie", F.xxhash64("text")).collect()
    want, at = Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"])):
        s = name[r["source"]]
        for _ in (r["text"] or "").split():
            want[r["doc_id"]] += uses[s, at[s] // 128]
            at[s] += 1
    got = Counter()
    for r in taken_words(docs, ["doc_id"]).collect():
        got[r["row"]["doc_id"]] += r["taken"]
    assert +got == +want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert taken_words(none, ["doc_id"]).count() == 0
    assert mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, "", 0, 0), (2, " ", "a", "", 0, 0)], SCHEMA)
    assert [r["taken"] for r in taken_words(blank, ["doc_id"]).collect()] == [0, 0]
