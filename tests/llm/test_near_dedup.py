from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.components import components
from quire.llm.near_dedup import bag_min_hash, mark_near, near_dedup, overlap, shingles

SCHEMA = "doc_id long, text string, class_id string, rid int"


def bag(text):
    w = (text or "").split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def jaccard(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(900)}"
    out = [None, "", " \n", "one", "one", "two three", "a b c d e", "a b c d e"]
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(30, 300))]
        if rng.random() < 0.3:
            text = text[:6] * 20
        out.append(" ".join(text))
        for _ in range(rng.choice([0, 1, 3, 9])):
            new = list(text)
            for _ in range(rng.randrange(1, 7)):
                new[rng.randrange(len(new))] = word()
            out.append(" ".join(new) if rng.random() < 0.8 else "  ".join(text))
    return out + ["long " * 30_000, "long " * 30_001]


def classes_of(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if (texts[i] or "").split() == (texts[j] or "").split() or jaccard(texts[i], texts[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [0, 4])
def test_classes_match_brute_force(spark, rounds):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = mark_near(docs, ["doc_id", "rid"], rounds=rounds).collect()
    want = classes_of(texts)
    assert len(got) == len(texts)
    sizes = Counter(want)
    for r in got:
        i = r["row"]["doc_id"]
        assert (r["class_id"], r["class_size"], r["kept"]) == (want[i], sizes[want[i]], want[i] == i)


def test_ties_nulls_and_columns(spark):
    rows = [(None, "same words here", "x", 1), (4, "same words here", "y", 2), (4, "same  words here", "y", 2)]
    kept = near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "class_id", "rid"] and [r["doc_id"] for r in kept.collect()] == [4]
    assert mark_near(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_signatures_estimate_weighted_jaccard():
    """Mean agreement over many registers is the weighted similarity, for heavy weights too."""
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for low, high in ((1, 2), (1, 40)):
        a, b = rng.integers(low, high, 60), rng.integers(low, high, 60)
        a[:10], b[-10:] = 0, 0
        both = [np.flatnonzero(a), np.flatnonzero(b)]
        owner = np.concatenate([np.zeros(len(both[0]), np.int64), np.ones(len(both[1]), np.int64)])
        at, w = np.concatenate(both), np.concatenate([a[both[0]], b[both[1]]])
        sig = bag_min_hash(owner, keys[at], w, 2, 8192)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    empty = bag_min_hash(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 2)
    assert np.isinf(empty).all()


def test_shingles_and_overlap():
    texts = corpus(9)[:60]
    owner, _, weight, _ = shingles(pa.array(texts))
    assert np.bincount(owner, weight, len(texts)).tolist() == [sum(bag(t).values()) for t in texts]
    a, b = texts, texts[1:] + texts[:1]
    assert overlap(pa.array(a), pa.array(b)).tolist() == pytest.approx([jaccard(x, y) for x, y in zip(a, b)])


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
