from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm.ngram_lm import BINS, backoff_weights, score_texts

SCHEMA = "doc_id long, text string, held_out string, chunk int"


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", folded), "</s>"]


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice(["The", "the", "a", "é", "cat", "dog"]) if rng.random() < 0.6 else f"w{rng.randrange(300)}"
    out = [None, "", " ", "THE", "unseen-only", "x " * 3000]
    out += [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(200)]
    return [(i, t, "x", 1) for i, t in enumerate(out)] + [(None, "the cat", "", 1), (5, "the cat", "", 1), (5, "the cat", "", 1)]


def out_of_fit(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows, order):
    """Interpolated probabilities by recursion; backoff weights from counts of the whole corpus (one chunk)."""
    count = Counter()
    for i, t, *_ in rows:
        if not out_of_fit(i):
            w = tokens(t)
            for k in range(1, order + 1):
                count.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    v = sum(1 for g in count if len(g) == 1 and g != ("<s>",))
    seen = np.zeros((order - 1, BINS, 2))
    for g, c in count.items():
        if len(g) > 1:
            b = int(math.log2(count[g[:-1]]))
            seen[len(g) - 2, b] += (c, c * (c == 1))
    weights = backoff_weights(seen)

    def p(g):
        if len(g) == 1:
            return (count[g] + 1) / (n + v + 1)
        h = count[g[:-1]]
        if not h:
            return p(g[1:])
        b = weights[len(g) - 2][int(math.log2(h))]
        return (1 - b) * count[g] / h + b * p(g[1:])

    def row(i, t):
        w = tokens(t)
        ends = range(1, len(w))
        return (
            out_of_fit(i), len(w) - 1, sum(count[(x,)] > 0 for x in w[1:]), n,
            sum(math.log10((count[(w[j],)] + 1) / (n + v + 1)) for j in ends),
            sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in ends),
        )

    return row, p, [g[0] for g in count if len(g) == 1 and g != ("<s>",)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = score_texts(docs, ["doc_id", "text", "held_out"], order=order).collect()
    want, p, words = brute(rows, order)
    assert len(got) == len(rows)
    for r in got:
        values = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert values == pytest.approx(want(r["row"]["doc_id"], r["row"]["text"]), rel=1e-9)
    if order == 2:  # probabilities after a history add up to one, the unseen word included
        for h in ("<s>", "the", "w7"):
            assert sum(p((h, w)) for w in [*words, "never seen"]) == pytest.approx(1)


def test_chunks_do_not_change_counts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    key = lambda r: (str(r["row"]["doc_id"]), r["row"]["text"] or "", r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
    one = sorted(map(key, score_texts(docs, ["doc_id", "text"]).collect()))
    many = score_texts(docs, ["doc_id", "text"], chunk_bytes=700).collect()
    assert sorted(map(key, many)) == one
    better = [r["score"] > r["base_score"] for r in many if r["n_tokens"] > 20]
    assert sum(better) > 0.9 * len(better)


@pytest.mark.parametrize("order", [2, 3])
def test_chunks_do_not_change_scores(spark, order):
    """Backoff weights come from counts of the corpus, however it is dealt into chunks."""
    rows = corpus()
    got = score_texts(spark.createDataFrame(rows, SCHEMA), ["doc_id", "text"], order=order, chunk_bytes=700).collect()
    want, _, _ = brute(rows, order)
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want(r["row"]["doc_id"], r["row"]["text"])[-1], rel=1e-9)


def test_empty(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
