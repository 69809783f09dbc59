from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest

import corpus_pipeline
from quire.llm import pieces
from quire.llm.mixing import targets
from quire.session import settle

SF_DIR = "/root/testdata/sf0.001"


def bag(text):
    w = text.split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF_DIR), "test-stage")
        out.append(docs.collect())
    return out


def test_columns_and_names(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names[0] == "quality classifier" and len(names) == 5
    assert all(set(rows[0].asDict()) == set(stages[0][0].asDict()) for rows in stages[:5])


def test_quality_keeps_good_documents(spark, stages):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good = [i for i, q in label.items() if q == 1]
    bad = [i for i, q in label.items() if q == 0]
    assert len([i for i in good if i in kept]) >= 0.95 * len(good)
    assert len([i for i in bad if i in kept]) <= 0.2 * len(bad)
    before = {r["doc_id"]: r for r in stages[0]}
    assert all(before[r["doc_id"]] == r for r in stages[1])


def test_exact_and_near(stages):
    fold = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    best: dict = {}
    for r in stages[1]:
        best[fold(r["text"])] = max(best.get(fold(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(best.values())
    bags = {r["doc_id"]: bag(r["text"]) for r in stages[2]}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(bags), 2):
        x, y = bags[i], bags[j]
        if x.keys() & y.keys() and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(r["doc_id"] for r in stages[3]) == sorted({find(i) for i in bags})


def test_mix_and_encode(stages):
    sizes: Counter = Counter()
    for r in stages[3]:
        sizes[r["source"]] += len(r["text"].encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    taken: Counter = Counter()
    for r in stages[4]:
        taken[r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    for name, target in zip(names, targets([sizes[n] for n in names])):
        assert abs(taken[name] - target) <= 3 * 128
    sp = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in stages[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5]) == want


def test_run_and_registration(spark, stages):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    got = names["pipeline"](spark, SF_DIR)
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"])
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[5]))
