from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.quality_model import FEATURES, Discriminant, fit, keep_good, score_quality, statistics

DOCS = "doc_id long, text string, score string, held_out int"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéfg") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [word() if good or rng.random() < 0.5 else word().upper() + rng.choice(["!!", "###", "&&"]) for _ in range(rng.randrange(30, 300))]
        docs.append((i, " ".join(w), "s", None))
        labels.append((i, int(good), 0))
    return docs, labels


def test_statistics_are_finite_for_any_text():
    x = statistics(pa.array([None, "", " ", "a", "\n\n", "É", "x" * 10**6, "ab " * 10**5]))
    assert x.shape == (8, len(FEATURES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    assert statistics(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_held_out_accuracy_and_rules(spark):
    docs, labels = corpus()
    extra = [(None, None, "s", 1), (10_000, "", "s", 1), (docs[0][0], docs[0][1], "s", 2)]
    more_labels = [*labels, (None, 1, 0), (3, None, 0), (5, 7, 0), labels[9]]
    got = score_quality(
        spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(more_labels, LABELS), ["doc_id", "score"]
    ).collect()
    assert len(got) == len(docs) + 3
    truth = {i: y for i, y, _ in labels}
    for r in got:
        i = r["row"]["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["row"]["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["row"]["doc_id"]] for r in held]) > 0.95


def test_moments_and_density_match_numpy(spark):
    rng = np.random.default_rng(2)
    d = len(FEATURES)
    rows = [([float(v) for v in rng.normal(y, 1 + y, d)], y) for y in (0, 1) for _ in range(400)]
    model = fit(spark.createDataFrame(rows, "x array<double>, label int").repartition(4))
    assert isinstance(model, Discriminant)
    for y in (0, 1):
        x = np.array([r[0] for r in rows if r[1] == y])
        assert model.means[y] == pytest.approx((x.mean(axis=0) - model.center) / model.scale)
        z = np.cov(((x - model.center) / model.scale).T, bias=True)
        cov = np.linalg.inv(model.factors[y].T @ model.factors[y])
        assert np.abs(cov - z).max() < 0.35  # shrunk towards a sphere
        assert model.log_det[y] == pytest.approx(0.5 * np.linalg.slogdet(cov)[1])


def test_one_class_or_no_label(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, DOCS)
    ones = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS)
    assert all(r["score"] > 0.5 for r in score_quality(df, ones, ["doc_id"]).collect())
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score_quality(df, none, ["doc_id"]).collect()} == {0.5}
    assert keep_good(df, none).columns == df.columns
    assert score_quality(spark.createDataFrame([], DOCS), none, ["doc_id"]).count() == 0
