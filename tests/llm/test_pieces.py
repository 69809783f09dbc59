from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from quire.llm import pieces
from quire.llm.chunks import ChunkTable

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, decoded int"


def texts():
    rng = random.Random(4)
    alphabet = " ▁\t\n 　abçß中🎉é<s></s>\x00▁ "
    out = [None, "", " ", "   ", "▁", "a ", " a", "x" * 50_000, "wörd " * 20_000]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(400)]


def test_same_as_the_library(spark):
    sp = pieces.load(MODEL)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "a b", None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    coded = pieces.encode(docs, ["doc_id", "ids"], MODEL)
    got = {r["row"]["doc_id"]: r for r in coded.collect()}
    digest = {r["row"]["doc_id"]: r for r in pieces.digests(coded).collect()}
    for i, t, _, _ in rows:
        want = sp.encode(t or "")
        assert got[i]["ids"] == want and got[i]["decoded"] == sp.decode(want)
        assert digest[i]["n_tokens"] == len(want)
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert coded.count() == len(rows)


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], SCHEMA), ["doc_id"], MODEL).count() == 0


def test_a_full_table_starts_again():
    table = ChunkTable(lambda new: [[len(c)] * (1 + len(c) % 3) for c in new], limit=8)
    rng = random.Random(1)
    for _ in range(50):
        chunks = ["x" * rng.randrange(12) for _ in range(rng.randrange(20))]
        ids, sizes = table.lookup(chunks)
        assert ids.tolist() == [len(c) for c in chunks for _ in range(1 + len(c) % 3)]
        assert sizes.tolist() == [1 + len(c) % 3 for c in chunks]
    assert len(table.number) <= 12


def test_a_model_that_cannot_be_cut_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "segment", lambda sp, parts: [[0] for _ in parts])
    with pytest.raises(ValueError):
        pieces.check_model(MODEL)
