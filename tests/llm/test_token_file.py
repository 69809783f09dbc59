from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm.token_file import WordTable, digests, from_planes, read_tokens, to_planes, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n int, payload string"


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n).astype(np.uint32)
        assert from_planes(to_planes(ids, bits), n).tolist() == ids.tolist()


def texts():
    rng = random.Random(4)
    alphabet = " \t\n\x0b\x1c 　́abAé'sß12中Σς🎉.,"
    out = [None, "", "  ", "<|endoftext|> x<|startoftext|>", "<|ENDOFTEXT|>", "it's 'll", "long " * 5000, "ÀΣ" * 3000]
    out += ["a,b. c7!? é; d,,, x'S. ab.ab. ½, a\u0301. \u0301, .,", "ªb ǅ. ʰ! 中,", "'S, 'll! i'd."]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(500)]


@pytest.mark.parametrize("bits, block", [(False, 64), (True, 1 << 16)])
def test_file_matches_the_library(spark, tmp_path, bits, block):
    rows = [(i * 7 % 4099, t, 1, "x") for i, t in enumerate(texts())] + [(None, "first", None, None), (3, "tie", 1, ""), (3, "tie", 1, "")]
    write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "f"), PATH, 2, block=block, bits=bits)
    read = read_tokens(spark, str(tmp_path / "f"))
    got = sorted((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read.collect())
    tokenizer = Tokenizer.from_file(PATH)
    want: dict = {}
    for i, t, _, _ in rows:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    place = 0
    for start, doc_id, ids in got:
        assert start == place
        want[doc_id].remove(ids)
        place += len(ids)
    assert not any(want.values())
    order = [-1 if d is None else d for _, d, _ in got]
    assert order == sorted(order)
    for r in digests(read).collect():
        ids = next(x for s, _, x in got if s == r["start"])
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def hostile(n):
    """Texts of capitals, combining marks, compatibility forms, punctuation, special names and any other character."""
    rng = random.Random(17)
    marks = [chr(c) for c in range(0x300, 0x370)]
    pool = list("ABCHJTWYZabcw019.,!?;:'-_<|> \t\n") + marks + list("ÅÉßſİıΣςﬁ①㎏½ªǅ가각中🎉\u200d\u00a0\u0085\u2028\ufeff")
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            out.append("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + rng.choice(marks + [""]) + rng.choice(["", " ", ".", "x"]) for _ in range(rng.randrange(8))))
        elif kind < 0.9:
            out.append("".join(rng.choice(pool) for _ in range(rng.randrange(20))))
        else:
            out.append("".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xF900, 0x10000), rng.randrange(0x10000, 0x1F000)])) for _ in range(12)))
    return out + ["<|endoftext|>A.", "ab.<|endoftext|>", "W\u030a T\u0308 Y\u030a J\u030c H\u0331", "x" * 9000 + " " + "y" * 5000 + "x" * 4000]


def test_words_match_the_library_on_hostile_texts():
    texts = hostile(6000)
    table, tokenizer = WordTable(PATH, limit=5000), Tokenizer.from_file(PATH)
    for a in range(0, len(texts), 500):
        ids, sizes = table.encode(pa.array(texts[a : a + 500]))
        ends = np.cumsum(sizes)
        for text, i, j in zip(texts[a : a + 500], ends - sizes, ends):
            assert ids[i:j].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_nulls_and_one_id(spark, tmp_path):
    """Rows with one id, and rows without, are all there, one after the other."""
    rows = [(None, None, 1, "")] * 40 + [(7, "seven", 1, "")] * 40 + [(None, "x", 1, "")]
    write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path / "n"), PATH, 2, block=16)
    got = digests(read_tokens(spark, str(tmp_path / "n"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 41 + [7] * 40
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got][:-1]).tolist()


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), PATH, 2)
    assert digests(read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_ids_are_not_shuffled_to_meet_the_places_of_their_shards(spark, tmp_path):
    write_tokens(spark.createDataFrame([(i, "a b c", 1, "x") for i in range(50)], SCHEMA), str(tmp_path / "f"), PATH, 2, block=64)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)  # as for a file too large for Spark's estimates
    try:
        plan = read_tokens(spark, str(tmp_path / "f"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
