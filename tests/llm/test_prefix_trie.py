from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quire.llm.prefix_trie import coded_turns, conversation_trie, prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, `a` string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def originals(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def model(convs):
    """Every node by a plain dictionary of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        own = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    return sorted(
        (
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, cs in members.items()
    )


def order(rows):
    return sorted(rows, key=str)


def some(seed, convs=300, long=40):
    """Many copies of one conversation, deep copies, common openings, nulls, one-turn conversations, empty texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        kind = rng.random()
        if kind < 0.3:
            turns = [("user", "hello"), ("assistant", "hé"), ("user", None)]
        elif kind < 0.4:
            turns = [("user", "hello")] + [(rng.choice(["user", None]), f"deep {k // 30}") for k in range(rng.choice([long, long - 1, 2 * long]))]
        else:
            turns = [("user", rng.choice(["hello", "x", ""]))] + [(rng.choice("ua"), f"t{rng.randrange(2)}") for _ in range(rng.randrange(12))]
        conv = c * rng.choice([1, 1, 7]) - 20
        rows += [(conv + 10_000 * (conv in {r[0] for r in rows}), None if k == 0 and c % 2 else k, *t, 1, "d", "z") for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows + [(None, 1, "user", "nobody", 1, None, None)]


@pytest.mark.parametrize("band, shard", [(512, 32 << 20), (512, 2000), (4, 3000), (7, 32 << 20)])
def test_against_model(spark, band, shard):
    rows = some(band)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), band=band, shard_bytes=shard)
    assert got.columns == list(NAMES)
    assert order(tuple(r) for r in got.collect()) == order(model(originals(rows)))


def test_rebuilt_against_model(spark):
    rows = [r for r in some(5, 200, 30) if r[0] is None or r[0] >= 0]
    coded = coded_turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text").cache()
    got = prefix_trie(*rebuilt(coded), band=8, shard_bytes=3000)
    assert order(tuple(r) for r in got.collect()) == order(model(rebuild(originals(rows))))


def test_registered_query(spark):
    from quire.llm.queries import op11_prefix_trie

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11_prefix_trie(spark, "/root/testdata/sf0.001")
    assert order(tuple(r) for r in got.collect()) == order(model(rebuild(originals(rows))))


def test_empty_and_turnless(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # Conversations 1 to 4 without conversation 0: those with h of one or more lose their only turn.
    rows = [(c, 0, "user", "x", 1, "", "") for c in range(1, 5)]
    coded = coded_turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text").cache()
    got = prefix_trie(*rebuilt(coded))
    assert order(tuple(r) for r in got.collect()) == order(model(rebuild(originals(rows))))


def test_places_of_a_conversation_over_many_tasks(spark):
    """One conversation with nearly all turns, sorted in many ranges."""
    df = spark.range(5000).selectExpr("if(id % 50 = 0, id, 7) conv_id", "id turn", "'u' role", "cast(id as string) text")
    coded = coded_turns(df, "conv_id", "turn", "role", "text")
    own = [r["pos"] for r in coded.where("conv = 7").collect()]
    assert sorted(own) == list(range(4900))
    assert coded.where("conv <> 7 and pos <> 0").count() == 0
