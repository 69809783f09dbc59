from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from quire.llm.exact_dedup import exact_dedup, mark_exact

SCHEMA = "doc_id long, text string, kept string, digest int"


def rows_of(n=400, hot=150):
    rng = random.Random(3)
    out = [(i, rng.choice(["Same TEXT É", "same text É", "same text é"]), "x", 1) for i in range(hot)]
    out += [(i, f"t{rng.randrange(n)}", None, None) for i in range(hot, n)]
    return out + [(None, "same text É", "y", 2), (None, None, None, None), (n, "", None, 3), (n, "", None, 3)]


def model(rows):
    groups = defaultdict(list)
    for r in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        groups[hashlib.sha256(folded.encode()).hexdigest()].append(r[0])
    return groups


def check(spark, filter_bytes):
    rows = rows_of()
    got = mark_exact(spark.createDataFrame(rows, SCHEMA).repartition(5), ["doc_id", "kept"], filter_bytes=filter_bytes).collect()
    groups = model(rows)
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r["text_sha256"]].append(r)
    assert set(seen) == set(groups)
    for sha, members in seen.items():
        ids = groups[sha]
        best = max((i for i in ids if i is not None), default=None)
        assert {(m["keep_id"], m["group_size"]) for m in members} == {(best, len(ids))}
        stay = [m for m in members if m["kept"]]
        assert [m["row"]["doc_id"] for m in stay] == [best]
        assert sorted(map(str, ids)) == sorted(str(m["row"]["doc_id"]) for m in members)


def test_against_model(spark):
    check(spark, 128 << 20)


def test_hash_ranges_give_the_same(spark):
    check(spark, 1)


def test_empty_table_and_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mark_exact(empty, ["doc_id"]).count() == 0
    kept = exact_dedup(spark.createDataFrame(rows_of(), SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept", "digest"]
    assert kept.count() == len(model(rows_of()))


def test_many_ranges(spark):
    """More rows than one segment holds, with a filter limit that forces several ranges."""
    df = spark.range(150_000).selectExpr("id doc_id", "cast(id % 140000 as string) text", "'' kept", "1 digest")
    kept = mark_exact(df, ["doc_id"], filter_bytes=1).where("kept")
    assert kept.count() == 140_000
    assert kept.where("group_size = 2").count() == 10_000
