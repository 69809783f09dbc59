from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm.line_dedup import bounded_distance, dedup_lines, line_links, mark_lines

SCHEMA = "doc_id long, text string, dropped string, n_lines int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abé🎉 "))
        elif s and i < len(s):
            if kind == 1:
                del s[i]
            else:
                s[i] = rng.choice("abé🎉 ")
    return "".join(s)


def lines(rng, n=60):
    out = []
    for _ in range(n):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(8, 90)))
        out += [base] + [edited(rng, base, rng.randrange(1, 5)) for _ in range(rng.randrange(4))]
    return [x for x in out if "\n" not in x]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé🎉") for _ in range(rng.randrange(1, 130)))
        b = edited(rng, a, rng.randrange(6)) or "x"
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    rows += [("a", ""), ("", ""), ("ab", "ba"), ("x" * 5000 + "y", "x" * 5000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for r in df.withColumn("d", bounded_distance(F.col("a"), F.col("b"), edits)).collect():
        true = len(r["a"]) - len(r["b"]) if len(r["a"]) > 1000 else distance(r["a"], r["b"])
        assert r["d"] == true if true <= edits else r["d"] > edits


@pytest.mark.parametrize("edits", [1, 2])
def test_links_match_brute_force(spark, edits):
    rng = random.Random(7)
    texts = lines(rng)
    docs = spark.createDataFrame([(i, "\n".join(texts[i::40]), "x", 1) for i in range(40)], SCHEMA).repartition(5)
    found = line_links(docs, edits=edits, min_chars=20).collect()
    name = {r["h"]: r["t"] for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select(F.unhex(F.md5(F.col("t").cast("binary"))).alias("h"), "t").collect()}
    got = {tuple(sorted((name[bytes(r["a"])], name[bytes(r["b"])]))): r["distance"] for r in found}
    long_ = sorted({t for t in texts if len(t) >= 20 and t.strip()})
    want = {}
    for i, a in enumerate(long_):
        for b in long_[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and (d := distance(a, b)) <= edits:
                want[a, b] = d
    assert got == want and len(want) > 10


def test_first_lines_stay(spark):
    rng = random.Random(3)
    pool = lines(rng, 25) + ["", " ", "short", "a" * 30, "a" * 31, "a" * 33]
    rows = [(i if i else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))), "x", 1) for i in range(60)]
    rows += [(70, None, "x", 1), (71, "", "x", 1), (72, "long " * 9000, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen: list[str] = []
    root: dict[str, str] = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = [(r[0], k, x) for r in ordered for k, x in enumerate((r[1] or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    for _, _, x in every:
        if x not in root:
            root[x] = x
            for y in seen:
                if min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                    root[find(x)] = find(y)
            seen.append(x)
    dropped, classes = {}, set()
    for i, k, x in every:
        if find(x) in classes:
            dropped.setdefault(i, []).append(k)
        classes.add(find(x))
    marked = {r["row"]["doc_id"]: r for r in mark_lines(docs, ["doc_id"]).collect()}
    assert len(marked) == len(rows)
    for i, t, *_ in rows:
        assert marked[i]["dropped"] == dropped.get(i, [])
        assert marked[i]["n_lines"] == sum(1 for e in every if e[0] == i)
    out = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    for i, t, *_ in rows:
        left = t if i not in dropped else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped[i])
        assert out[i] == left
    assert dedup_lines(docs).columns == docs.columns


def test_empty(spark):
    assert mark_lines(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
