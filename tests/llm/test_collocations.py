from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from quire.llm.collocations import collocations, phrase_counts
from quire.llm.queries import op12_collocations

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def counted(rows, longest=3):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def model(rows, top=2000, least=10, longest=3):
    counts, totals = counted(rows, longest)
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                dropped |= {q for i in range(len(p) - k + 1) if (q := p[i : i + k]) in candidates and 100 * a >= 50 * candidates[q]}
        for p, a in candidates.items():
            if p in dropped:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def some(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["new", "york", "City", "São", "paulo", "the", "of", "a", "ünder", "x" * 40]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([["New", "York", "City"], ["são", "paulo"], ["São", "Paulo"], [rng.choice(vocabulary)], [f"w{rng.randrange(500)}"]])
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\r\n", "\x0b"]))
        text = "".join(w if not w.strip(" \t\n\r\x0b.,;") else w + " " for w in words)
        rows.append((i % 350, text, rng.choice(["en", "en", "en", "de", None, "und", ""]), 1, "p"))
    return rows + [(None, None, "en", None, None), (1, "", None, 1, ""), (2, " \t\n. ", "en", 2, None), (3, "only here", "fr", 2, None)]


@pytest.mark.parametrize("how", [{}, {"shards": 1}, {"shards": 30, "filter_bits": 1 << 18}, {"least": 3, "longest": 5}, {"least": 25, "longest": 2, "top": 3}])
def test_against_model(spark, how):
    rows = some(len(how))
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(7), **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == model(rows, **{k: v for k, v in how.items() if k not in ("shards", "filter_bits")})


def test_counts_are_whole(spark):
    rows = some(9)
    counts, totals = counted(rows)
    got = {(r["lang"], r["phrase"]): r["n"] for r in phrase_counts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {(lang, " ".join(p)): n for lang, f in counts.items() for p, n in f.items() if n >= 10}
    assert got == want | {(lang, None): n for lang, n in totals.items() if n}


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    import quire.llm.collocations as c

    rng = random.Random(1)
    text = "".join(rng.choice(["alpha beta gamma", "beta gamma", "delta"]) + rng.choice([" ", " ", ". "]) for _ in range(4000))
    rows = [(1, text, "en", 1, ""), (2, "alpha beta", "en", 1, "")]
    parts = c._parts(iter([__import__("pyarrow").RecordBatch.from_pydict({"text": [text], "lang": ["en"]})]))
    monkeypatch.setattr(c, "PART_BYTES", 5000)
    pieces = [bytes(d).decode() for d, _, _ in parts]
    assert len(pieces) > 5 and "".join(pieces) == text
    assert all(p[-1] == "." for p in pieces[:-1])
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, SCHEMA)).collect())) == model(rows)


def test_scores_beyond_64_bits(spark):
    """10^6 a^2 passes 64 bits from 3,037,001 occurrences on."""
    n = 3_200_000
    df = spark.range(320).selectExpr("id doc_id", f"repeat('a b.', {n // 320}) text", "'en' lang")
    rows = [tuple(r) for r in collocations(df).collect()]
    assert rows == [("en", 1, "a b", n, n, n, 2 * n, 10**6)]


def test_registered_query_and_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, op12_collocations(spark, sf).collect())) == model(rows)
