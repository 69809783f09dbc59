from __future__ import annotations

import random
import re
from collections import Counter

from quire.llm.quality_rules import apply_rules, measured, sketches

SCHEMA = "doc_id long, text string, lang string, source string, kept int, fence string"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(wins)
    covered = {p for i, k in enumerate(wins) if c[k] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "\n\n", "één wörd x #", "a\x0bb\x0cc", "x" * 9000 + " " + "y" * 3]
    words = ["aa", "b", "ç", "dd#", "中文", "e|"]
    for _ in range(150):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 12))]
        out.append("\n".join(lines + lines[: rng.randrange(3)]))
    return out + [" ".join(f"w{i}" for i in range(40_000)), "ab " * 30_000]


def test_measures_match_brute_force(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 1, None) for i, t in enumerate(texts())]
    got = apply_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), ["doc_id", "kept"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r["row"]["doc_id"]][1])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_fences_adapt_to_the_source(spark):
    """The same share of symbols is normal in one source and an outlier in another."""
    rng = random.Random(1)
    prose = lambda n, s: " ".join(f"w{rng.randrange(9999)}" + (s if rng.random() < n else "") for _ in range(100))
    rows = [(i, prose(0.6, "#"), "en", "code", 0, "") for i in range(80)]
    rows += [(100 + i, prose(0.01, "#"), "en", "news", 0, "") for i in range(80)]
    rows += [(900, prose(0.6, "#"), "en", "news", 0, ""), (901, prose(0.6, "#"), None, None, 0, "")]
    kept = {r["row"]["doc_id"]: r["kept"] for r in apply_rules(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80))
    assert not kept[900]


def test_fences_follow_the_sizes_of_the_texts(spark):
    """Without any symbol or repeat in a group its fences come from what one event weighs; a symbol passes, many do not."""
    rng = random.Random(2)
    prose = lambda n, k: " ".join(f"w{rng.randrange(99999)}" + ("#" if i < k else "") for i in range(n))
    rows = [(i, prose(rng.randrange(35, 45), 0), "en", "short", 0, "") for i in range(80)]
    rows += [(100 + i, prose(rng.randrange(3500, 4500), 0), "en", "long", 0, "") for i in range(80)]
    rows += [(900, prose(40, 10), "en", "short", 0, ""), (901, prose(4000, 1), "en", "long", 0, ""), (902, prose(4000, 200), "en", "long", 0, "")]
    got = {r["row"]["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert all(got[i]["kept"] for i in range(80)) and all(got[100 + i]["kept"] for i in range(80))
    assert [got[i]["kept"] for i in (900, 901, 902)] == [False, True, False]
    assert got[0]["max_symbols_per_100_words"] > 20 * got[100]["max_symbols_per_100_words"] > 0


def test_equal_texts_have_fences_above_themselves(spark):
    """All quartiles equal: the fence is still above every text of the group."""
    rows = [(i, " ".join(f"w{k:02d}" for k in range(40)), "en", "s", 0, "") for i in range(60)]
    assert all(r["kept"] for r in apply_rules(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect())


def test_sketches_merge(spark):
    """Sketches of parts, added up, are the sketch of the whole."""
    rows = [(i, t, "en", "s", 0, "") for i, t in enumerate(texts())]
    sketch = lambda r: sketches(measured(spark.createDataFrame(r, SCHEMA), ["doc_id"], "text", "lang", "source"))
    counts = lambda df: {(r["measure"], r["bucket"]): r["n"] for r in df.collect()}
    parts = Counter(counts(sketch(rows[:70]))) + Counter(counts(sketch(rows[70:])))
    assert dict(parts) == counts(sketch(rows))


def test_empty_table(spark):
    assert apply_rules(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
