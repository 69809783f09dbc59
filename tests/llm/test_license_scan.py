from __future__ import annotations

import random
import re

import pytest

import quire.llm.license_scan as L
from quire.llm.queries import op13_license_scan

SCHEMA = "doc_id long, text string, n_words string, `row` string"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    """(n_words, n_base, first, last, labels) by comparing lists of words."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def some(n=400):
    rng = random.Random(4)
    bits = ["GNU", "General", "Public", "License", "Apache", "MIT", "license", "CC", "by", "É", "mit", "x1", "", "cc-by", "\x85", "日本"]
    gaps = [" ", "  ", "\n", "-", ", ", "_", "\x7f", "[", " ", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(80))) for _ in range(n)]
    return texts + ["The GNU General Public License, version 3.", "cc by cc by mit license MIT LICENSE", "", None, " \n\t", "submit license", "MIT licenses"]


def check(row):
    want = base(row["text"])
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == want
    assert set(filter(None, want[4].split(","))) <= set(row["labels"].split(","))
    assert row["labels"] == ",".join(sorted(set(filter(None, row["labels"].split(",")))))
    assert 0 <= row["score"] <= 1 and (row["score"] > 0) == (row["labels"] != "")


def test_base_against_model(spark):
    rows = [(i % 300, t, "n", "r") for i, t in enumerate(some())] * 2
    got = L.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(5), ["doc_id", "text", "n_words"])
    found = [r.asDict() | r["row"].asDict() | {"n_words": r["n_words"]} for r in got.collect()]
    assert len(found) == len(rows)
    for r in found:
        check(r)
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_windows_change_nothing(monkeypatch):
    texts = [t or "" for t in some(60)]
    whole = [L.Scanner()(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(L, "WINDOW", size)
        assert [L.Scanner()(t) for t in texts] == whole


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_license_scan(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        check(r.asDict() | {"text": texts[r["doc_id"]]})
    assert sum(r["n_base"] for r in got) > 10


@pytest.mark.parametrize(
    "line, postfix, labels, terms",
    [
        ("MIT", "mit", "mit", "permissive"),
        ("MIT OR Apache-2.0", "mit apache-2.0 or", "apache,mit", "permissive"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only classpath-exception-2.0 with", "gpl", "weak copyleft"),
        ("MIT OR GPL-3.0-or-later AND BSD-3-Clause", "mit gpl-3.0-or-later bsd-3-clause and or", "bsd,gpl,mit", "permissive"),
        ("(MIT OR GPL-3.0+) AND MPL-2.0", "mit gpl-3.0+ or mpl-2.0 and", "gpl,mit,mpl", "weak copyleft"),
        ("GPL-2.0 AND LGPL-2.1 WITH x", "gpl-2.0 lgpl-2.1 x with and", "gpl,lgpl", "copyleft"),
        ("((AGPL-3.0))", "agpl-3.0", "agpl", "restricted"),
        ("LicenseRef-own", "licenseref-own", "licenseref-own", "unknown"),
        ("MIT. Or see the file", "mit", "mit", "permissive"),
        ("MIT the following text", "mit", "mit", "permissive"),
        ("MIT AND (GPL-2.0", "mit", "mit", "permissive"),
        ("MIT AND", "mit", "mit", "permissive"),
        ("MIT) OR GPL-2.0", "mit", "mit", "permissive"),
        (" \t CC-BY-SA-4.0 */", "cc-by-sa-4.0", "cc-by,cc-by-sa", "copyleft"),  # the words "cc by" are a base phrase
    ],
)
def test_expressions(line, postfix, labels, terms):
    found = L.Scanner()(f"# SPDX-License-Identifier: {line}\nMore text.")
    assert [(e["postfix"], e["terms"]) for e in found["expressions"]] == [(postfix, terms)]
    assert found["labels"] == labels and found["score"] > 0.9


@pytest.mark.parametrize("line", ["", " AND MIT", "( )", ")", "WITH", "..."])
def test_no_expression(line):
    assert L.Scanner()(f"SPDX-License-Identifier: {line}\nMIT")["expressions"] == []


def test_tags_must_be_written_as_such():
    assert L.Scanner()("the spdx license identifier MIT")["labels"] == ""
    two = L.Scanner()("spdx-license-identifier: MIT\n// SPDX-License-Identifier : ISC\nlicense-expression: MPL-2.0")
    assert two["labels"] == "isc,mit,mpl" and len(two["expressions"]) == 3


def test_notices():
    found = L.Scanner()("Licensed under CC BY-NC 4.0. Mozilla Public\nLicense. All rights reserved.")
    assert found["base_labels"] == "cc-by" and found["labels"] == "all-rights-reserved,cc-by,cc-by-nc,mpl"
