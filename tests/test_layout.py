"""Layout operators on small tables: what the block table holds, and odd blanks, styles and heads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions.core import squeeze, squeeze_part
from quire.operators import layout as L
from quire.plans import layout_queries as Q

SPANS = (
    "doc_id long, page_num int, block_idx int, line_idx int, span_idx int, text string, size double, font string, flags int, "
    "color int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
)
HEAD = "A running head that is " + "very " * 12 + "long"


def span(page, block, line, pos, text, size=11.0, font="Serif", flags=0, y0=300.0):
    return (1, page, block, line, pos, text, size, font, flags, 0, 50.0, y0, 450.0, y0 + 10, 500.0, 700.0)


def document(spark):
    rows = []
    for page in range(1, 4):
        rows += [
            span(page, 0, 0, 0, HEAD if page < 3 else HEAD.upper(), y0=10.0),
            span(page, 1, 0, 0, " Body  text\tof é & "), span(page, 1, 0, 1, "bold", font="Serif-SEMIBOLD"),
            span(page, 1, 1, 0, f"page {page} "), span(page, 2, 0, 0, HEAD + " of its own" * page, y0=10.0),
            span(page, 3, 0, 0, f" {page} "),
        ]
    rows.append(span(2, 4, 0, 0, "Chapter one", size=17.24, flags=16))
    spans = spark.createDataFrame(rows, SPANS)
    pages = spark.createDataFrame([(1, p, 500.0, 700.0) for p in range(1, 5)], "doc_id long, page_num int, page_w double, page_h double")
    images = spark.createDataFrame([(1, 3, 0.0, 0.0, 500.0, 700.0), (1, 9, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_num int, x0 double, y0 double, x1 double, y1 double")
    return spans, pages, images


@pytest.mark.parametrize("text", [
    "", " ", "a b", " a  b ", "a\tb", "a b", "　a", "a\x1cb", "a\x85", "你 好", "a b", "[x] ^-&& \\ éÿ", "\U0001f600 x",
])
def test_squeeze_part_is_squeeze(value, text):
    from quire.functions.core import let

    assert value(lambda t: let(t, squeeze_part), text) == value(squeeze, text) == " ".join(text.split())


def test_nodes_of_a_document(spark):
    nodes = L.pdf_nodes(*document(spark)).orderBy("node_idx").collect()
    body = "<p>Body  text\tof é &amp; <strong>bold</strong> page {}</p>"
    assert [(n["page_num"], n["block_idx"], n["node_idx"], n["role"]) for n in nodes] == [
        (1, 1, 0, "body"), (1, 2, 1, "body"), (2, 1, 2, "body"), (2, 2, 3, "body"), (2, 4, 4, "chapter"),
    ]
    assert nodes[0]["html"] == body.format(1) and nodes[2]["html"] == body.format(2)
    assert nodes[3]["html"] == f"<p>{HEAD} of its own of its own</p>"
    assert nodes[4]["html"] == "<h1><strong>Chapter one</strong></h1>"


def test_page_profile_counts_images_of_known_pages_only(spark):
    spans, pages, images = document(spark)
    rows = L.pdf_page_profile(pages, L.pdf_candidates(spans), images).orderBy("page_num").collect()
    assert [(r["page_num"], r["has_text"], r["has_images"], r["image_ratio"], r["passthrough"]) for r in rows] == [
        (1, True, False, 0.0, False), (2, True, False, 0.0, False), (3, True, True, 1.0, True), (4, False, False, 0.0, False),
    ]


@pytest.fixture
def stored(monkeypatch):
    tables, settle = [], L.settle

    def kept(df, *args):
        tables.append(settle(df, *args))
        return tables[-1]

    monkeypatch.setattr(L, "settle", kept)
    monkeypatch.setattr(Q, "settle", kept)
    return tables


def test_nodes_store_each_text_once(spark, stored):
    L.pdf_nodes(*document(spark)).collect()
    texts = [(t, f.name) for t in stored for f in t.schema if f.dataType.simpleString() == "string"]
    longest = {name: t.select(F.max(F.length(name))).head()[0] for t, name in texts}
    assert longest.pop("inner_html") > 100
    assert max(longest.values()) <= 65, longest


def test_role_markup_stores_each_text_once(spark, stored, monkeypatch):
    monkeypatch.setattr(Q, "spans", lambda *_: document(spark)[0])
    rows = Q.role_markup(spark, "").collect()
    assert len(rows) == 13
    assert [f.name for t in stored for f in t.schema if f.dataType.simpleString() == "string"] == ["inner_html"]
