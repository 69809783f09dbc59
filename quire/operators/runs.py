"""Text-run tables (word-processor paragraphs) -> nodes, and translations back onto runs.

A paragraph is a small group, so grouping by paragraph is safe at any document size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import let, strip
from quire.functions.text import escape_html

PARAGRAPH = ["doc_id", "kind", "table_idx", "row_idx", "col_idx", "par_idx"]


def _styled(run: Column) -> Column:
    text = escape_html(run["text"])
    for flag, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")):
        text = F.when(run[flag], F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)
    return text


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Dense node index per document: body first, then table, row, column, paragraph.

    Positions are counted per sort position bucket and accumulated, so a document
    with a large share of all paragraphs is not numbered by a single task.
    """
    bucketed = nodes.withColumns(
        {
            "_bucket": F.struct(F.col("kind") != "paragraph", F.coalesce("table_idx", F.lit(0)),
                                F.floor(F.coalesce("row_idx", F.lit(0)) / 1000), F.when(
                                    F.col("kind") == "paragraph", F.floor(F.col("par_idx") / 4096)).otherwise(0)),
        }
    )
    sizes = bucketed.groupBy("doc_id", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("doc_id", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("doc_id", "_bucket").orderBy(*order)
    return bucketed.join(offsets, ["doc_id", "_bucket"]).withColumn(
        "node_idx", (F.row_number().over(inside) - 1 + F.col("_offset")).cast("int")
    ).drop("_bucket", "_offset")


def docx_nodes(runs: DataFrame, legacy: bool = False) -> DataFrame:
    """Runs -> node HTML in document order.

    ``kind`` is ``paragraph`` or ``table_paragraph``. Heading styles 1-3 choose the
    tag of body paragraphs. ``legacy`` joins the paragraphs of a table cell to one
    unstyled node.
    """
    paragraphs = runs.groupBy(*PARAGRAPH).agg(
        F.array_sort(F.collect_list(F.struct("run_idx", "text", "bold", "italic", "underline"))).alias("rs"),
        F.lower(F.coalesce(F.max("style_name"), F.lit(""))).alias("style"),
    ).withColumn("plain", F.array_join(F.transform("rs", lambda r: r["text"]), ""))
    style = F.col("style")
    tag = (
        F.when(F.col("kind") != "paragraph", "p")
        .when(F.contains(style, F.lit("heading 1")), "h1")
        .when(F.contains(style, F.lit("heading 2")), "h2")
        .when(F.contains(style, F.lit("heading 3")), "h3")
        .otherwise("p")
    )
    inner = F.array_join(F.transform(F.filter("rs", lambda r: r["text"] != ""), _styled), "")
    nodes = paragraphs.select(*PARAGRAPH, "plain", tag.alias("tag"), inner.alias("inner"))
    if legacy:
        cell = ["doc_id", "kind", "table_idx", "row_idx", "col_idx"]
        cells = (
            nodes.where(F.col("kind") != "paragraph").groupBy(*cell)
            .agg(F.array_sort(F.collect_list(F.struct("par_idx", "plain"))).alias("ps"))
            .withColumn("plain", strip(F.array_join(F.transform("ps", lambda p: p["plain"]), "\n")))
            .select(*cell, F.lit(0).alias("par_idx"), "plain", F.lit("p").alias("tag"),
                    escape_html(F.col("plain")).alias("inner"))
        )
        nodes = nodes.where(F.col("kind") == "paragraph").unionByName(cells)
    kept = nodes.where(strip(F.col("plain")) != "")
    order = [F.col(c) for c in ("table_idx", "row_idx", "col_idx", "par_idx")]
    return _numbered(kept, order).select(
        *PARAGRAPH, "node_idx", "tag",
        F.concat(F.lit("<"), "tag", F.lit(">"), "inner", F.lit("</"), "tag", F.lit(">")).alias("html"),
    )


def redistributed(text: Column, lengths: Column) -> Column:
    """Cut ``text`` over runs in proportion to their source lengths, at the last space before each end."""

    def cut(t: Column, total: Column) -> Column:
        n = F.size(lengths)
        zero = F.struct(
            F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("seen"),
            F.array().cast("array<string>").alias("pieces"),
        )

        def piece(lo: Column, hi: Column) -> Column:
            return F.when(hi > lo, F.substr(t, lo + 1, hi - lo)).otherwise(F.lit(""))

        def step(acc: Column, length: Column) -> Column:
            seen = acc["seen"] + length
            ideal = F.when(
                total > 0, F.bround(F.length(t) * seen.cast("double") / total).cast("int")
            ).otherwise(F.when(acc["run"] == 0, F.length(t)).otherwise(acc["at"]))
            window = F.substr(t, acc["at"] + 1, F.greatest(ideal, acc["at"]) - acc["at"] + 1)
            space = acc["at"] + F.length(window) - F.locate(" ", F.reverse(window))
            snapped = F.when(
                (total > 0) & F.contains(window, F.lit(" ")) & (space > acc["at"]), space + 1
            ).otherwise(ideal)
            last = acc["run"] == n - 1
            # A cut behind the proportional end never moves back, or its blank would be written twice.
            end = F.greatest(F.when(last, F.length(t)).otherwise(snapped), acc["at"])
            return let(
                end,
                lambda e: F.struct(
                    e.cast("int").alias("at"), (acc["run"] + 1).alias("run"), seen.cast("int").alias("seen"),
                    F.concat(acc["pieces"], F.array(piece(acc["at"], e))).alias("pieces"),
                ),
            )

        return F.aggregate(lengths, zero, step, lambda acc: acc["pieces"])

    return let(text, lambda t: let(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), lambda total: cut(t, total)))


def redistribute_runs(runs: DataFrame, translations: DataFrame) -> DataFrame:
    """Translated paragraph text (PARAGRAPH columns + ``new_text``) spread over the source runs."""
    lengths = F.col("rs.n")
    grouped = runs.groupBy(*PARAGRAPH).agg(
        F.array_sort(F.collect_list(F.struct("run_idx", F.length("text").alias("n")))).alias("rs")
    )
    null_safe = [grouped[c].eqNullSafe(translations[c]) for c in PARAGRAPH]
    condition = null_safe[0]
    for c in null_safe[1:]:
        condition = condition & c
    joined = grouped.join(translations, condition).select(*[grouped[c] for c in PARAGRAPH], "rs", "new_text")
    pieces = let(
        redistributed(F.col("new_text"), lengths),
        lambda ps: F.transform(
            "rs", lambda r, i: F.struct(r["run_idx"].alias("run_idx"), F.get(ps, i).alias("text"))
        ),
    )
    return joined.select(*PARAGRAPH, F.explode(pieces).alias("x")).select(*PARAGRAPH, "x.run_idx", "x.text")
