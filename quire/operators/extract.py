"""Documents -> ordered nodes. All operators are narrow: one input row, its nodes, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import markdown as M
from quire.functions.core import let
from quire.functions.text import paragraph_blocks
from quire.params import PARSER_VERSION


def _exploded(df: DataFrame, items: Column, keep: list[str], index: str) -> DataFrame:
    return df.select(*keep, F.posexplode(items).alias(index, "item"))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", keep_blank: bool = False) -> DataFrame:
    """Top-level blocks in document order.

    ``keep_blank=False`` is the extraction form: blank blocks are left out while
    ``block_idx`` keeps counting. ``keep_blank=True`` is the form used to compare
    answers: active content is dropped first and nothing is skipped.
    """
    blocks = H.checked_blocks(F.col(html)) if keep_blank else H.top_blocks(F.col(html))
    out = pages.select(key, F.explode(blocks).alias("b")).select(key, "b.block_idx", "b.tag", "b.html")
    return out if keep_blank else out.where(H.joined_text(F.col("html")) != "")


def html_blocks_legacy(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Every block element, nested ones included, blank ones left out."""
    out = _exploded(pages, H.block_spans(F.col(html)), [key], "block_idx")
    out = out.select(key, "block_idx", F.col("item.tag").alias("tag"), F.col("item.html").alias("html"))
    return out.where(H.joined_text(F.col("html")) != "")


def txt_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(paragraph_blocks(F.col(text))).alias("node_idx", "block"))


def md_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(M.markdown_blocks(F.col(text))).alias("block_idx", "block"))


def converter_fences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: block count and whether it is converter output."""
    return docs.select(key, let(
        M.markdown_blocks(F.col(text)),
        lambda bs: F.struct(F.size(bs).alias("blocks"), M.is_converter_text(bs).alias("converter")),
    ).alias("v")).select(key, "v.blocks", "v.converter")


def text_nodes(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    file_type: str = "file_type",
    version: Column | None = None,
) -> DataFrame:
    """Nodes of text and Markdown documents; ``version`` may be a column (one rule set per row)."""
    version = F.lit(PARSER_VERSION) if version is None else version
    nodes = M.text_nodes(F.col(text), F.col(file_type) == "md", version)
    return _exploded(docs, nodes, keep, "node_idx").select(*keep, "node_idx", "item.*")


def extract_versioned(docs: DataFrame, keep: list[str], content: str, file_type: str, version: str) -> DataFrame:
    """One extraction call for a mixed table: file type and parser version choose the rules per row."""
    none = F.lit(None)
    empty = F.array().cast(f"array<struct<{M.NODE_FIELDS}>>")

    def as_nodes(blocks: Column) -> Column:
        kept = F.filter(blocks, lambda b: H.joined_text(b["html"]) != "")
        return F.transform(
            kept,
            lambda b: F.struct(
                F.lit("block"), b["tag"], b["html"], *[none.cast("string")] * 5, *[none.cast("int")] * 3, F.lit(False)
            ).cast(f"struct<{M.NODE_FIELDS}>"),
        )

    c, v = F.col(content), F.col(version)
    is_text = F.col(file_type).isin("md", "txt")
    spans = F.when(F.col(file_type) == "epub", H.block_spans(c))
    chosen = F.filter(spans, lambda b: (v < 2) | ~b["nested"])
    nodes = (
        F.when(is_text, M.text_nodes(c, F.col(file_type) == "md", v))
        .when(F.col(file_type) == "epub", as_nodes(chosen))
        .otherwise(empty)
    )
    return _exploded(docs, nodes, keep, "node_idx").select(*keep, "node_idx", "item.kind", "item.tag", "item.html")
