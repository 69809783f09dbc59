"""Markdown and plain-text blocks -> nodes, and nodes -> text again (row-local)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import WS, append, buffer, buffered, let, strip
from quire.functions.html import MARKUP
from quire.functions.text import (
    LINE_END, decode_entities, inline_html, legacy_inline_html, paragraph_blocks, split_lines,
)

# The block grammar.
FENCE_OPEN = r"^\s*(`{3,}|~{3,})([^`]*)\z"
FENCE_LINE = r"(?s)^\s*(`{3,}|~{3,})(.*)\z"
HEADING = rf"(?Us)^(#{{1,6}}){WS}+(.+)\z"
LIST_ITEM = rf"(?Us)^({WS}*(?:[-+*]|\d+[.)]){WS}+)(.+)\z"
QUOTE_PREFIX = rf"(?U)^{WS}*>{WS}?"
CODE_SPAN = "(?s)^`([^`\n]+)`\\z"
CHAPTER_LINE = rf"(?Ui)^CHAPTER{WS}+\d+{WS}*:{WS}*.+\z"
CONVERTER_MIN_BLOCKS = 8
CONVERTER_MIN_FENCES = 8
CONVERTER_RATIO = 0.35

NODE_FIELDS = (
    "kind:string,tag:string,html:string,marker:string,code_wrapper:string,fence_open:string,fence_close:string,"
    "fence_info:string,fence_group:int,fence_pos:int,fence_count:int,suppress_fence:boolean"
)


def markdown_blocks(text: Column) -> Column:
    """Blank-line blocks with fenced regions kept whole; a closer must equal its opener.

    The fold over the lines records block ranges only; texts are cut afterwards.
    """

    def state(blocks, pos, start, fence):
        return F.struct(
            blocks.alias("blocks"), pos.alias("pos"), start.cast("int").alias("start"), fence.alias("fence")
        )

    kind = "array<struct<first:int,stop:int>>"
    zero = state(buffer(kind), F.lit(0), F.lit(-1), F.lit(None).cast("string"))

    def flushed(acc: Column, stop: Column) -> Column:
        block = F.struct(acc["start"].alias("first"), stop.cast("int").alias("stop"))
        return F.when(acc["start"] >= 0, append(acc["blocks"], F.array(block), kind)).otherwise(acc["blocks"])

    def step(acc: Column, line: Column) -> Column:
        nxt = acc["pos"] + 1
        opener = F.regexp_extract(line, FENCE_OPEN, 1)
        bare = strip(line)
        return (
            F.when(acc["fence"].isNotNull() & (bare == acc["fence"]),
                   state(flushed(acc, nxt), nxt, F.lit(-1), F.lit(None).cast("string")))
            .when(acc["fence"].isNotNull(), state(acc["blocks"], nxt, acc["start"], acc["fence"]))
            .when(opener != "", state(flushed(acc, acc["pos"]), nxt, acc["pos"], opener))
            .when(bare == "", state(flushed(acc, acc["pos"]), nxt, F.lit(-1), acc["fence"]))
            .when(acc["start"] >= 0, state(acc["blocks"], nxt, acc["start"], acc["fence"]))
            .otherwise(state(acc["blocks"], nxt, acc["pos"], acc["fence"]))
        )

    return let(
        split_lines(text),
        lambda lines: F.transform(
            F.aggregate(lines, zero, step, lambda acc: buffered(flushed(acc, acc["pos"]))),
            lambda b: strip(F.array_join(F.slice(lines, b["first"] + 1, b["stop"] - b["first"]), "\n")),
        ),
    )


def _fence(lines: Column) -> Column:
    """(marker, info, ok) of a block's first line; ok when the last line closes it."""
    marker = F.regexp_extract(lines[0], FENCE_LINE, 1)
    info = strip(F.regexp_extract(lines[0], FENCE_LINE, 2))
    last = F.element_at(lines, -1)
    ok = (marker != "") & (F.size(lines) >= 2) & (strip(last) == marker)
    return F.struct(marker.alias("marker"), info.alias("info"), ok.alias("ok"))


def is_converter_text(blocks: Column) -> Column:
    """Many unlabelled fences around ordinary prose: the mark of a PDF-to-Markdown converter."""

    def unlabelled(block: Column) -> Column:
        return let(
            split_lines(block),
            lambda ls: (F.size(ls) >= 3)
            & F.rlike(ls[0], F.lit(rf"(?U)^{WS}*(`{{3,}}|~{{3,}}){WS}*\z"))
            & (strip(F.element_at(ls, -1)) == strip(ls[0])),
        )

    def flag(bs: Column) -> Column:
        fences = F.size(F.filter(bs, unlabelled))
        return (
            (F.size(bs) >= CONVERTER_MIN_BLOCKS)
            & (fences >= CONVERTER_MIN_FENCES)
            & (fences / F.size(bs) >= CONVERTER_RATIO)
        )

    return let(blocks, flag)


def _node(kind, tag, inner, **meta) -> Column:
    none_str, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")

    def fields(t: Column) -> Column:
        return F.struct(
            kind.alias("kind"),
            t.alias("tag"),
            F.concat(F.lit("<"), t, F.lit(">"), inner, F.lit("</"), t, F.lit(">")).alias("html"),
            meta.get("marker", none_str).alias("marker"),
            meta.get("code_wrapper", none_str).alias("code_wrapper"),
            meta.get("fence_open", none_str).alias("fence_open"),
            meta.get("fence_close", none_str).alias("fence_close"),
            meta.get("fence_info", none_str).alias("fence_info"),
            meta.get("fence_group", none_int).cast("int").alias("fence_group"),
            meta.get("fence_pos", none_int).cast("int").alias("fence_pos"),
            meta.get("fence_count", none_int).cast("int").alias("fence_count"),
            meta.get("suppress_fence", F.lit(False)).alias("suppress_fence"),
        )

    return let(tag, fields).cast(f"struct<{NODE_FIELDS}>")


def _fence_nodes(lines: Column, fence: Column, group: Column, converter: Column, split_headings: Column) -> Column:
    inner_lines = F.filter(
        F.transform(F.slice(lines, F.lit(2), F.size(lines) - 2), strip), lambda ln: ln != ""
    )
    common = {
        "fence_open": strip(lines[0]),
        "fence_close": strip(F.element_at(lines, -1)),
        "suppress_fence": converter & (fence["info"] == ""),
    }
    body = strip(F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n"))
    joined = F.when(fence["info"] != "", body).otherwise(F.regexp_replace(body, f"(?U){WS}*\n{WS}*", " "))

    def choose(chapter_lines: Column) -> Column:
        headings = (
            split_headings
            & (fence["info"] == "")
            & (F.size(chapter_lines) > 1)
            & F.forall(chapter_lines, lambda ln: F.rlike(ln, F.lit(CHAPTER_LINE)))
        )
        per_line = F.transform(
            chapter_lines,
            lambda ln, i: _node(
                F.lit("fence_heading_line"), F.lit("p"), inline_html(ln),
                fence_group=group, fence_pos=i, fence_count=F.size(chapter_lines), **common,
            ),
        )
        whole = F.array(
            _node(F.lit("fence"), F.lit("p"), inline_html(joined), fence_info=fence["info"], **common)
        )
        return F.when(headings, per_line).otherwise(whole)

    return let(inner_lines, choose)


def _block_node(block: Column, lines: Column) -> Column:
    def node(kind: str, tag: Column, inner: Column, marker: Column | None = None) -> Column:
        def build(text: Column) -> Column:
            def with_code(code: Column) -> Column:
                return _node(
                    F.lit(kind), tag, inline_html(F.when(code != "", code).otherwise(text)),
                    code_wrapper=F.when(code != "", F.lit("`")),
                    **({} if marker is None else {"marker": marker}),
                )

            return let(F.regexp_extract(text, CODE_SPAN, 1), with_code)

        return let(inner, build)

    level = F.length(F.regexp_extract(block, HEADING, 1))
    unquoted = F.array_join(F.transform(lines, lambda ln: F.regexp_replace(ln, QUOTE_PREFIX, "")), "\n")
    is_quote = F.forall(lines, lambda ln: (strip(ln) == "") | F.rlike(ln, F.lit(QUOTE_PREFIX)))
    # Most blocks start with a letter: one look at the first character settles them.
    special = F.rlike(block, F.lit(r"(?U)^[#>*+\-\d]"))
    marked = let(
        level,
        lambda n: F.when(
            n > 0,
            node("heading", F.concat(F.lit("h"), n.cast("string")), strip(F.regexp_extract(block, HEADING, 2))),
        ).otherwise(
            let(
                F.regexp_extract(block, LIST_ITEM, 1),
                lambda item: F.when(
                    item != "", node("list_item", F.lit("li"), strip(F.regexp_extract(block, LIST_ITEM, 2)), item)
                )
                .when(is_quote, node("blockquote", F.lit("blockquote"), unquoted))
                .otherwise(node("paragraph", F.lit("p"), block)),
            )
        ),
    )
    return F.when(special, marked).otherwise(node("paragraph", F.lit("p"), block))


def markdown_nodes(blocks: Column, version: Column) -> Column:
    """Classify Markdown blocks; chapter-title fences split and converter fences drop by version."""

    def all_nodes(bs: Column, converter: Column) -> Column:
        return F.flatten(
            F.transform(
                bs,
                lambda block, i: let(
                    split_lines(block),
                    lambda lines: let(
                        _fence(lines),
                        lambda fence: F.when(
                            fence["ok"], _fence_nodes(lines, fence, i, converter, version >= 4)
                        ).otherwise(F.array(_block_node(block, lines))),
                    ),
                ),
            )
        )

    return let(
        blocks, lambda bs: let((version >= 5) & is_converter_text(bs), lambda conv: all_nodes(bs, conv))
    )


def plain_nodes(text: Column) -> Column:
    return F.transform(paragraph_blocks(text), lambda b: _node(F.lit("paragraph"), F.lit("p"), inline_html(b)))


def legacy_nodes(text: Column, is_markdown: Column) -> Column:
    """The oldest rule set: blank-line blocks, headings only, fences are ordinary text."""

    def node(block: Column) -> Column:
        level = F.when(is_markdown, F.length(F.regexp_extract(block, HEADING, 1))).otherwise(F.lit(0))
        tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise(F.lit("p"))
        inner = F.when(level > 0, strip(F.regexp_extract(block, HEADING, 2))).otherwise(block)
        kind = F.when(level > 0, F.lit("heading")).otherwise(F.lit("paragraph"))
        return _node(kind, tag, legacy_inline_html(inner))

    return F.transform(paragraph_blocks(F.regexp_replace(text, LINE_END, "\n")), node)


def text_nodes(text: Column, is_markdown: Column, version: Column) -> Column:
    """Nodes of a text or Markdown document under the rule set of its parser version."""
    return (
        F.when(version < 3, legacy_nodes(text, is_markdown))
        .when(is_markdown, markdown_nodes(markdown_blocks(text), version))
        .otherwise(plain_nodes(text))
    )


def rendered_text(html: Column) -> Column:
    """Translated node HTML -> text: line breaks and code spans restored, other tags dropped."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>(?:</br>)?", "\n")
    text = F.regexp_replace(text, r"(?is)<code\b[^>]*>(.*?)</code>", "`$1`")
    return strip(decode_entities(F.regexp_replace(text, MARKUP, "")))


def rendered_node(html: Column, node: dict[str, Column], is_markdown: Column) -> Column:
    """One node as Markdown or plain text, without its fence lines."""
    text = rendered_text(html)
    wrapper = F.coalesce(node["code_wrapper"], F.lit(""))

    def shape(t: Column) -> Column:
        wrapped = F.concat(wrapper, t, wrapper)
        quoted = F.array_join(
            F.transform(
                split_lines(wrapped),
                lambda ln: F.when(ln == "", F.lit(">")).otherwise(F.concat(F.lit("> "), ln)),
            ),
            "\n",
        )
        hashes = F.concat(F.repeat(F.lit("#"), F.substring(node["tag"], 2, 1).cast("int")), F.lit(" "))
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(~is_markdown, wrapped)
            .when(node["kind"] == "fence", t)
            .when(node["kind"] == "fence_heading_line", wrapped)
            .when(node["kind"] == "list_item", F.concat(F.coalesce(node["marker"], F.lit("- ")), wrapped))
            .when(node["kind"] == "blockquote", quoted)
            .when(F.rlike(node["tag"], F.lit("^h[1-6]$")), F.concat(hashes, wrapped))
            .otherwise(wrapped)
        )

    return let(text, shape)
