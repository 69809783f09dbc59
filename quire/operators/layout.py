"""Page-layout tables (spans and images) -> blocks, roles and nodes.

Spans are grouped per page block, which is small by nature, and everything about a
block is computed inside its row. Document-wide facts (body size, repeated margins)
are pre-aggregated counts joined back on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import let, lstrip_part, rstrip_part, slices, squeeze, squeeze_part, strip, strip_part
from quire.functions.html import inner_html
from quire.functions.prefix import running_sum
from quire.functions.text import escape_text
from quire.session import settle

# Layout thresholds and patterns.
PAGE_NUMBER = r"(?Ui)^\s*(?:\d{1,4}|[ivxlcdm]{1,8})(?:\s+\d{1,4})?\s*\z"
CHAPTER_WORD = r"(?Ui)^\s*(?:chapter|chapitre|part|partie|book|livre|volume|prologue|epilogue|épilogue)\b"
MARGIN_SHARE = 0.12
MARGIN_REPEATS = 3
PASSTHROUGH_RATIO = 0.52
DEFAULT_SIZE = 11.0
BOLD_FLAG, ITALIC_FLAG = 16, 2
OUTLINE_SIZE, OUTLINE_CHARS = 18, 220
KEPT_TEXT_SHARE = 0.88
BLOCK = ["doc_id", "page_num", "block_idx"]


def _block_rows(spans: DataFrame) -> DataFrame:
    """One row per page block: its spans in reading order, box and page size."""
    return spans.groupBy(*BLOCK).agg(
        F.array_sort(F.collect_list(F.struct("line_idx", "span_idx", "text", "size", "font", "flags", "color"))).alias("ss"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"),
    )


def _has_style(span: Column, flag: int, font: Column, *names: str) -> Column:
    """By the flag, or by a word in the font's name (in lower case)."""
    named = F.contains(font, F.lit(names[0])) | F.contains(font, F.lit(names[1]))
    return (span["flags"].bitwiseAND(flag) > 0) | named


def _is_bold(span: Column, font: Column) -> Column:
    return _has_style(span, BOLD_FLAG, font, "bold", "black")


def _is_italic(span: Column, font: Column) -> Column:
    return _has_style(span, ITALIC_FLAG, font, "italic", "oblique")


def _size_weights(spans: Column) -> Column:
    """(size, weight) per rounded size in first-seen order."""
    return F.transform(
        F.array_distinct(F.transform(spans, lambda s: s["size"])),
        lambda size: F.struct(
            size.alias("size"),
            F.aggregate(
                F.filter(spans, lambda s: s["size"] == size), F.lit(0), lambda a, s: a + s["weight"]
            ).alias("weight"),
        ),
    )


def _heaviest(weights: Column) -> Column:
    """Size with the largest weight; the first seen wins a tie."""
    zero = F.struct(F.lit(10.0).alias("size"), F.lit(0).alias("weight"))
    return F.aggregate(
        weights, zero, lambda best, w: F.when(w["weight"] > best["weight"], w).otherwise(best), lambda best: best["size"]
    )


def _lines(spans: Column) -> Column:
    """Non-blank lines: stripped text and styled parts whose outer ends are stripped."""

    def line(parts: Column) -> Column:
        n = F.size(parts)

        def trimmed(p: Column, i: Column) -> Column:
            left = let(p["text"], lambda text: F.when(i == 0, lstrip_part(text)).otherwise(text))
            return F.struct(
                let(left, lambda text: F.when(i == n - 1, rstrip_part(text)).otherwise(text)).alias("text"),
                p["bold"].alias("bold"), p["italic"].alias("italic"),
            )

        return F.struct(
            let(F.array_join(F.transform(parts, lambda p: p["text"]), ""), strip_part).alias("plain"),
            F.transform(parts, trimmed).alias("parts"),
        )

    ids = F.array_distinct(F.transform(spans, lambda s: s["line_idx"]))
    grouped = F.transform(ids, lambda k: let(F.filter(spans, lambda s: s["line_idx"] == k), line))
    return F.filter(grouped, lambda ln: ln["plain"] != "")


def _joined(lines: Column) -> Column:
    """Lines joined by one space; a hyphen before a lower-case start is dropped instead."""
    parts_type = "array<struct<text:string,bold:boolean,italic:boolean>>"
    zero = F.struct(F.lit("").alias("last"), F.lit("").alias("plain"), F.array().cast(parts_type).alias("parts"))
    space = F.array(F.struct(F.lit(" ").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))

    def step(acc: Column, ln: Column) -> Column:
        hyphen = acc["last"].endswith("-") & F.rlike(ln["plain"], F.lit(r"^\p{Ll}"))
        n = F.size(acc["parts"])
        tail = F.element_at(acc["parts"], -1)
        cut = F.struct(
            F.substr(tail["text"], F.lit(1), F.length(tail["text"]) - 1).alias("text"),
            tail["bold"].alias("bold"), tail["italic"].alias("italic"),
        )
        dehyphened = F.concat(F.slice(acc["parts"], F.lit(1), n - 1), F.array(cut), ln["parts"])
        plain = (
            F.when(n == 0, ln["plain"])
            .when(hyphen, F.concat(F.substr(acc["plain"], F.lit(1), F.length(acc["plain"]) - 1), ln["plain"]))
            .otherwise(F.concat(acc["plain"], F.lit(" "), ln["plain"]))
        )
        parts = F.when(n == 0, ln["parts"]).when(hyphen, dehyphened).otherwise(F.concat(acc["parts"], space, ln["parts"]))
        return F.struct(ln["plain"].alias("last"), plain.alias("plain"), parts.alias("parts"))

    return F.aggregate(lines, zero, step)


def _inner(parts: Column) -> Column:
    """Styled parts -> inline HTML; neighbours of one style are merged first."""

    def merged(ps: Column) -> Column:
        indexed = F.transform(ps, lambda p, i: F.struct(i.cast("int").alias("i"), p["bold"].alias("b"), p["italic"].alias("t")))
        starts = F.transform(
            F.filter(
                indexed,
                lambda x: (x["i"] == 0)
                | (F.get(ps, x["i"] - 1)["bold"] != x["b"]) | (F.get(ps, x["i"] - 1)["italic"] != x["t"]),
            ),
            lambda x: x["i"],
        )

        def styled(group: Column) -> Column:
            text = escape_text(F.array_join(F.transform(group, lambda p: p["text"]), ""))
            em = F.when(F.get(group, F.lit(0))["italic"], F.concat(F.lit("<em>"), text, F.lit("</em>"))).otherwise(text)
            return F.when(F.get(group, F.lit(0))["bold"], F.concat(F.lit("<strong>"), em, F.lit("</strong>"))).otherwise(em)

        first = F.get(ps, F.lit(0))
        alike = F.forall(ps, lambda p: (p["bold"] == first["bold"]) & (p["italic"] == first["italic"]))
        # Most blocks are of one style and need no cutting.
        return F.when(alike, styled(ps)).otherwise(F.array_join(F.transform(slices(ps, starts), styled), ""))

    return let(F.filter(parts, lambda p: p["text"] != ""), merged)


def pdf_candidates(spans: DataFrame) -> DataFrame:
    """Text blocks with plain text, inline HTML, dominant size, style flags and signature.

    Each step is bound once inside the row; blank blocks leave through the empty
    array of the generator, so no filter can pull the folds in a second time.
    """

    def usable(ss: Column) -> Column:
        cleaned = F.transform(
            ss,
            lambda s: let(
                F.struct(F.replace(s["text"], F.lit("\xa0"), F.lit(" ")).alias("text"), F.lower(s["font"]).alias("font")),
                lambda v: F.struct(
                    s["line_idx"].alias("line_idx"),
                    v["text"].alias("text"),
                    (F.rint(s["size"] * 2) / 2).alias("size"),
                    F.greatest(F.lit(1), F.length(strip_part(v["text"]))).alias("weight"),
                    _is_bold(s, v["font"]).alias("bold"),
                    _is_italic(s, v["font"]).alias("italic"),
                ),
            ),
        )
        return F.filter(cleaned, lambda s: s["text"] != "")

    def weights(us: Column) -> Column:
        """(all, bold, italic) weight in one pass."""
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("bold"), F.lit(0).alias("italic"))
        add = lambda acc, s, flag: acc + F.when(flag, s["weight"]).otherwise(0)
        return F.aggregate(
            us, zero,
            lambda a, s: F.struct(
                (a["total"] + s["weight"]).alias("total"),
                add(a["bold"], s, s["bold"]).alias("bold"),
                add(a["italic"], s, s["italic"]).alias("italic"),
            ),
        )

    def described(us: Column, joined: Column, plain: Column) -> Column:
        return let(
            F.struct(_size_weights(us).alias("sizes"), weights(us).alias("w")),
            lambda f: F.struct(
                plain.alias("plain_text"),
                _inner(joined["parts"]).alias("inner_html"),
                F.lower(plain).alias("signature"),
                f["sizes"].alias("size_weights"),
                _heaviest(f["sizes"]).alias("font_size"),
                ((f["w"]["total"] > 0) & (f["w"]["bold"] >= f["w"]["total"] * 0.55)).alias("mostly_bold"),
                ((f["w"]["total"] > 0) & (f["w"]["italic"] >= f["w"]["total"] * 0.65)).alias("mostly_italic"),
            ),
        )

    candidate = let(
        usable(F.col("ss")),
        lambda us: let(
            _joined(_lines(us)),
            lambda joined: let(
                let(joined["plain"], squeeze_part),
                lambda plain: F.when(plain != "", F.array(described(us, joined, plain))),
            ),
        ),
    )
    width = F.col("x1") - F.col("x0")
    centered = (F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_w") / 2) <= 18) & (width < F.col("page_w") * 0.72)
    box = ["x0", "y0", "x1", "y1", "page_w", "page_h"]
    return _block_rows(spans).select(*BLOCK, *box, centered.alias("centered"), F.explode(candidate).alias("c")).select(
        *BLOCK, *box, "centered", "c.*"
    )


def pdf_body_size(candidates: DataFrame) -> DataFrame:
    """Size with the largest character weight per document; the first seen wins a tie."""
    sizes = candidates.select("doc_id", "page_num", "block_idx", F.posexplode("size_weights").alias("i", "w"))
    per_size = sizes.groupBy("doc_id", F.col("w.size").alias("size")).agg(
        F.sum("w.weight").alias("weight"), F.min(F.struct("page_num", "block_idx", "i")).alias("seen")
    )
    rank = F.struct("weight", -F.col("seen.page_num"), -F.col("seen.block_idx"), -F.col("seen.i"))
    return per_size.groupBy("doc_id").agg(F.coalesce(F.max_by("size", rank), F.lit(DEFAULT_SIZE)).alias("body_size"))


def repeated_margins(candidates: DataFrame) -> DataFrame:
    in_margin = (F.col("y0") < F.col("page_h") * MARGIN_SHARE) | (F.col("y1") > F.col("page_h") * (1 - MARGIN_SHARE))
    return (
        candidates.where(in_margin).groupBy("doc_id", "signature").agg(F.count("*").alias("n"))
        .where(F.col("n") >= MARGIN_REPEATS).select("doc_id", "signature")
    )


def pdf_margin_repeats(candidates: DataFrame) -> DataFrame:
    """Blocks without running heads and feet; every block with such a signature goes, wherever it sits."""
    return candidates.join(repeated_margins(candidates), ["doc_id", "signature"], "left_anti")


def is_page_number(text: Column) -> Column:
    return F.rlike(text, F.lit(PAGE_NUMBER))


def pdf_page_numbers(candidates: DataFrame) -> DataFrame:
    return candidates.where(~is_page_number(F.col("plain_text")))


def pdf_page_profile(pages: DataFrame, candidates: DataFrame, images: DataFrame) -> DataFrame:
    """Per page: text, images, clipped image share, passthrough.

    ``pages``: doc_id, page_num, page_w, page_h; ``images``: doc_id, page_num, x0..y1.
    """
    page = ["doc_id", "page_num"]
    clip = lambda lo, hi, size: F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(size)) - F.greatest(F.col(lo), F.lit(0.0)))
    # Both tables are read once. ``clip`` of a page without images would be the whole page.
    area = pages.join(images.withColumn("image", F.lit(True)), page, "left").groupBy(*page, "page_w", "page_h").agg(
        F.sum(F.when(F.col("image"), clip("x0", "x1", "page_w") * clip("y0", "y1", "page_h"))).alias("image_area")
    )
    with_text = candidates.select(*page).distinct().withColumn("has_text", F.lit(True))
    image_area = F.coalesce("image_area", F.lit(0.0))
    ratio = F.least(F.lit(1.0), image_area / F.greatest(F.lit(1.0), F.col("page_w") * F.col("page_h")))
    has_text = F.coalesce("has_text", F.lit(False))
    return area.join(with_text, page, "left").select(
        *page, has_text.alias("has_text"), (image_area > 0).alias("has_images"), ratio.alias("image_ratio"),
        ((~has_text & (image_area > 0)) | (ratio >= PASSTHROUGH_RATIO)).alias("passthrough"),
    )


def block_facts(candidates: DataFrame) -> DataFrame:
    """What roles, margins and numbers are told by, in place of the plain text.

    A signature longer than its digest is known by the digest, so that texts need not move to be compared.
    """
    long_one = F.concat(F.lit("\n"), F.sha2("signature", 256))
    return candidates.select(
        *BLOCK, "y0", "y1", "page_h", "centered", "size_weights", "font_size", "mostly_bold", "inner_html",
        F.when(F.length("signature") > 64, long_one).otherwise(F.col("signature")).alias("signature"),
        *[fact.alias(name) for name, fact in _role_facts().items()],
        is_page_number(F.col("plain_text")).alias("page_number"),
    )


def _role_facts() -> dict[str, Column]:
    return {"short": F.length("plain_text") <= 180, "chapter": F.rlike("plain_text", F.lit(CHAPTER_WORD))}


def roles_of(facts: DataFrame) -> DataFrame:
    """Add ``tag`` and ``role`` by size ratio to the document body size."""
    sized = facts.join(pdf_body_size(facts), "doc_id")
    size, body, short, chapter = F.col("font_size"), F.col("body_size"), F.col("short"), F.col("chapter")
    top = (
        (size >= body * 1.45) | (chapter & (size >= body * 1.30)) | (F.col("mostly_bold") & (size >= body * 1.20) & short)
    )
    second = F.col("centered") & short & ((size >= body * 1.07) | chapter)
    return sized.withColumns(
        {
            "tag": F.when(top, "h1").when(second, "h2").otherwise("p"),
            "role": F.when(top, "chapter").when(second & chapter, "toc").when(second, "section").otherwise("body"),
        }
    )


def pdf_roles(candidates: DataFrame) -> DataFrame:
    """Candidates with ``body_size``, ``tag`` and ``role``."""
    return roles_of(candidates.withColumns(_role_facts())).drop("short", "chapter")


def pdf_nodes(spans: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """Spans and images -> ordered nodes: numbers, running heads and passthrough pages left out."""
    # Four facts are taken from the blocks; they are built once and read back column by column.
    blocks = settle(block_facts(pdf_candidates(spans)), "candidates")
    # All that is told by the facts is told without the texts, which meet what is left of their blocks at the end.
    facts = blocks.drop("inner_html")
    skipped = pdf_page_profile(pages, facts, images).where("passthrough").select("doc_id", "page_num")
    left = pdf_margin_repeats(roles_of(facts).where(~F.col("page_number"))).join(skipped, ["doc_id", "page_num"], "left_anti")
    kept = settle(left.select(*BLOCK, "tag", "role"), "kept-blocks")
    return _with_node_index(kept).join(blocks.select(*BLOCK, "inner_html"), BLOCK).select(
        *BLOCK, "node_idx", "tag", "role",
        F.concat(F.lit("<"), "tag", F.lit(">"), "inner_html", F.lit("</"), "tag", F.lit(">")).alias("html"),
    )


def _with_node_index(blocks: DataFrame) -> DataFrame:
    """Dense index per document from page counts: rank inside the page plus blocks of earlier pages."""
    from pyspark.sql import Window

    counts = blocks.groupBy("doc_id", "page_num").agg(F.count("*").alias("_n"))
    upto = running_sum(counts, ["doc_id"], "page_num", F.col("_n"), "_upto")
    inside = Window.partitionBy("doc_id", "page_num").orderBy("block_idx")
    return blocks.join(upto, ["doc_id", "page_num"]).withColumn(
        "node_idx", (F.row_number().over(inside) - 1 + F.col("_upto") - F.col("_n")).cast("int")
    ).drop("_n", "_upto")


def pdf_nodes_legacy(spans: DataFrame) -> DataFrame:
    """The oldest rule set: mean size chooses the tag, dominant colour and alignment are kept."""
    usable = F.filter("ss", lambda s: s["text"] != "")
    ids = F.array_distinct(F.transform("us", lambda s: s["line_idx"]))
    line = lambda k: strip(
        F.array_join(F.transform(F.filter("us", lambda s: s["line_idx"] == k), lambda s: s["text"]), "")
    )
    text = strip(F.array_join(F.filter(F.transform(ids, line), lambda t: t != ""), " "))
    size = F.aggregate("us", F.lit(0.0), lambda a, s: a + s["size"]) / F.size("us")
    color = F.get(
        F.array_sort(
            F.transform(
                F.array_distinct(F.transform("us", lambda s: s["color"])),
                lambda c: F.struct((-F.size(F.filter("us", lambda s: s["color"] == c))).alias("n"), c.alias("c")),
            )
        ),
        F.lit(0),
    )["c"]
    middle, width = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0")
    align = (
        F.when((F.abs(middle - F.col("page_w") / 2) < 35) & (width < F.col("page_w") * 0.85), "center")
        .when(F.col("x0") > F.col("page_w") * 0.6, "right")
        .otherwise("left")
    )
    legacy_bold = lambda s: (s["flags"].bitwiseAND(BOLD_FLAG) > 0) | F.contains(F.lower(s["font"]), F.lit("bold"))
    out = (
        _block_rows(spans).withColumn("us", usable).where(F.size("us") > 0)
        .withColumns({"text": text, "font_size": size, "color": color, "align": align})
        .where((F.col("text") != "") & ~is_page_number(F.col("text")))
        .withColumn("tag", F.when(F.col("font_size") >= 15, "h1").when(F.col("font_size") >= 12.5, "h2").otherwise("p"))
    )
    return out.select(
        *BLOCK, "font_size", "color", "align",
        F.exists("us", legacy_bold).alias("is_bold"), F.exists("us", lambda s: _is_italic(s, F.lower(s["font"]))).alias("is_italic"), "tag",
        F.concat(F.lit("<"), "tag", F.lit(">"), escape_text(F.col("text")), F.lit("</"), "tag", F.lit(">")).alias("html"),
    )


def pdf_outline(spans: DataFrame) -> DataFrame:
    """Table of contents: blocks with a large span and a bounded title."""
    blocks = _block_rows(spans).where(F.array_max(F.transform("ss", lambda s: s["size"])) >= OUTLINE_SIZE)
    title = squeeze(F.array_join(F.transform("ss", lambda s: s["text"]), " "))
    return blocks.select(*BLOCK, F.lit(1).alias("level"), title.alias("title")).where(
        (F.col("title") != "") & (F.length("title") <= OUTLINE_CHARS)
    )


def export_loss_check(rebuilt: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: was text lost on export? Lengths are summed, texts are never concatenated.

    ``rebuilt``: doc_id, page_num, text, passthrough; ``expected``: doc_id, text.
    """

    def joined_length(text: Column) -> tuple[Column, Column]:
        n = F.length(squeeze(text))
        return F.sum(n), F.count_if(n > 0)

    got_sum, got_n = joined_length(F.coalesce("text", F.lit("")))
    got = rebuilt.groupBy("doc_id").agg(
        got_sum.alias("got_chars"), got_n.alias("got_parts"),
        F.bool_or(F.contains("text", F.lit("�"))).alias("bad_chars"),
        F.bool_or(~F.col("passthrough") & (strip(F.coalesce("text", F.lit(""))) == "")).alias("empty_page"),
    )
    want_sum, want_n = joined_length(F.col("text"))
    want = expected.groupBy("doc_id").agg(want_sum.alias("want_chars"), want_n.alias("want_parts"))
    length = lambda side: F.coalesce(F.col(f"{side}_chars"), F.lit(0)) + F.greatest(F.coalesce(F.col(f"{side}_parts"), F.lit(0)) - 1, F.lit(0))
    problem = (
        F.when(F.col("got_parts").isNull(), "no page")
        .when(F.col("empty_page"), "empty page")
        .when(F.col("bad_chars"), "invalid characters")
        .when((length("want") > 0) & (length("got") < length("want") * KEPT_TEXT_SHARE), "text lost")
    )
    return want.join(got, "doc_id", "full").select(
        "doc_id", length("want").alias("expected_chars"), length("got").alias("rebuilt_chars"), problem.alias("problem")
    )


def role_markup(html: Column, role: Column) -> Column:
    """Translated block with the tag and class of its role; block attributes are dropped."""
    open_tag = (
        F.when(role == "chapter", '<h1 class="chapter-title">')
        .when(role == "toc", '<h2 class="toc-entry">')
        .when(role == "section", '<h2 class="section-title">')
        .otherwise("<p>")
    )
    close_tag = F.when(role == "chapter", "</h1>").when(role.isin("toc", "section"), "</h2>").otherwise("</p>")
    return F.concat(open_tag, inner_html(html), close_tag)
