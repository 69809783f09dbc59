"""HTML on columns: tokens, block extraction, attribute and tag rules.

A page is one row, so everything here is a narrow, row-local expression; no
shuffle and no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import let, strip
from quire.functions.text import decode_entities
from quire.params import ACTIVE_TAGS, BLOCK_TAGS, INLINE_TAGS, VOID_TAGS

_ATTRS = r"""(?:[^"'>]++|"[^"]*"|'[^']*')*+"""
# One alternative per token kind; script and style carry their raw content.
TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script[^>]*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|<[!?][^>]*>"
    r"|</[a-z][^>]*>"
    rf"|<[a-z]{_ATTRS}>"
    r"|[^<]+|<"
)
MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?(?:</script[^>]*>|\z)|<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    rf"|<[!?][^>]*>|</[a-z][^>]*>|<[a-z]{_ATTRS}>"
)
_BLOCK_ALT = "|".join(sorted(BLOCK_TAGS, key=len, reverse=True))
BLOCK_NAME = rf"(?i)<({_BLOCK_ALT})(?=[\s/>])"
# Blocks side by side, of text, line breaks and inline tags without attributes that hold text: what segments are made of.
_INLINE_ALT = "|".join(sorted((t for t in INLINE_TAGS if t not in VOID_TAGS), key=len, reverse=True))
FLAT_BLOCK = rf"<({_BLOCK_ALT})>(?:[^<]++|<br/>|<({_INLINE_ALT})>[^<]*+</\2>)*+</\1>"
FLAT = rf"\A(?:[^<]++|{FLAT_BLOCK})*+\z"


def drop_active_content(html: Column) -> Column:
    """Remove script, style, iframe, object and embed together with their content."""
    for tag in ACTIVE_TAGS:
        if tag in VOID_TAGS:
            html = F.regexp_replace(html, rf"(?is)</?{tag}\b{_ATTRS}>", "")
        else:
            html = F.regexp_replace(html, rf"(?is)<{tag}\b{_ATTRS}>.*?(?:</{tag}\s*>|\z)", "")
    return html


def strip_attributes(html: Column) -> Column:
    """Drop every attribute; a closing slash and quoted ``>`` are respected."""
    return F.regexp_replace(
        html,
        r"""<([a-zA-Z][^\s/>"']*)(?:[^"'>/]++|"[^"]*"|'[^']*'|/(?!>))*+(/?)>""",
        "<$1$2>",
    )


def readable_text(html: Column) -> Column:
    """Reading text: a tag becomes a space, script and style vanish with their content."""
    raw = r"<\s*(?:script[^>]*>.*?(?:</script[^>]*(?:>|\z)|\z)|style[^>]*>.*?(?:</style[^>]*(?:>|\z)|\z))"
    pieces = F.regexp_extract_all(html, F.lit(rf"(?is){raw}|<[^>]*>|[^<]+|<"), F.lit(0))
    text = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(F.rlike(p, F.lit(r"(?is)^<\s*(?:script|style)[^>]*>")), F.lit(""))
            .when(F.rlike(p, F.lit(r"(?s)^<[^>]*>")), F.lit(" "))
            .otherwise(p),
        ),
        "",
    )
    blank = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, rf"\n{blank}", "\n")
    return F.regexp_replace(F.regexp_replace(text, rf"^{blank}", ""), rf"{blank}\z", "")


def node_text(html: Column) -> Column:
    """Text of a node: every string stripped, joined by one space."""
    parts = F.transform(F.split(html, MARKUP), lambda s: strip(decode_entities(s)))
    return F.array_join(F.filter(parts, lambda s: s != ""), " ")


def node_strings(html: Column) -> Column:
    """Text of a node with nothing inserted between strings."""
    return decode_entities(F.regexp_replace(html, MARKUP, ""))


def joined_text(html: Column) -> Column:
    return strip(node_strings(html))


def node_tag(html: Column) -> Column:
    """Block tag of a node, ``p`` when there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(html, BLOCK_NAME, 1)), F.lit("")), F.lit("p"))


def inner_html(html: Column) -> Column:
    """Content between the outer tags of a single-block string."""
    return F.regexp_replace(F.regexp_replace(html, rf"(?is)^\s*<[a-z]{_ATTRS}>", ""), r"(?is)</[a-z][^>]*>\s*\z", "")


def inline_tags(html: Column, names: tuple[str, ...] = INLINE_TAGS) -> Column:
    """Ordered names of the inline tags opened in ``html``."""
    alt = "|".join(sorted(names, key=len, reverse=True))
    found = F.regexp_extract_all(
        F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(rf"(?i)<({alt})(?=[\s/>])"), F.lit(1)
    )
    return F.transform(found, F.lower)


def _tokens(html: Column) -> Column:
    """Token structs: kind (o open, c close, v void, t anything else), name, output form."""

    def token(kind: Column, name: Column, out: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"), out.alias("out"))

    def tag(tok: Column, name: Column) -> Column:
        attrs = F.regexp_extract(tok, r"(?s)^<[a-zA-Z][^\s/>]*(.*?)\s*/?>\z", 1)
        start = F.concat(F.lit("<"), name, attrs)
        return (
            F.when(tok.startswith("</"), token(F.lit("c"), name, F.concat(F.lit("</"), name, F.lit(">"))))
            .when(name.isin("script", "style"), token(F.lit("t"), name, tok))
            .when(name.isin(*VOID_TAGS), token(F.lit("v"), name, F.concat(start, F.lit("/>"))))
            .when(tok.endswith("/>"), token(F.lit("e"), name, F.concat(start, F.lit(">"))))
            .otherwise(token(F.lit("o"), name, F.concat(start, F.lit(">"))))
        )

    def typed(tok: Column) -> Column:
        plain = token(F.lit("t"), F.lit(""), tok)
        name = F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1))
        return F.when(
            tok.startswith("<"), let(name, lambda n: F.when(n != "", tag(tok, n)).otherwise(plain))
        ).otherwise(plain)

    typed_tokens = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), typed)

    def expand(t: Column) -> Column:
        opened = F.struct(F.lit("o").alias("kind"), t["name"].alias("name"), t["out"].alias("out"))
        closed = F.struct(
            F.lit("c").alias("kind"),
            t["name"].alias("name"),
            F.concat(F.lit("</"), t["name"], F.lit(">")).alias("out"),
        )
        return F.when(t["kind"] == "e", F.array(opened, closed)).otherwise(F.array(t))

    return F.flatten(F.transform(typed_tokens, expand))


_STACK = "array<struct<name:string,start:int,nested:boolean>>"
_BLOCKS = "array<struct<start:int,stop:int,tag:string,nested:boolean,tail:string>>"
_PATCHES = "array<struct<pos:int,out:string>>"


#: Tokens per chunk: about the square root of a large page's number of tokens.
CHUNK = 128


def chunked(items: Column) -> Column:
    """An array as an array of chunks."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k + 1, CHUNK))


def _closers(entries: Column) -> Column:
    return F.array_join(
        F.transform(F.reverse(entries), lambda e: F.concat(F.lit("</"), e["name"], F.lit(">"))), ""
    )


def _closed_blocks(popped: Column, pos: Column) -> Column:
    """Block records for the popped stack entries (bottom first)."""
    placed = F.filter(F.transform(popped, lambda e, k: F.struct(e.alias("e"), k.alias("k"))), lambda x: x["e"]["start"] >= 0)
    return F.transform(
        placed,
        lambda x: F.struct(
            x["e"]["start"].alias("start"),
            pos.cast("int").alias("stop"),
            x["e"]["name"].alias("tag"),
            x["e"]["nested"].alias("nested"),
            _closers(F.slice(popped, x["k"] + 1, F.size(popped) - x["k"])).alias("tail"),
        ),
    )


def block_spans(html: Column, nested: bool = True) -> Column:
    """All block elements of a page, nested ones flagged, or with ``nested=False`` those in no other block.

    A fold copies what it has gathered at every step, so none gathers more than one chunk of
    tokens does. A first pass over the chunks keeps the stack of open tags before each of them
    (and the number of open blocks in it); then every chunk is folded on its own, from its stack,
    to its closed blocks as token ranges and the few end tags that do not close exactly one
    element ("patches"). HTML strings are cut from the tokens afterwards. End-tag rule: an end tag
    that is not open is ignored, otherwise every element above its match is closed with it.
    """
    is_block = lambda name: name.isin(*BLOCK_TAGS)
    none = lambda kind: F.array().cast(kind)

    def state(pos, stack, open_blocks):
        return [pos.cast("int").alias("pos"), stack.alias("stack"), open_blocks.cast("int").alias("open")]

    def opened(acc: Column, t: Column) -> list[Column]:
        counts = is_block(t["name"]) if nested else is_block(t["name"]) & (acc["open"] == 0)
        entry = F.struct(
            t["name"].alias("name"),
            F.when(counts, acc["pos"]).otherwise(F.lit(-1)).alias("start"),
            (acc["open"] > 0).alias("nested"),
        )
        return state(acc["pos"] + 1, F.concat(acc["stack"], F.array(entry)), acc["open"] + counts.cast("int"))

    def match(acc: Column, t: Column) -> tuple[Column, Column, Column]:
        """(number of elements that an end tag closes, these, blocks among them)."""
        stack = acc["stack"]
        top = F.get(stack, F.size(stack) - 1)
        own = F.coalesce(top["name"] == t["name"], F.lit(False))
        n = F.when(own, F.lit(1)).otherwise(F.array_position(F.transform(F.reverse(stack), lambda e: e["name"]), t["name"]).cast("int"))
        popped = F.when(own, F.array(top)).otherwise(F.slice(stack, F.size(stack) - n + 1, n))
        return n, popped, F.size(F.filter(popped, lambda e: e["start"] >= 0))

    def closed(acc: Column, t: Column) -> list[Column]:
        n, _, blocks = match(acc, t)
        return state(acc["pos"] + 1, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - n), acc["open"] - blocks)

    def other(acc: Column) -> list[Column]:
        return state(acc["pos"] + 1, acc["stack"], acc["open"])

    def move(acc: Column, t: Column) -> Column:
        return (
            F.when(t["kind"] == "o", F.struct(*opened(acc, t))).when(t["kind"] == "c", F.struct(*closed(acc, t)))
            .otherwise(F.struct(*other(acc)))
        )

    def gather(acc: Column, t: Column) -> Column:
        kept = [acc["blocks"].alias("blocks"), acc["patches"].alias("patches")]
        n, popped, blocks = match(acc, t)
        found = [
            F.when(blocks > 0, F.concat(acc["blocks"], _closed_blocks(popped, acc["pos"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(n == 1, acc["patches"]).otherwise(
                F.concat(acc["patches"], F.array(F.struct(acc["pos"].alias("pos"), F.when(n == 0, F.lit("")).otherwise(_closers(popped)).alias("out"))))
            ).alias("patches"),
        ]
        return (
            F.when(t["kind"] == "o", F.struct(*opened(acc, t), *kept)).when(t["kind"] == "c", F.struct(*closed(acc, t), *found))
            .otherwise(F.struct(*other(acc), *kept))
        )

    def stacks(chunks: Column) -> Column:
        """(before: the state in front of each chunk, now: the state at the end)."""
        start = F.struct(*state(F.lit(0), none(_STACK), F.lit(0)))
        zero = F.struct(none(f"array<struct<pos:int,stack:{_STACK},open:int>>").alias("before"), start.alias("now"))
        return F.aggregate(
            chunks, zero,
            lambda acc, chunk: F.struct(
                F.concat(acc["before"], F.array(acc["now"])).alias("before"), F.aggregate(chunk, acc["now"], move).alias("now")
            ),
        )

    def folded(chunks: Column, states: Column) -> Column:
        def one(chunk: Column, k: Column) -> Column:
            at = F.get(states["before"], k)
            zero = F.struct(*state(at["pos"], at["stack"], at["open"]), none(_BLOCKS).alias("blocks"), none(_PATCHES).alias("patches"))
            return F.aggregate(chunk, zero, gather, lambda acc: F.struct(acc["blocks"].alias("blocks"), acc["patches"].alias("patches")))

        return let(
            F.transform(chunks, one),
            lambda xs: F.struct(
                F.concat(F.flatten(F.transform(xs, lambda x: x["blocks"])), _closed_blocks(states["now"]["stack"], states["now"]["pos"])).alias("blocks"),
                F.flatten(F.transform(xs, lambda x: x["patches"])).alias("patches"),
            ),
        )

    def outputs(tokens: Column, patches: Column) -> Column:
        plain = F.transform(
            tokens, lambda t, i: F.struct(i.cast("int").alias("pos"), F.lit(1).alias("prio"), t["out"].alias("out"))
        )
        patched = F.transform(
            patches, lambda p: F.struct(p["pos"].alias("pos"), F.lit(0).alias("prio"), p["out"].alias("out"))
        )
        merged = let(
            F.array_sort(F.concat(plain, patched)),
            lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1)["pos"] != x["pos"])),
        )
        return F.transform(F.when(F.size(patches) == 0, plain).otherwise(merged), lambda x: x["out"])

    def between(chunks: Column, start: Column, stop: Column) -> Column:
        """Tokens ``start`` to ``stop``; a slice copies the array it is cut from, so it is cut from few chunks."""
        first = F.floor(start / CHUNK).cast("int")
        count = F.floor((stop - 1) / CHUNK).cast("int") - first + 1
        return F.slice(F.flatten(F.slice(chunks, first + 1, count)), start - first * CHUNK + 1, stop - start)

    def cut(tokens: Column, folded: Column) -> Column:
        return let(
            let(outputs(tokens, folded["patches"]), chunked),
            lambda chunks: F.transform(
                F.array_sort(folded["blocks"]),
                lambda b: F.struct(
                    b["tag"].alias("tag"),
                    b["nested"].alias("nested"),
                    F.concat(F.array_join(between(chunks, b["start"], b["stop"]), ""), b["tail"]).alias("html"),
                ),
            ),
        )

    def spans(tokens: Column) -> Column:
        parts = let(chunked(tokens), lambda chunks: let(stacks(chunks), lambda states: folded(chunks, states)))
        return let(parts, lambda found: cut(tokens, found))

    return let(_tokens(html), spans)


def top_blocks(html: Column) -> Column:
    """Top-level blocks in document order: array of (block_idx, tag, html)."""
    return F.transform(
        block_spans(html, nested=False), lambda b, i: F.struct(i.cast("int").alias("block_idx"), b["tag"].alias("tag"), b["html"].alias("html"))
    )


def _flat_blocks(html: Column) -> Column:
    """``top_blocks`` of a text that is ``FLAT``: its blocks stand in it as they are."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(FLAT_BLOCK), F.lit(0)),
        lambda b, i: F.struct(
            i.cast("int").alias("block_idx"), F.substring_index(F.substr(b, F.lit(2)), ">", 1).alias("tag"), b.alias("html")
        ),
    )


def checked_blocks(html: Column) -> Column:
    """Top-level blocks after dropping active content: what a model answer is compared on.

    Most segments are flat and need no stack of open tags; any other text is folded.
    """
    return let(
        F.coalesce(html, F.lit("")),
        lambda h: F.when(F.rlike(h, F.lit(FLAT)), _flat_blocks(h)).otherwise(top_blocks(drop_active_content(h))),
    )


def sanitize_block(html: Column) -> Column:
    """Drop all attributes and unwrap tags outside the allow-list."""
    allowed = "|".join(sorted(BLOCK_TAGS + INLINE_TAGS, key=len, reverse=True))
    return F.regexp_replace(strip_attributes(html), rf"(?i)</?(?!(?:{allowed})[\s/>])[a-zA-Z][^>]*>", "")
