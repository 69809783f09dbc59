"""Token estimate, escaping and block splitting for plain text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import NON_WS, WS, let, replace_all, strip_part
from quire.params import CHARS_PER_TOKEN, FREQUENT_REFERENCES, TOKENS_PER_WORD

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def tokens_from(chars: Column, words: Column) -> Column:
    """The estimate from two counts, so that folds need not rebuild strings."""
    return F.greatest(
        F.floor(chars / F.lit(CHARS_PER_TOKEN)), F.floor(words * F.lit(TOKENS_PER_WORD))
    ).cast("int")


def estimate_tokens(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(f"(?U){NON_WS}+"))
    return F.coalesce(tokens_from(F.length(text), words), F.lit(0))


def escape_html(text: Column) -> Column:
    """Escape the five markup characters."""
    return replace_all(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"})


def escape_text(text: Column) -> Column:
    """Escape only what is markup in element content."""
    return replace_all(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def _named_references() -> Column:
    """Name -> characters of all named references, from the standard library's table, frequent ones first.

    A constant of the plan; a map is searched from its start, and only for a name that occurs.
    """
    names = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
    ordered = {n: names[n] for n in FREQUENT_REFERENCES} | names
    return F.from_json(F.lit(json.dumps(ordered)), "map<string,string>")


def decode_entities(text: Column) -> Column:
    """Decode character references, each once: ``&amp;lt;`` becomes ``&lt;``.

    Numeric references outside Unicode, and surrogates, become U+FFFD; unknown names stay.
    """

    def character(ref: Column) -> Column:
        hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
        digits = F.when(hexadecimal, F.substr(ref, F.lit(3))).otherwise(F.substr(ref, F.lit(2)))
        short = F.regexp_replace(digits, "^0+", "")
        digits = F.when(short == "", "0").otherwise(F.substring(short, 1, 7))
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        real = (F.length(short) <= 7) & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def part(p: Column) -> Column:
        """What follows an ampersand: a reference and the text behind it, or just text."""

        def resolved(ref: Column) -> Column:
            known = F.when(F.startswith(ref, F.lit("#")), character(ref)).otherwise(
                F.try_element_at(_named_references(), ref)
            )
            tail = F.substr(p, F.length(ref) + 2)
            return F.when((ref != "") & known.isNotNull(), F.concat(known, tail)).otherwise(F.concat(F.lit("&"), p))

        return let(F.regexp_extract(p, "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1), resolved)

    def decode(t: Column) -> Column:
        parts = F.split(t, "&")
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), part)
        return F.when(F.contains(t, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(t)

    return let(text, decode)


def inline_html(text: Column) -> Column:
    """Escape, then turn `code` spans and newlines into markup."""
    spans = F.regexp_replace(escape_html(text), "`([^`\n]+)`", "<code>$1</code>")
    return F.replace(spans, F.lit("\n"), F.lit("<br/>"))


def legacy_inline_html(text: Column) -> Column:
    """The older rule: escape and newlines only."""
    return F.replace(escape_html(text), F.lit("\n"), F.lit("<br/>"))


def paragraph_blocks(text: Column) -> Column:
    """Blank-line separated blocks, stripped, empties dropped."""
    parts = F.transform(F.split(text, f"(?U)\n{WS}*\n"), strip_part)
    return F.filter(parts, lambda b: b != "")


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def sentence_parts(text: Column) -> Column:
    """Sentences for packing: white space after an end mark, or newlines, separates."""
    parts = F.transform(F.split(text, f"(?U)(?<=[.!?…]){WS}+|\n+"), strip_part)
    return F.filter(parts, lambda s: s != "")
