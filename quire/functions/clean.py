"""Cleaning model answers and checking their structure (row-local)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import WS, let, squeeze, strip, strip_part
from quire.functions.html import checked_blocks, inline_tags, sanitize_block

# Answer patterns.
_BLOCK_ELEMENT = (
    r"(?is)<(?:p|h[1-6]|li|blockquote|caption|figcaption)[^>]*>.*?"
    r"</(?:p|h[1-6]|li|blockquote|caption|figcaption)>"
)
_FENCED = r"(?is)^```(?:html|xml|markdown)?\s*\n?(.*?)\n?```\z"
_STUTTER = rf"(?Ui)\b([a-zA-Z]{{3,15}})\b{WS}+\1\b{WS}+\1\b"
SIGNIFICANT_CHARS = 6
_REASONING_MARKS = ("<think>", "<thought>", "[thinking]")


def unclosed_think(text: Column) -> Column:
    """Resolve an opener that never closes: complete blocks win, else the text around it."""

    def resolve(t: Column) -> Column:
        blocks = F.regexp_extract_all(t, F.lit(_BLOCK_ELEMENT), F.lit(0))
        parts = F.split(t, "(?i)<think>")
        around = F.when(strip(parts[0]) != "", parts[0]).otherwise(F.element_at(parts, -1))
        around = F.replace(F.replace(around, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
        return let(blocks, lambda bs: F.when(F.size(bs) > 0, F.array_join(bs, "\n")).otherwise(around))

    return F.when(F.contains(F.lower(text), F.lit("<think>")), let(text, resolve)).otherwise(text)


def strip_reasoning(text: Column) -> Column:
    for opener, closer in (("<think>", "</think>"), ("<thought>", "</thought>"), (r"\[THINKING\]", r"\[/THINKING\]")):
        text = F.regexp_replace(text, f"(?is){opener}.*?{closer}", "")
    return text


def clean_response(text: Column) -> Column:
    """Drop reasoning regions, unwrap one code fence, strip. Most answers have neither, and are searched for the marks only."""

    def unwrap(t: Column) -> Column:
        inner = F.when(F.rlike(t, F.lit(_FENCED)), F.regexp_extract(t, _FENCED, 1)).otherwise(t)
        opened = F.regexp_replace(strip(inner), "^```(?:html|xml)?", "")
        return strip(F.regexp_replace(strip(opened), r"```\z", ""))

    text = F.coalesce(text, F.lit(""))
    thoughts = let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(mark)) for mark in _REASONING_MARKS]))
    answer = F.when(thoughts, strip(unclosed_think(strip_reasoning(text)))).otherwise(strip_part(text))
    return let(answer, lambda t: F.when(F.startswith(t, F.lit("```")) | F.endswith(t, F.lit("```")), unwrap(t)).otherwise(t))


def collapse_stutter(text: Column) -> Column:
    """A word said three or more times in a row becomes one, followed by a newline, wherever it occurs."""

    def collapse(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_STUTTER), F.lit(1))
        # Replacing a word is idempotent, so only its last mention in the list matters.
        words = F.reverse(F.array_distinct(F.reverse(found)))

        def replace(acc: Column, word: Column) -> Column:
            pattern = F.concat(F.lit(r"(?Ui)\b"), word, F.lit(rf"\b(?:{WS}+|\b"), word, F.lit(r"\b)*+"))
            return F.regexp_replace(acc, pattern, F.concat(word, F.lit("\n")))

        return F.aggregate(words, t, replace)

    return F.when(text.isNull(), text).otherwise(let(text, collapse))


def _normal(piece: Column) -> Column:
    return squeeze(F.lower(F.regexp_replace(piece, "<[^>]*>", "")))


def _without_repeats(entries: Column, render, removed) -> Column:
    """Resolve consecutive repeats among *significant* entries in O(n log n).

    ``entries`` holds (pos, piece, tail, norm). A significant entry (long enough
    ``norm``) repeats when its predecessor among the significant ones has the same
    norm; short entries in between do not break the run.
    """
    significant = F.filter(entries, lambda e: F.length(e["norm"]) > SIGNIFICANT_CHARS)
    others = F.filter(entries, lambda e: F.length(e["norm"]) <= SIGNIFICANT_CHARS)

    def out(e: Column, text: Column, keep: Column) -> Column:
        return F.struct(e["pos"].alias("pos"), text.alias("text"), keep.alias("keep"))

    marked = let(
        significant,
        lambda xs: F.transform(
            xs,
            lambda e, i: let(
                (i > 0) & (F.get(xs, i - 1)["norm"] == e["norm"]),
                lambda dup: out(e, F.when(dup, removed(e)).otherwise(render(e)), ~dup),
            ),
        ),
    )
    plain = F.transform(others, lambda e: out(e, render(e), F.lit(True)))
    return F.array_sort(F.concat(marked, plain))


def dedupe_sentences(text: Column) -> Column:
    """Drop a sentence equal to the last significant one; separators stay."""
    sep = rf"(?U)(?<=[.!?]){WS}+|\n+"
    seps = F.regexp_extract_all(text, F.lit(sep), F.lit(0))

    def entries(ss: Column) -> Column:
        return F.transform(
            F.split(text, sep),
            lambda p, i: F.struct(
                i.alias("pos"), p.alias("piece"), F.coalesce(F.get(ss, i), F.lit("")).alias("tail"),
                _normal(p).alias("norm"),
            ),
        )

    resolved = let(
        let(seps, entries),
        lambda es: _without_repeats(es, lambda e: F.concat(e["piece"], e["tail"]), lambda e: e["tail"]),
    )
    return F.array_join(F.transform(resolved, lambda r: r["text"]), "")


def _dedupe_pieces(pieces: Column, sep: str, norm) -> Column:
    entries = F.transform(
        pieces, lambda p, i: F.struct(i.alias("pos"), p.alias("piece"), F.lit("").alias("tail"), norm(p).alias("norm"))
    )
    resolved = let(entries, lambda es: _without_repeats(es, lambda e: e["piece"], lambda e: e["piece"]))
    return F.array_join(F.transform(F.filter(resolved, lambda r: r["keep"]), lambda r: r["text"]), sep)


def dedupe_lines(text: Column) -> Column:
    return _dedupe_pieces(F.split(text, "\n"), "\n", _normal)


def dedupe_paragraphs(text: Column) -> Column:
    """The same rule on ``</p>`` pieces; blank pieces vanish unless equal to the last piece."""

    def run(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        kept = F.filter(parts, lambda p: (strip(p) != "") | (p == last))
        return _dedupe_pieces(kept, "</p>", _normal)

    return F.when(F.contains(text, F.lit("</p>")), let(F.split(text, "</p>"), run)).otherwise(text)


def verify_structure(source: Column, answer: Column) -> Column:
    """(ok, reason, repaired) for a cleaned answer against its source.

    Equal block count, equal tag per position and equal inline-tag sequence per
    block are required. ``repaired`` carries no attributes and only allowed tags.
    Repetition in the answer is never removed here.
    """

    def verdict(ok, reason, repaired):
        return F.struct(ok.alias("ok"), reason.alias("reason"), repaired.cast("string").alias("repaired"))

    def fail(reason: Column) -> Column:
        return verdict(F.lit(False), reason, F.lit(None))

    def compare(src: Column, ans: Column) -> Column:
        pairs = F.transform(
            F.arrays_zip(src.alias("s"), ans.alias("a")),
            lambda p, i: F.struct(
                (i + 1).alias("pos"),
                p["s"]["tag"].alias("want"),
                p["a"]["tag"].alias("got"),
                F.array_join(inline_tags(p["s"]["html"]), ",").alias("want_inline"),
                F.array_join(inline_tags(p["a"]["html"]), ",").alias("got_inline"),
            ),
        )
        bad = F.filter(pairs, lambda p: (p["want"] != p["got"]) | (p["want_inline"] != p["got_inline"]))
        return let(
            bad,
            lambda bs: F.when(
                F.size(bs) == 0,
                verdict(
                    F.lit(True), F.lit(None).cast("string"),
                    F.array_join(F.transform(ans, lambda b: sanitize_block(b["html"])), "\n"),
                ),
            )
            .when(
                bs[0]["want"] != bs[0]["got"],
                fail(F.concat(F.lit("tag at block "), bs[0]["pos"], F.lit(": "), bs[0]["want"], F.lit(" expected, "),
                              bs[0]["got"], F.lit(" received"))),
            )
            .otherwise(fail(F.concat(F.lit("inline tags at block "), bs[0]["pos"]))),
        )

    def check(cleaned: Column) -> Column:
        plain_source = ~F.contains(source, F.lit("<")) & ~F.contains(source, F.lit(">"))
        # Bound side by side: the analyzer needs some passes for every level of bindings, and has a limit of 100.
        blocks = let(
            F.struct(checked_blocks(source).alias("s"), checked_blocks(cleaned).alias("a")),
            lambda p: F.when(
                F.size(p["s"]) != F.size(p["a"]),
                fail(F.concat(F.lit("blocks: "), F.size(p["s"]), F.lit(" expected, "), F.size(p["a"]), F.lit(" received"))),
            ).otherwise(compare(p["s"], p["a"])),
        )
        return (
            F.when(cleaned == "", fail(F.lit("empty")))
            .when(plain_source, verdict(F.lit(True), F.lit(None).cast("string"), cleaned))
            .otherwise(blocks)
        )

    return let(clean_response(answer), check)
