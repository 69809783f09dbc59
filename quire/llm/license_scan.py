"""Licence scans: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting yard.

A text is folded, its words are joined by single blanks, and one Aho-Corasick automaton finds all
phrases in one pass, however many there are: notices, which give a label each, and the tags that
announce a licence expression. Behind a tag the original line is read: operators go through two
stacks (shunting yard; ``with`` binds closer than ``and``, ``and`` closer than ``or``), and the
result in postfix order is evaluated to the labels it names and to the strictest terms that cannot
be avoided: the mildest side of an ``or``, the strictest of an ``and``, one step milder for an
exception. An expression ends where its grammar does, so prose may follow it on the line.

Everything is local to a row; a text is scanned in windows, so that only the text itself and its
normalised copy are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_rules import _ddl
from quire.llm.text import row, slices

#: Fixed by the contract of the query: phrases and labels of the base.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices; wordings of well-known licences.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Tags in front of an expression, by their words and as they are written.
TAGS = {"spdx license identifier": b"spdx-license-identifier", "license expression": b"license-expression"}
#: Licence families by the start of an identifier, the longest that fits; and how strict their terms are.
FAMILIES = {
    "0bsd": ("bsd", 0), "agpl": ("agpl", 3), "apache": ("apache", 0), "artistic": ("artistic", 1), "bsd": ("bsd", 0),
    "bsl-1": ("bsl", 0), "cc-by": ("cc-by", 0), "cc-by-nc": ("cc-by-nc", 3), "cc-by-nd": ("cc-by-nd", 3),
    "cc-by-sa": ("cc-by-sa", 2), "cc0": ("cc0", 0), "epl": ("epl", 1), "gfdl": ("gfdl", 2), "gpl": ("gpl", 2), "isc": ("isc", 0),
    "lgpl": ("lgpl", 1), "mit": ("mit", 0), "mpl": ("mpl", 1), "unlicense": ("public-domain", 0),
}
TERMS = ("permissive", "weak copyleft", "copyleft", "restricted", "unknown")
#: How much one label is believed: named in an expression, or by a notice.
WEIGHTS = (0.95, 0.6)
PRIORITY = {"or": 1, "and": 2, "with": 3}
WINDOW = 4 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(f if f >= 128 or 48 <= f <= 57 or 97 <= f <= 122 else 32 for f in _FOLD)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")


def family(identifier: str) -> tuple[str, int]:
    """(label, strictness) of a licence identifier; an unknown one is its own label."""
    found = max((f for f in FAMILIES if identifier.startswith(f)), key=len, default=None)
    return FAMILIES[found] if found else (identifier.rstrip("+"), len(TERMS) - 1)


def postfix(line: bytes) -> list[str]:
    """The longest expression at the start of a folded line, in postfix order; empty if there is none.

    Two stacks: operators wait until one that binds less, or a bracket, comes. ``whole`` remembers
    the length of the output, and the few operators to come, at the last place where every bracket was
    closed and an operand came last.
    """
    out: list[str] = []
    waiting: list[str] = []
    whole: tuple[int, list[str]] = 0, []
    depth, operand, at = 0, True, 0
    while m := _TOKEN.match(line, at):
        token, at = m[1].decode(), m.end()
        if operand:
            if token == "(":
                waiting.append(token)
                depth += 1
                continue
            name = token.rstrip(".:-")
            if token == ")" or token in PRIORITY or not name:
                break
            out.append(name)
            operand = False
            ended = name != token  # a full stop or colon closes the expression
        elif token == ")" and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
            ended = False
        elif token in PRIORITY:
            while waiting and waiting[-1] != "(" and PRIORITY[waiting[-1]] >= PRIORITY[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
            continue
        else:
            break
        if not depth:
            whole = len(out), waiting[::-1]
        if ended:
            break
    return out[: whole[0]] + whole[1]


def evaluated(codes: list[str]) -> tuple[set[str], int]:
    """(labels, strictness) of an expression in postfix order."""
    stack: list[tuple[set[str], int]] = []
    for code in codes:
        if code not in PRIORITY:
            label, strict = family(code)
            stack.append(({label}, strict))
            continue
        right, left = stack.pop(), stack.pop()
        if code == "with":  # the right side names an exception, not a licence
            stack.append((left[0], left[1] - (0 < left[1] < len(TERMS) - 1)))
        else:
            stack.append((left[0] | right[0], (min if code == "or" else max)(left[1], right[1])))
    return stack[0]


def normal(data: bytes) -> tuple[bytes, int]:
    """The words of a text, folded, each with a blank before and behind it; and their number."""
    parts, n, start = [b""], 0, 0
    while start < len(data):
        end = start + WINDOW
        while end < len(data) and _WORDS[data[end - 1]] != 32:
            m = _GAP.search(data, end)
            end = m.end() if m else len(data)
        words = data[start:end].translate(_WORDS).split()
        n += len(words)
        parts += [b" ".join(words)] if words else []
        start = end
    return b" ".join([*parts, b""]), n


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.longest = 0
        for phrase in {**BASE, **NOTICES, **TAGS}:
            self.automaton.add_word(f" {phrase} ", phrase)
            self.longest = max(self.longest, len(phrase) + 2)
        self.automaton.make_automaton()

    def places(self, words: bytes) -> Iterator[tuple[int, str]]:
        """(start, phrase) of all occurrences, also overlapping ones, window by window."""
        for left in range(0, len(words), WINDOW):
            low = max(0, left - self.longest)
            for end, phrase in self.automaton.iter(words[low : left + WINDOW].decode("latin-1")):
                if low + end >= left:
                    yield low + end - len(phrase) - 1, phrase

    def __call__(self, text: str) -> dict:
        data = text.encode("utf-8", "replace")
        words, n = normal(data)
        numbers, base, labels, tags, seen, number = [], set(), {}, [], 0, 0
        for start, phrase in sorted(self.places(words)):
            number += words.count(b" ", seen, start)
            seen = start
            if phrase in BASE:
                numbers.append(number)
                base.add(BASE[phrase])
            if phrase in TAGS:
                tags.append((number, phrase))
            else:
                labels[BASE.get(phrase) or NOTICES[phrase]] = WEIGHTS[1]
        found = list(self.expressions(data, tags)) if tags else []
        for codes, (names, _) in found:
            labels |= dict.fromkeys(names, WEIGHTS[0])
        doubt = 1.0
        for weight in labels.values():
            doubt *= 1 - weight
        return {
            "n_words": n, "n_base": len(numbers), "first_word": numbers[0] if numbers else None, "last_word": numbers[-1] if numbers else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted({*labels})), "score": 1 - doubt,
            "expressions": [{"postfix": " ".join(codes), "terms": TERMS[strict]} for codes, (_, strict) in found],
        }

    def expressions(self, data: bytes, tags: list[tuple[int, str]]) -> Iterator[tuple[list[str], tuple[set[str], int]]]:
        """The expressions behind the tags; a tag is one only as it is written, with a colon."""
        wanted, folded = dict(tags), data.translate(_FOLD)
        for k, m in enumerate(_WORD.finditer(folded)):
            if k in wanted:
                tag = re.compile(re.escape(TAGS[wanted[k]]) + rb"[ \t]*:").match(folded, m.start())
                if tag:
                    line = folded.find(b"\n", tag.end())
                    codes = postfix(folded[tag.end() : len(folded) if line < 0 else line])
                    if codes:
                        yield codes, evaluated(codes)


_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<struct<postfix: string, terms: string>>"
)
_KINDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.struct([("postfix", pa.string()), ("terms", pa.string())]))),
])


def scan_licenses(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions) for every row of ``docs``.

    Words are runs of digits, letters a-z (A-Z folded) and all characters beyond ASCII. ``n_base`` counts
    the places of the base phrases, ``first_word`` and ``last_word`` are the smallest and largest number
    of a word one starts at (null without any). ``labels`` holds the base labels and those of other notices
    and expressions. ``score`` is one minus the product of the doubts that the labels leave. Null and
    empty texts have no words, no labels and score 0; repeated rows are scanned each; no rows give no rows.
    """
    chosen = docs.select(row(docs, carry).alias("row"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for part in slices(batches, "text"):
            found = pa.RecordBatch.from_pylist([scan(t.as_py()) for t in part.column("text")], _KINDS)
            yield pa.RecordBatch.from_arrays([part.column("row"), *found.columns], ["row", *_KINDS.names])

    return chosen.mapInArrow(run, f"{_ddl(chosen.select('row'))}, {_FOUND}")
