"""Small helpers for writing folds and bindings with Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.params import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Catalyst does not share sub-expressions across lambda bodies, so a value that
    is indexed per element (``xs[i - 1]``) must be bound, not repeated.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


BUFFER = 128


def buffer(kind: str) -> Column:
    """An empty list of type ``kind`` (``array<...>``) for a fold that appends.

    Appending to an array copies it, which is quadratic over a fold. A buffer copies a short
    recent part only, and puts it away as a whole whenever it is full.
    """
    return F.struct(F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("recent"))


def append(held: Column, items: Column, kind: str) -> Column:
    """No ``let`` here: the result of a lambda is copied in depth, and so would be the whole buffer."""
    recent = F.concat(held["recent"], items)
    full = F.size(recent) >= BUFFER
    return F.struct(
        F.when(full, F.concat(held["full"], F.array(recent))).otherwise(held["full"]).alias("full"),
        F.when(full, F.array().cast(kind)).otherwise(recent).alias("recent"),
    )


def buffered(held: Column) -> Column:
    return F.flatten(F.concat(held["full"], F.array(held["recent"])))


def strip(text: Column) -> Column:
    """Unicode-aware strip (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_part(text: Column) -> Column:
    """``strip`` of a lambda's parameter. Trimming lays out all characters, so it is left to texts with a blank at an end."""
    blank = lambda at: F.contains(F.lit(WHITESPACE), F.substring(text, at, 1))
    return F.when(blank(1) | blank(-1), F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def lstrip_part(text: Column) -> Column:
    return F.when(F.contains(F.lit(WHITESPACE), F.substring(text, 1, 1)), lstrip(text)).otherwise(text)


def rstrip_part(text: Column) -> Column:
    return F.when(F.contains(F.lit(WHITESPACE), F.substring(text, -1, 1)), rstrip(text)).otherwise(text)


# Regex classes equal to Unicode white space; Java needs (?U) for \s to be Unicode-aware.
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){NON_WS}+"), F.lit(0))


def squeeze(text: Column) -> Column:
    """Collapse every white-space run to one space, then strip."""
    return strip(F.regexp_replace(text, f"(?U){WS}+", " "))


# What may need ``squeeze``: all but printable Latin-1. Single characters are looked up in a table, ranges one by one.
UNEVEN = "[^ " + "".join(f"\\x{c:02x}" for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)]) + "]"


def squeeze_part(text: Column) -> Column:
    """``squeeze`` of a lambda's parameter. Replacing copies a text word by word, so it is left to texts that may need it."""
    uneven = F.contains(text, F.lit("  ")) | F.rlike(text, F.lit(UNEVEN))
    return F.when(uneven, squeeze(text)).otherwise(strip_part(text))


def slices(items: Column, starts: Column) -> Column:
    """Cut ``items`` at the 0-based ``starts`` (the output of a fold) into sub-arrays."""
    return let(
        F.struct(items.alias("items"), starts.alias("starts")),
        lambda v: F.transform(
            v["starts"],
            lambda s, k: F.slice(
                v["items"],
                s + 1,
                F.coalesce(F.get(v["starts"], k + 1), F.size(v["items"])) - s,
            ),
        ),
    )


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
