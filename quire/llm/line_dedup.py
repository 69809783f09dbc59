"""Line deduplication by an edit-distance join over segments; DataFrame functions only.

Two lines are linked when they are equal or at most ``edits`` insertions, deletions and
substitutions apart. A line is cut into ``edits + 1`` segments of nearly equal length; edits
can touch all but one of them, so a similar line holds one segment unchanged, within the few
places that leave both the edits before it and those behind it affordable. Index rows are
(length, segment number, segment); probe rows are, for each indexed length up to ``edits``
shorter, the substrings at those places. Both travel as 64-bit keys.

Most keys belong to one line only. A first pass finds the live keys with narrow rows that are
aggregated on the map side; only lines with a live key are joined, and of those pairs only the
ones whose character counts allow the distance. The distance itself is a banded bit-parallel
one: a band of ``2 edits + 1`` diagonals fits in one integer at any length, and each character
of a line costs a few bit operations.

Equal lines are one line (a 128-bit hash) in all of this, so copies cost nothing. The lines of
a component of links are one class, of which the first line stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import let
from quire.llm.components import components
from quire.llm.text import row
from quire.session import settle

EDITS = 2
MIN_CHARS = 20
BROADCAST_KEYS = 1_000_000
#: Character classes whose counts bound the distance from below; any choice is right, common letters tell most.
COUNTED = (
    "a", "e", "i", "n", "o", "r", "s", "t", "d", "l", "h", "u", "c", "g", "m", "w", "b", "f", "p", "vyk", "qxjz",
    " .,", "0123456789", "äöüßéèêçñáíóú",
)


def _place(length: Column, segments: int, i: int) -> tuple[Column, Column]:
    """0-based start and length of segment ``i``; the last segments take what is left over."""
    base, more = F.floor(length / segments), length % segments
    longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(segments) - more))
    return base * i + longer, base + (F.lit(i) >= F.lit(segments) - more).cast("int")


def _windows(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """0-based start and length of the stretches that hold every place a segment may be sought at."""
    out = []
    for i in range(edits + 1):
        start = F.greatest(F.lit(0), F.floor((length - edits) / (edits + 1)) * i - edits)
        end = F.floor(length / (edits + 1)) * (i + 1) + i + 1 + edits
        out.append((start, end - start))
    return out


def entries(length: Column, windows: list[Column], starts: list[Column], edits: int) -> list[tuple[Column, bool]]:
    """(key, is it an index key?) of a line: its own segments, and the substrings that may be a segment of another.

    A line's own segments are index keys, and probes for lines of equal length at the same places. Probes
    look for lines as long, or up to ``edits`` shorter; a key is null where it would leave the line. Substrings
    are cut from the windows, as finding a character of a long line means walking to it.
    """

    def key(sought: Column, i: int, at: Column, size: Column) -> Column:
        return F.xxhash64(sought, F.lit(i), F.substr(windows[i], (at - starts[i] + 1).cast("int"), size.cast("int")))

    out = []
    for shorter in range(edits + 1):
        sought = length - shorter
        for i in range(edits + 1):
            start, size = _place(sought, edits + 1, i)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                at = start + shift
                if shorter == shift == 0:
                    out.append((key(sought, i, at, size), True))
                else:
                    out.append((F.when((at >= 0) & (at + size <= length), key(sought, i, at, size)), False))
    return out


def bounded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of ``a`` and ``b``, ``a`` not the shorter one, if it is at most ``edits``; else more than ``edits``.

    Bit ``k`` of the vectors stands for row ``column - edits + k`` of the distance matrix. The diagonal that
    ends in the last cell keeps the distance: it grows wherever its bit says that the step was no match.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    one = lambda n: F.lit(n).cast("long")
    chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
    texts = F.struct(chars(a).alias("a"), chars(b).alias("b"))

    def run(t: Column) -> Column:
        more = F.size(t["a"]) - F.size(t["b"])
        probe = F.get(F.array(*[one(1 << edits + k) for k in range(edits + 1)]), more)

        def step(acc: Column, j: Column) -> Column:
            c = F.get(t["b"], j)
            matches = reduce(
                lambda x, y: x.bitwiseOR(y),
                [F.when(F.get(t["a"], j - edits + k) == c, one(1 << k)).otherwise(one(0)) for k in range(width)],
            )

            def zero(m: Column) -> Column:
                x = m.bitwiseOR(acc["vn"])
                grown = (x.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"])
                return grown.bitwiseOR(x).bitwiseAND(one(mask))

            def after(d: Column) -> Column:
                hp = acc["vn"].bitwiseOR(F.bitwise_not(acc["vp"].bitwiseOR(d))).bitwiseAND(one(mask))
                return let(
                    F.struct(hp.alias("hp"), F.shiftright(d, 1).alias("x"), d.bitwiseAND(acc["vp"]).alias("hn"), d.alias("d")),
                    lambda s: F.struct(
                        s["hn"].bitwiseOR(F.bitwise_not(s["x"].bitwiseOR(s["hp"]))).bitwiseAND(one(mask)).alias("vp"),
                        s["x"].bitwiseAND(s["hp"]).alias("vn"),
                        (acc["n"] + (s["d"].bitwiseAND(probe) == 0).cast("int")).alias("n"),
                    ),
                )

            return let(let(matches, zero), after)

        start = F.struct(one(mask & ~((1 << edits) - 1)).alias("vp"), one(0).alias("vn"), more.alias("n"))
        places = F.when(F.size(t["b"]) > 0, F.sequence(F.lit(0), F.size(t["b"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(more > edits, more).otherwise(F.aggregate(places, start, step, lambda acc: acc["n"]))

    return let(texts, run)


def _small(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast a settled table of narrow keys if it really is small; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= limit else df


def _lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    body = docs[f"`{text}`"].cast("string")
    return (
        docs.select(F.explode(F.split(body, "\n")).alias("line"))
        .withColumn("length", F.char_length("line"))
        .where((F.col("length") >= min_chars) & F.regexp_like("line", F.lit(r"[^\x20\x09-\x0D]")))
    )


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def line_links(docs: DataFrame, text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, distance): hashes of different lines of at least ``min_chars`` characters that are 1..edits edits apart."""
    lines = _lines(docs, text, min_chars)
    line, length = F.col("line"), F.col("length")
    windows, starts = [F.col(f"w{i}") for i in range(edits + 1)], [F.col(f"s{i}") for i in range(edits + 1)]
    cut = {}
    for i, (start, size) in enumerate(_windows(length, edits)):
        cut |= {f"s{i}": start, f"w{i}": F.substr(line, (start + 1).cast("int"), size.cast("int"))}
    # Index keys first. A line's keys are stored as one row and dealt out on reading: half the work of a row for each.
    found = sorted(entries(length, windows, starts, edits), key=lambda e: not e[1])
    n_indexed = sum(kind for _, kind in found)
    keys = lines.select("length", F.xxhash64("line").alias("h"), *[c.alias(n) for n, c in cut.items()])
    keys = settle(keys.select("h", F.array(*[k for k, _ in found]).alias("keys")), "line-entries")
    keys = keys.select("h", F.posexplode("keys").alias("nth", "key")).where("key is not null")
    keys = keys.select("h", "key", (F.col("nth") < n_indexed).alias("indexed"))
    live = (
        keys.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.max("indexed").alias("i"))
        .where((F.col("h0") != F.col("h1")) & F.col("i"))
    )
    live = _small(settle(live.select("key"), "line-keys"))
    met = settle(keys.join(live, "key", "left_semi").distinct(), "line-met")
    wanted = _small(settle(met.select("h").distinct(), "line-wanted"))
    counts = [F.char_length(line) - F.char_length(F.translate(line, c, "")) for c in COUNTED]
    texts = (
        lines.withColumn("h", F.xxhash64("line")).join(wanted, "h", "left_semi").withColumn("lid", _hash(line))
        .groupBy("lid").agg(F.first("line").alias("line"), F.first("h").alias("h"))
        .withColumn("counts", F.array(*counts))
    )
    texts = settle(texts, "line-texts")
    rows = settle(met.join(texts.select("h", "lid", F.char_length("line").alias("n"), "counts"), "h"), "line-rows")
    side = lambda which, s: rows.where(which).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("lid", "n", "counts", "indexed")])
    apart = reduce(lambda x, y: x + y, [F.abs(F.col("counts_a")[k] - F.col("counts_b")[k]) for k in range(len(COUNTED))])
    # An edit changes one count by one, or two counts by one each.
    longer = F.col("n_a") - F.col("n_b")
    once = (longer > 0) | (F.col("lid_a") < F.col("lid_b")) | ~F.col("indexed_a") & (F.col("lid_a") != F.col("lid_b"))
    near = longer.between(0, edits) & (apart <= 2 * edits) & once
    a, b = side(F.lit(True), "a").alias("a"), side(F.col("indexed"), "b").alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("lid_a").alias("a"), F.col("lid_b").alias("b"))
    # Of lines of equal length both directions are found; one is enough.
    pairs = pairs.select(
        F.col("a").alias("x"), F.col("b").alias("y"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).groupBy("a", "b").agg(F.first(F.struct("x", "y")).alias("p")).select("p.x", "p.y")
    pairs = settle(pairs, "line-pairs")
    of = lambda s: texts.select(F.col("lid").alias(s), F.col("line").alias(f"line_{s}"))
    checked = pairs.join(of("x"), "x").join(of("y"), "y").withColumn(
        "distance", bounded_distance(F.col("line_x"), F.col("line_y"), edits)
    )
    checked = settle(checked.select("x", "y", "distance"), "line-distances")
    return checked.where(F.col("distance") <= edits).select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")


def mark_lines(
    docs: DataFrame, carry: list[str], text: str = "text", order: str = "doc_id", edits: int = EDITS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(row, n_lines, n_links, dropped, ...) for every row of ``docs``.

    ``n_lines`` counts lines with a word; ``dropped`` holds the 0-based numbers of those that repeat, or
    nearly repeat, an earlier line of the corpus (documents by ``order``, null last, equal ones in any
    order; lines by number); ``n_links`` adds up, over the document's lines, the different lines each
    is linked to. Lines shorter than ``min_chars`` repeat only when equal. Blank lines are left alone;
    null and empty texts have no lines.
    """
    links = settle(line_links(docs, text, edits, min_chars).select("a", "b"), "line-links")
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    ids = F.transform(
        F.split(body, "\n"), lambda x: F.when(F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.md5(x.cast("binary"))))
    )
    base = docs.select(row(docs, carry).alias("row"), docs[f"`{order}`"].alias("ord"), ids.alias("ids"))
    base = settle(base.withColumn("rid", F.monotonically_increasing_id()), "line-rows")
    found = base.select("rid", "ord", F.posexplode("ids").alias("pos", "lid")).where("lid is not null")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    place = settle(
        components(links).join(degree, F.col("node") == F.col("a")).select(F.col("node").alias("lid"), "root", "links"),
        "line-classes",
    )
    found = settle(
        found.join(place, "lid", "left").select(
            "rid", "ord", "pos", F.coalesce("root", "lid").alias("c"), F.coalesce("links", F.lit(0)).alias("links")
        ),
        "line-found",
    )
    key = F.struct(F.col("ord").isNull().alias("none"), "ord", "rid", "pos")
    first = settle(found.groupBy("c").agg(F.min(key).alias("first")), "line-first")
    late = (F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))
    per_doc = (
        found.join(first, "c").groupBy("rid")
        .agg(
            F.count("*").alias("n_lines"), F.sum("links").alias("n_links"),
            F.array_sort(F.collect_list(F.when(late, F.col("pos")))).alias("dropped"),
        )
    )
    return base.drop("ids", "ord").join(per_doc, "rid", "left").select(
        "row", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", **how) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; same columns and rows. Null texts stay null."""
    marked = mark_lines(docs, docs.columns, text, order, **how)
    lines = F.split(F.col("row")[text], "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    new = F.when(F.size("dropped") == 0, F.col("row")[text]).otherwise(left)
    return marked.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
