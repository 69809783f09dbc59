"""Row-local folds for oversized nodes and greedy packing.

A fold carries counters and the list of *start positions* only; texts are cut
afterwards with ``slice``. Appending one item per element inside a fold would be
quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import let, slices, words_of
from quire.functions.html import node_tag, node_text
from quire.functions.text import escape_text, estimate_tokens, sentence_parts, tokens_from
from quire.params import MAX_NODES_PER_SEGMENT, OVERSIZE_RATIO


def oversize_limit(target: int) -> int:
    return max(target, int(target * OVERSIZE_RATIO))


def _units(text: Column, limit: int) -> Column:
    """Packable units: sentences, or the words of a sentence that is itself too long.

    ``grp`` is -1 for sentences and the sentence position for words, so words of
    one long sentence are never packed with anything else.
    """

    def unit(piece: Column, words: Column, grp: Column) -> Column:
        return F.struct(
            piece.alias("text"),
            F.length(piece).alias("chars"),
            words.cast("int").alias("words"),
            grp.cast("int").alias("grp"),
        )

    def expand(sentence: Column, i: Column) -> Column:
        return let(
            words_of(sentence),
            lambda ws: F.when(
                tokens_from(F.length(sentence), F.size(ws)) > limit,
                F.transform(ws, lambda w: unit(w, F.lit(1), i)),
            ).otherwise(F.array(unit(sentence, F.size(ws), F.lit(-1)))),
        )

    return F.flatten(F.transform(sentence_parts(text), expand))


def _unit_starts(units: Column, limit: int) -> Column:
    zero = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("chars"),
        F.lit(0).alias("words"),
        F.lit(-2).alias("grp"),
    )

    def step(acc: Column, u: Column) -> Column:
        chars = acc["chars"] + 1 + u["chars"]
        words = acc["words"] + u["words"]
        fresh = (acc["grp"] != u["grp"]) | (tokens_from(chars, words) > limit)
        return let(
            fresh,
            lambda new: F.struct(
                F.when(new, F.concat(acc["starts"], F.array(acc["pos"]))).otherwise(acc["starts"]).alias("starts"),
                (acc["pos"] + 1).alias("pos"),
                F.when(new, u["chars"]).otherwise(chars).alias("chars"),
                F.when(new, u["words"]).otherwise(words).alias("words"),
                u["grp"].alias("grp"),
            ),
        )

    return F.aggregate(units, zero, step, lambda acc: acc["starts"])


def fragments(html: Column, limit: int) -> Column:
    """One node -> its fragments, each in the node's own block tag.

    A node within the limit is returned as it is. Fragment text is escaped again
    after decoding, so ``&lt;`` in the source can never turn into a tag.
    """

    def pieces(text: Column, tag: Column) -> Column:
        return let(
            _units(text, limit),
            lambda units: F.transform(
                slices(units, _unit_starts(units, limit)),
                lambda group: F.concat(
                    F.lit("<"), tag, F.lit(">"),
                    escape_text(F.array_join(F.transform(group, lambda u: u["text"]), " ")),
                    F.lit("</"), tag, F.lit(">"),
                ),
            ),
        )

    def cut(node: Column) -> Column:
        # The tag is bound: looked up per fragment, it would read the whole node for each of them.
        return let(
            node_text(node),
            lambda text: F.when(text == "", F.array(node)).otherwise(let(node_tag(node), lambda tag: pieces(text, tag))),
        )

    return let(html, lambda node: F.when(estimate_tokens(node) > limit, cut(node)).otherwise(F.array(node)))


def pack_starts(tokens: Column, target: int, max_nodes: int = MAX_NODES_PER_SEGMENT) -> Column:
    """Greedy packing of an array of token counts -> 0-based segment starts."""
    zero = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0).alias("pos"),
        F.lit(0).alias("tokens"),
        F.lit(0).alias("nodes"),
    )

    def step(acc: Column, t: Column) -> Column:
        fresh = (acc["pos"] == 0) | (acc["tokens"] + t > target) | (acc["nodes"] >= max_nodes)
        return let(
            fresh,
            lambda new: F.struct(
                F.when(new, F.concat(acc["starts"], F.array(acc["pos"]))).otherwise(acc["starts"]).alias("starts"),
                (acc["pos"] + 1).alias("pos"),
                F.when(new, t).otherwise(acc["tokens"] + t).alias("tokens"),
                F.when(new, F.lit(1)).otherwise(acc["nodes"] + 1).alias("nodes"),
            ),
        )

    return F.aggregate(tokens, zero, step, lambda acc: acc["starts"])


def pack_nodes(nodes: Column, target: int, max_nodes: int = MAX_NODES_PER_SEGMENT) -> Column:
    """Array of node HTML (list position = node index) -> array of segment structs."""
    limit = oversize_limit(target)
    units = F.flatten(
        F.transform(
            nodes,
            lambda html, i: F.transform(
                fragments(html, limit),
                lambda f: F.struct(
                    i.cast("int").alias("node_idx"), f.alias("html"), estimate_tokens(f).alias("tokens")
                ),
            ),
        )
    )
    return let(
        F.filter(units, lambda u: u["html"] != ""),
        lambda us: F.transform(
            slices(us, pack_starts(F.transform(us, lambda u: u["tokens"]), target, max_nodes)),
            lambda group, k: F.struct(
                k.cast("int").alias("chunk_index"),
                F.array_join(F.transform(group, lambda u: u["html"]), "\n\n").alias("text"),
                F.aggregate(group, F.lit(0), lambda a, u: a + u["tokens"]).alias("tokens_est"),
                F.transform(group, lambda u: u["node_idx"]).alias("node_indices"),
            ),
        ),
    )
