"""Results -> documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import let, strip
from quire.functions.html import checked_blocks, inner_html, node_strings, node_tag
from quire.functions.markdown import rendered_node
from quire.functions.text import escape_text
from quire.operators.state import unfinished
from quire.params import ATTRIBUTE_TAGS, MEDIA_TYPES, PROOFREAD_TEMPERATURE
from quire.session import settle

# Nodes per assembled part: bounds the text one task concatenates.
PART_NODES = 4096
# Narrow rows that are broadcast at most.
BROADCAST_KEYS = 1_000_000


def remap_blocks(segments: DataFrame, text: str = "translated_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Segment blocks zipped to node indices; a count mismatch yields error rows for the same nodes. Narrow."""

    def zipped(blocks: Column) -> Column:
        indices = F.col("node_indices")
        fits = F.size(blocks) == F.size(indices)
        message = F.concat(
            F.lit("segment "), F.col("chunk_index") + 1, F.lit(": "), F.size(blocks), F.lit(" blocks for "),
            F.size(indices), F.lit(" nodes"),
        )
        return F.transform(
            indices,
            lambda node, i: F.struct(
                i.cast("int").alias("pos"),
                node.alias("node_idx"),
                F.when(fits, F.get(blocks, i)["tag"]).alias("tag"),
                F.when(fits, F.get(blocks, i)["html"]).alias("html"),
                F.when(~fits, message).alias("error"),
            ),
        )

    return segments.select(
        "job_id", "chunk_index", *keep, F.explode(let(checked_blocks(F.col(text)), zipped)).alias("b")
    ).select("job_id", "chunk_index", *keep, "b.*")


def merge_fragments(blocks: DataFrame, *facts: Column) -> DataFrame:
    """Fragments of one node -> one block in the first fragment's tag; tags must agree.

    Groups hold the fragments of a single node, so they are as small as a node.
    ``facts`` are further aggregates over the fragments of a node.
    """
    grouped = blocks.groupBy("job_id", "node_idx").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "pos", "tag", "html", "error"))).alias("fs"), *facts
    )
    extra = [c for c in grouped.columns if c not in ("job_id", "node_idx", "fs")]

    def merged(fs: Column) -> Column:
        tags = F.array_distinct(F.transform(fs, lambda f: f["tag"]))
        opening = F.regexp_extract(fs[0]["html"], r"""(?s)^\s*(<[a-zA-Z](?:[^"'>]++|"[^"]*"|'[^']*')*+>)""", 1)
        joined = F.concat(
            opening,
            F.array_join(F.transform(fs, lambda f: strip(inner_html(f["html"]))), " "),
            F.lit("</"), fs[0]["tag"], F.lit(">"),
        )
        broken = F.get(F.filter(fs, lambda f: f["error"].isNotNull()), F.lit(0))["error"]
        error = F.coalesce(broken, F.when(F.size(tags) > 1, F.lit("fragments with different tags")))
        html = F.when(F.size(fs) == 1, fs[0]["html"]).otherwise(joined)
        return let(error, lambda e: F.struct(F.when(e.isNull(), html).alias("html"), e.alias("error")))

    return grouped.select("job_id", "node_idx", *extra, let(F.col("fs"), merged).alias("m")).select(
        "job_id", "node_idx", *extra, "m.html", "m.error"
    )


def coverage(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Differences between document nodes and translated nodes: ``unknown`` and ``missing`` rows.

    One full outer join on (job, node) answers both directions.
    """
    have = blocks.select("job_id", "node_idx").distinct().withColumn("_have", F.lit(True))
    want = nodes.select("job_id", "node_idx").withColumn("_want", F.lit(True))
    both = want.join(have, ["job_id", "node_idx"], "full")
    problem = F.when(F.col("_want").isNull(), "unknown").when(F.col("_have").isNull(), "missing")
    return both.select("job_id", "node_idx", problem.alias("problem")).where("problem is not null")


COPIED_FORMATS = ("epub", "pdf", "docx")


def partial_preview(jobs: DataFrame, segments: DataFrame, nodes: DataFrame, allow_partial: bool = True) -> DataFrame:
    """Node table of every job: translated where DONE, source elsewhere.

    Copied formats keep every untouched source node; a pending segment counts there
    only where it shares a node with a finished one. Both facts come out of the one
    grouping by node that merges fragments. Without ``allow_partial`` only jobs
    whose segments are all finished are returned.
    """
    is_done = (F.col("status") == "DONE") & (F.coalesce("translated_text", F.lit("")) != "")
    typed = segments.join(jobs.select("job_id", "file_type"), "job_id").withColumns(
        {"is_done": is_done, "chosen": F.when(is_done, F.col("translated_text")).otherwise(F.col("original_text"))}
    )
    if not allow_partial:
        open_jobs = typed.where(~F.col("is_done")).select("job_id").distinct()
        typed = typed.join(open_jobs, "job_id", "left_anti")
        nodes = nodes.join(typed.select("job_id").distinct(), "job_id", "left_semi")
    blocks = remap_blocks(typed, "chosen", ("is_done", "file_type"))
    copied = F.max(F.col("file_type").isin(*COPIED_FORMATS)).alias("copied")
    merged = merge_fragments(blocks, F.max("is_done").alias("touched"), copied)
    kept = merged.where(~F.col("copied") | F.col("touched")).select(
        "job_id", "node_idx", F.col("html").alias("new_html"), "error"
    )
    return nodes.join(kept, ["job_id", "node_idx"], "left").select(
        "job_id", "node_idx", F.coalesce("new_html", "html").alias("html"),
        F.col("new_html").isNotNull().alias("replaced"), "error",
    )


def render_text(nodes: DataFrame, key: str = "doc_id", html: str = "html", file_type: str = "file_type") -> DataFrame:
    """Nodes -> (key, node_idx, sep, piece): the document is sep+piece in node order. Narrow.

    Fence lines are part of the pieces: the opener goes with the first line of a
    group and the closer with the last; suppressed fences leave plain paragraphs.
    """
    is_markdown = F.col(file_type) == "md"
    meta = {name: F.col(name) for name in ("kind", "tag", "marker", "code_wrapper")}
    text = rendered_node(F.col(html), meta, is_markdown)
    line = (F.col("kind") == "fence_heading_line") & ~F.col("suppress_fence") & is_markdown
    whole = (F.col("kind") == "fence") & ~F.col("suppress_fence") & is_markdown
    opener = F.when(whole | (line & (F.col("fence_pos") == 0)), F.concat("fence_open", F.lit("\n"))).otherwise("")
    closes = whole | (line & (F.col("fence_pos") == F.col("fence_count") - 1))
    closer = F.when(closes, F.concat(F.lit("\n"), "fence_close")).otherwise("")
    # Nodes without text leave through the empty array, so the rendering is evaluated once.
    rendered = F.array_compact(F.array(F.concat(opener, text, closer)))
    return nodes.select(
        key, "node_idx",
        F.when(line & (F.col("fence_pos") > 0), "\n").otherwise("\n\n").alias("sep"),
        F.explode(rendered).alias("piece"),
    )


def assemble_text(pieces: DataFrame, key: str = "doc_id", part_nodes: int = PART_NODES) -> DataFrame:
    """Rendered pieces -> (key, part, text); concatenating the parts in order gives the document.

    A document up to ``part_nodes`` nodes is one row. Longer ones come in several
    rows, so no task has to hold more than one part.
    """
    parts = (
        pieces.withColumn("part", F.floor(F.col("node_idx") / part_nodes).cast("int"))
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list(F.struct("node_idx", "sep", "piece"))).alias("ps"))
        .select(
            key, "part", F.col("ps")[0]["sep"].alias("sep"),
            F.array_join(F.transform("ps", lambda p: F.concat(p["sep"], p["piece"])), "").alias("text"),
        )
    )
    parts = settle(parts, "document-parts")
    # Only documents of several parts need to know their first and last one: keys and numbers move, no text.
    several = settle(
        parts.groupBy(key).agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last"), "document-bounds"
    )
    several = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
    return parts.join(several, key, "left").select(
        key, "part",
        F.concat(
            F.when(F.coalesce(F.col("part") > F.col("first"), F.lit(False)), F.col("text"))
            .otherwise(F.substr(F.col("text"), F.length("sep") + 1)),
            F.when(F.coalesce(F.col("part") < F.col("last"), F.lit(False)), "").otherwise("\n"),
        ).alias("text"),
    )


_OPEN_INLINE = (
    r"(?i)<(?:" + "|".join(sorted(ATTRIBUTE_TAGS, key=len, reverse=True)) + r""")(?=[\s/>])(?:[^"'>]++|"[^"]*"|'[^']*')*+>"""
)


def restore_inline_attributes(source: Column, translated: Column) -> Column:
    """Source block with the translated content; inline attributes copied by position.

    Attributes are copied only when both sides open the same number of inline tags
    and only onto a tag of the same name. A translation in another block tag is
    reduced to its text.
    """
    opening = F.regexp_extract(source, r"""(?s)^\s*(<[a-zA-Z](?:[^"'>]++|"[^"]*"|'[^']*')*+>)""", 1)
    closing = F.concat(F.lit("</"), node_tag(source), F.lit(">"))
    name = lambda tag: F.lower(F.regexp_extract(tag, r"^<([a-zA-Z][^\s/>]*)", 1))

    def rebuild(inner: Column) -> Column:
        def with_tags(ours: Column) -> Column:
            def merge(theirs: Column) -> Column:
                same_count = F.size(ours) == F.size(theirs)
                tags = F.transform(
                    theirs,
                    lambda t, i: F.when(same_count & (name(t) == name(F.get(ours, i))), F.get(ours, i)).otherwise(t),
                )
                return let(
                    tags,
                    lambda ts: F.array_join(
                        F.transform(
                            F.split(inner, _OPEN_INLINE), lambda piece, i: F.concat(piece, F.coalesce(F.get(ts, i), F.lit("")))
                        ),
                        "",
                    ),
                )

            return let(F.regexp_extract_all(inner, F.lit(_OPEN_INLINE), F.lit(0)), merge)

        return let(F.regexp_extract_all(inner_html(source), F.lit(_OPEN_INLINE), F.lit(0)), with_tags)

    same_tag = node_tag(source) == node_tag(translated)
    body = F.when(same_tag, let(inner_html(translated), rebuild)).otherwise(escape_text(node_strings(translated)))
    return F.concat(opening, body, closing)


def page_groups(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Consecutive text pages between passthrough pages share a ``reflow_group``."""
    from quire.functions.prefix import running_sum

    numbered = running_sum(pages, [key], "page_num", F.col("passthrough").cast("int"), "reflow_group")
    return numbered.where(~F.col("passthrough")).select(key, "page_num", F.col("reflow_group").cast("int"))


def clone_for_proofread(jobs: DataFrame, segments: DataFrame, suffix: str = "-proof") -> DataFrame:
    """Completed jobs -> proofreading jobs over their output; others carry ``reject_reason``."""
    ready = (F.col("status") == "COMPLETED") & (F.coalesce("unfinished", F.lit(0)) == 0)
    # The stored output keeps its file name and becomes the source of the new job.
    name = F.element_at(F.split("output_path", "/"), -1)
    return jobs.join(unfinished(segments), "job_id", "left").select(
        F.concat("job_id", F.lit(suffix)).alias("job_id"),
        F.col("job_id").alias("parent_id"),
        name.alias("file_name"),
        F.col("target_lang").alias("source_lang"),
        "target_lang",
        "model",
        "glossary_name",
        "chunk_size",
        "concurrency",
        "api_type",
        F.lit(PROOFREAD_TEMPERATURE).alias("temperature"),
        F.lit("proofreading").alias("job_type"),
        F.concat(F.lit("relu_"), name).alias("output_name"),
        F.when(~ready, "unfinished").alias("reject_reason"),
    )


def export_manifest(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Per job: partial or final, downloadable, download name, media type."""
    partial = (F.col("status") != "COMPLETED") | (F.coalesce("unfinished", F.lit(0)) > 0)
    media = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    suffix = F.lower(F.regexp_extract("output_path", r"\.([^./]+)$", 1))
    return jobs.join(unfinished(segments), "job_id", "left").select(
        "job_id",
        F.when(partial, "partial").otherwise("final").alias("export"),
        (~partial | (F.col("completed_chunks") > 0)).alias("downloadable"),
        F.when(partial, F.concat(F.lit("apercu_partiel_"), "file_name"))
        .otherwise(F.element_at(F.split("output_path", "/"), -1)).alias("download_name"),
        F.coalesce(F.element_at(media, suffix), F.lit("application/octet-stream")).alias("media_type"),
    )


def safe_filename(name: Column) -> Column:
    """Base name with a bounded, cleaned stem and a lower-case suffix."""
    given = F.coalesce(F.nullif(name, F.lit("")), F.lit("document.epub"))
    base = F.element_at(F.split(F.regexp_replace(given, "/+$", ""), "/"), -1)
    pattern = r"(?s)^(.+)(\.[^.]+)\z"
    stem = F.when(F.rlike(base, F.lit(pattern)), F.regexp_extract(base, pattern, 1)).otherwise(base)
    cleaned = F.btrim(F.regexp_replace(stem, r"(?U)[^\w .()-]", "_"), F.lit(" ."))
    return F.concat(
        F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("document")), 1, 160),
        F.lower(F.regexp_extract(base, pattern, 2)),
    )
