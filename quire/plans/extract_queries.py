"""Registered queries: extraction, text rules and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T
from quire.operators import extract as X
from quire.operators import segment as S
from quire.params import FRONT_MATTER_TERMS
from quire.plans import sql as Q
from quire.plans import tables as tb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def pages(spark, sf):
    return tb.pages(spark, sf)


_TOP = f"WITH RECURSIVE {Q.html_ctes('pages')}"


@register(
    "html_blocks",
    _TOP + f""" SELECT page_id, CAST(rn - 1 AS INTEGER) AS block_idx, tag, html FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM html_all WHERE NOT nested)
    WHERE {Q.strip(Q.tagless('html'))} <> ''""",
)
def html_blocks(spark, sf):
    return X.html_blocks(pages(spark, sf))


@register(
    "html_blocks_legacy",
    _TOP + f""" SELECT page_id, CAST(rn - 1 AS INTEGER) AS block_idx, tag, html FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rn FROM html_all)
    WHERE {Q.strip(Q.tagless('html'))} <> ''""",
)
def html_blocks_legacy(spark, sf):
    return X.html_blocks_legacy(pages(spark, sf))


@register("drop_active_content", f"SELECT page_id, {Q.ACTIVE} AS html FROM pages")
def drop_active_content(spark, sf):
    return pages(spark, sf).select("page_id", H.drop_active_content(F.col("html")).alias("html"))


@register(
    "strip_attributes",
    "SELECT page_id, regexp_replace(html, '<([a-zA-Z][^\\s/>\"'']*)(?:[^\"''>/]|\"[^\"]*\"|''[^'']*'')*(/?)>', '<\\1\\2>', 'g') AS html FROM pages",
)
def strip_attributes(spark, sf):
    return pages(spark, sf).select("page_id", H.strip_attributes(F.col("html")).alias("html"))


@register(
    "readable_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(html,
        '(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>', '', 'g'), '<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '[ \t]{2,}', ' ', 'g'), '\n\s+', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(160)) AS readable FROM pages""",
)
def readable_text(spark, sf):
    return pages(spark, sf).select("page_id", H.readable_text(F.col("html")).alias("readable"))


@register("txt_blocks", f"WITH {Q.LINES} SELECT doc_id, node_idx, block FROM lines")
def txt_blocks(spark, sf):
    return X.txt_blocks(tb.line_docs(spark, sf))


@register("md_blocks", f"WITH {Q.MD_BLOCKS} SELECT doc_id, i AS block_idx, block FROM dressed")
def md_blocks(spark, sf):
    return X.md_blocks(tb.md_docs(spark, sf))


@register("converter_fences", f"""WITH {Q.MD_NODES} SELECT d.doc_id, CAST(coalesce(blocks, 0) AS INTEGER) AS blocks, coalesce(converter, FALSE) AS converter
        FROM documents d LEFT JOIN md_conv c ON c.doc_id = d.doc_id""")
def converter_fences(spark, sf):
    return X.converter_fences(tb.md_docs(spark, sf))


@register(
    "md_classify",
    f"WITH {Q.MD_NODES} SELECT doc_id, node_idx, kind, tag, marker, code_wrapper, suppress_fence, {Q.MD_HTML} AS html FROM md_nodes",
)
def md_classify(spark, sf):
    return tb.md_nodes(spark, sf).select(
        "doc_id", "node_idx", "kind", "tag", "marker", "code_wrapper", "suppress_fence", "html"
    )


@register(
    "fence_headings",
    f"""WITH {Q.MD_NODES} SELECT doc_id, node_idx, i AS fence_group, CAST(sub AS INTEGER) AS fence_pos,
        CAST(parts AS INTEGER) AS fence_count, fence_open, {Q.MD_HTML} AS html FROM md_nodes WHERE kind = 'fence_heading_line'""",
)
def fence_headings(spark, sf):
    return tb.md_nodes(spark, sf).where("kind = 'fence_heading_line'").select(
        "doc_id", "node_idx", "fence_group", "fence_pos", "fence_count", "fence_open", "html"
    )


@register(
    "inline_html",
    f"WITH {Q.MD_BLOCKS} SELECT doc_id, i AS block_idx, {Q.inline('block')} AS html FROM dressed",
)
def inline_html(spark, sf):
    blocks = X.md_blocks(tb.md_docs(spark, sf))
    return blocks.select("doc_id", "block_idx", T.inline_html(F.col("block")).alias("html"))


_LEGACY_HTML = f"""CASE WHEN regexp_matches(block, '^#{{1,6}}\\s+\\S')
   THEN '<h' || length(regexp_extract(block, '^(#{{1,6}})', 1)) || '>' || replace({Q.escape(Q.strip("regexp_extract(block, '(?s)^#{1,6}\\s+(.+)$', 1)"))}, chr(10), '<br/>')
        || '</h' || length(regexp_extract(block, '^(#{{1,6}})', 1)) || '>'
   ELSE '<p>' || replace({Q.escape('block')}, chr(10), '<br/>') || '</p>' END"""


@register("text_nodes_legacy", f"WITH {Q.MD_BLOCKS} SELECT doc_id, i AS node_idx, {_LEGACY_HTML} AS html FROM dressed")
def text_nodes_legacy(spark, sf):
    return X.text_nodes(tb.md_docs(spark, sf), ["doc_id"], version=F.lit(2)).select("doc_id", "node_idx", "html")


# Versions: documents get 1 + doc_id % 5 (Markdown), pages get 1 or 2 by parity (HTML).
@register(
    "extract_versioned",
    f"""WITH RECURSIVE {Q.MD_NODES}, {Q.html_ctes('pages').lstrip()},
    by_version AS (SELECT *, 1 + doc_id % 5 AS version FROM md_nodes),
    merged AS (
      SELECT doc_id, version, i, sub, kind, tag, {Q.MD_HTML} AS html FROM by_version WHERE version >= 4
      UNION ALL
      SELECT doc_id, version, i, 0, CASE WHEN parts = 2 THEN 'fence' ELSE kind END, tag,
             CASE WHEN parts = 2 THEN '<p>' || {Q.inline("plain || ' ' || other")} || '</p>' ELSE {Q.MD_HTML} END
      FROM (SELECT *, lead(plain) OVER (PARTITION BY doc_id, i ORDER BY sub) AS other FROM by_version WHERE version = 3) WHERE sub = 0
      UNION ALL
      SELECT doc_id, 1 + doc_id % 5, i, 0, CASE WHEN regexp_matches(block, '^#{{1,6}}\\s+\\S') THEN 'heading' ELSE 'paragraph' END,
             CASE WHEN regexp_matches(block, '^#{{1,6}}\\s+\\S') THEN 'h' || length(regexp_extract(block, '^(#{{1,6}})', 1)) ELSE 'p' END,
             {_LEGACY_HTML}
      FROM dressed WHERE 1 + doc_id % 5 < 3)
    SELECT 'md' AS file_type, doc_id AS source_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1 AS INTEGER) AS node_idx, kind, tag, html FROM merged
    UNION ALL
    SELECT 'epub', page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER), 'block', tag, html
    FROM html_all WHERE {Q.strip(Q.tagless('html'))} <> '' AND (page_id % 2 = 0 OR NOT nested)""",
)
def extract_versioned(spark, sf):
    docs = tb.md_docs(spark, sf).select(
        "file_type", F.col("doc_id").alias("source_id"), F.col("text").alias("content"),
        (F.col("doc_id") % 5 + 1).alias("version"),
    )
    books = pages(spark, sf).select(
        F.lit("epub").alias("file_type"), F.col("page_id").alias("source_id"), F.col("html").alias("content"),
        (F.col("page_id") % 2 + 1).alias("version"),
    )
    return X.extract_versioned(docs.unionByName(books), ["file_type", "source_id"], "content", "file_type", "version")


@register("estimate_tokens", f"SELECT doc_id, {Q.tokens('text')} AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return tb.documents(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


_WHOLE = f"whole AS (SELECT doc_id, 0 AS node_idx, {Q.strip('text')} AS plain, '<p>' || {Q.escape('text')} || '</p>' AS html FROM documents)"


@register(
    "split_oversized",
    f"WITH RECURSIVE {_WHOLE}, {Q.fragment_ctes('whole', 230)} SELECT doc_id, CAST(frag AS INTEGER) AS frag_idx, html, {Q.tokens('html')} AS tokens FROM units",
)
def split_oversized(spark, sf):
    out = S.split_oversized(tb.whole_text_nodes(spark, sf), ["doc_id"], "html", 230)
    return out.withColumn("tokens", T.estimate_tokens(F.col("html")))


_SEGMENT_COLUMNS = "doc_id, chunk_index, text, tokens_est, node_list"


def node_list(df):
    return df.withColumn("node_list", F.array_join(F.col("node_indices").cast("array<string>"), ",")).drop("node_indices")


@register("pack_segments", Q.segments_with(200) + f" SELECT {_SEGMENT_COLUMNS} FROM segs")
def pack_segments(spark, sf):
    return node_list(S.pack_segments(tb.line_node_rows(spark, sf), "doc_id", 200))


@register("segment_documents", Q.segments_with(1000) + f" SELECT {_SEGMENT_COLUMNS} FROM segs")
def segment_documents(spark, sf):
    return node_list(S.segment_documents(tb.line_docs(spark, sf), ["doc_id"], tb.line_nodes(), 1000))


@register("limit_segments", Q.segments_with(200) + f" SELECT {_SEGMENT_COLUMNS} FROM segs WHERE chunk_index < 3")
def limit_segments(spark, sf):
    return node_list(S.limit_segments(tb.segments(spark, sf), 3).drop("lang"))


@register(
    "validate_params",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 47 = 0 THEN 'job_type'
         WHEN o_orderpriority LIKE '4%' OR o_orderkey % 43 = 0 THEN 'language'
         WHEN o_orderkey % 13 = 0 OR o_orderkey % 41 = 0 THEN 'model' WHEN CAST(floor(o_totalprice) AS BIGINT) % 7 = 0 THEN 'max_segments'
         WHEN CAST(floor(o_totalprice / 20) AS BIGINT) NOT BETWEEN 200 AND 10000 THEN 'chunk_size'
         WHEN o_custkey % 40 NOT BETWEEN 1 AND 32 OR o_orderkey % 37 = 0 THEN 'concurrency'
         WHEN o_orderkey % 30 / 10.0 > 2 THEN 'temperature' END AS reject_reason FROM orders""",
)
def validate_params(spark, sf):
    k = F.col("o_orderkey")
    requests = tb.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 11 == 0, "summary").when(k % 47 != 0, "translation").alias("job_type"),
        F.when(F.startswith("o_orderpriority", F.lit("4")), F.col("o_orderpriority")).otherwise("en").alias("source_lang"),
        F.when(k % 43 != 0, "fr").alias("target_lang"),
        F.when(k % 13 == 0, " ").when(k % 41 != 0, "base").alias("model"),
        F.lit(None).cast("string").alias("system_prompt"),
        F.when(F.floor("o_totalprice").cast("bigint") % 7 == 0, 0).otherwise(5).alias("max_segments"),
        F.lit("openai").alias("api_type"),
        F.lit(None).cast("string").alias("endpoint"),
        F.floor(F.col("o_totalprice") / 20).cast("bigint").alias("chunk_size"),
        F.when(k % 37 != 0, F.col("o_custkey") % 40).alias("concurrency"),
        (k % 30 / F.lit(10.0)).alias("temperature"),
    )
    return S.validate_params(requests).select("o_orderkey", "reject_reason")


_TERMS = "|".join(FRONT_MATTER_TERMS)


@register(
    "excerpt",
    f"""WITH {Q.LINE_NODES},
    flagged AS (SELECT *, {Q.tokens('html')} AS tok, NOT (regexp_matches(lower(bare), '{_TERMS}') OR length(bare) < 40 OR lower(html) LIKE '%href=%') AS body
       FROM (SELECT *, {Q.strip(Q.tagless('html'))} AS bare FROM nodes)),
    begun AS (SELECT *, min(CASE WHEN body THEN node_idx END) OVER (PARTITION BY doc_id) AS first_body FROM flagged),
    kept AS (SELECT * FROM begun WHERE node_idx >= coalesce(first_body, 0)),
    summed AS (SELECT *, sum(tok) OVER (PARTITION BY doc_id ORDER BY node_idx ROWS UNBOUNDED PRECEDING) - tok AS before FROM kept)
    SELECT d.doc_id, coalesce(string_agg(html, chr(10) || chr(10) ORDER BY node_idx), '') AS text,
      CAST(coalesce(sum(tok), 0) AS INTEGER) AS tokens
    FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id AND before < 300 GROUP BY d.doc_id""",
)
def excerpt(spark, sf):
    return S.excerpt(tb.line_docs(spark, sf), ["doc_id"], tb.line_nodes(), 300)


# Documents whose text is shorter than 60 characters are emptied first, so that the anti join has work.
@register("empty_document", "SELECT doc_id, lang FROM documents WHERE length(text) < 60")
def empty_document(spark, sf):
    docs = tb.line_docs(spark, sf).withColumn(
        "text", F.when(F.length(F.replace("text", F.lit("\n\n"), F.lit("\n"))) < 60, " \n ").otherwise(F.col("text"))
    )
    segs = S.segment_documents(docs, ["doc_id"], tb.line_nodes(), 1000)
    return S.empty_document(docs.select("doc_id", "lang"), segs)


@register(
    "segments_by_language",
    Q.segments_with(1000)
    + """ SELECT d.lang, count(*) AS segments, count(DISTINCT s.doc_id) AS docs, sum(s.tokens_est) AS tokens,
          max(s.tokens_est) AS largest FROM segs s JOIN documents d USING (doc_id) GROUP BY d.lang""",
)
def segments_by_language(spark, sf):
    segs = S.segment_documents(tb.line_docs(spark, sf), ["lang"], tb.line_nodes(), 1000)
    # chunk 0 exists once per non-empty document, so no distinct is needed.
    return segs.groupBy("lang").agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("chunk_index") == 0).alias("docs"),
        F.sum("tokens_est").alias("tokens"),
        F.max("tokens_est").alias("largest"),
    )
