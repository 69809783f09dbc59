"""SQL fragments shared by the DuckDB counterparts (formulated differently from the Spark side)."""

from __future__ import annotations


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def tokens(x: str) -> str:
    return (
        f"CAST(greatest(floor(length({x}) / 3.8::DOUBLE), "
        f"floor(len(regexp_extract_all({x}, '\\S+')) * 1.3::DOUBLE)) AS INTEGER)"
    )


def tokens_from(chars: str, words: str) -> str:
    return f"greatest(floor(({chars}) / 3.8::DOUBLE), floor(({words}) * 1.3::DOUBLE))"


def escape(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        f"'\"', '&quot;'), '''', '&#x27;')"
    )


def escape_text(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def inline(x: str) -> str:
    return f"replace(regexp_replace({escape(x)}, '`([^`\\n]+)`', '<code>\\1</code>', 'g'), chr(10), '<br/>')"


def split_rows(source: str, keys: str, text: str, sep: str, alias: str = "piece") -> str:
    """Rows (keys, p, piece) of a split, empties dropped after stripping, p renumbered from 0."""
    return (
        f"SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys.split(',')[0]} ORDER BY p) - 1 AS INTEGER) AS node_idx, "
        f"{alias} FROM (SELECT {keys}, p, {strip('piece')} AS {alias} FROM (SELECT {keys}, "
        f"unnest(string_split({text}, {sep})) AS piece, generate_subscripts(string_split({text}, {sep}), 1) AS p "
        f"FROM {source})) WHERE {alias} <> ''"
    )


LINES = f"lines AS ({split_rows('documents', 'doc_id, lang', 'text', 'chr(10)', 'block')})"

LINE_NODES = (
    LINES
    + f""",
nodes AS (SELECT doc_id, lang, node_idx, block AS plain, '<p>' || {inline('block')} || '</p>' AS html FROM lines)"""
)


def fragment_ctes(source: str, limit: int, tag: str = "p") -> str:
    """Oversized nodes of ``source`` (doc_id, node_idx, plain, html) -> ``units`` (doc_id, node_idx, frag, html)."""
    return f"""
sized AS (SELECT doc_id, node_idx, plain, html, {tokens('html')} AS tok FROM {source}),
sents AS (
  SELECT doc_id, node_idx, s, {strip('piece')} AS sentence FROM (
    SELECT doc_id, node_idx, unnest(parts) AS piece, generate_subscripts(parts, 1) AS s FROM (
      SELECT doc_id, node_idx,
             string_split(regexp_replace(regexp_replace(plain, '([.!?…])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS parts
      FROM sized WHERE tok > {limit}))
  WHERE {strip('piece')} <> ''),
long_words AS (
  SELECT doc_id, node_idx, s, unnest(ws) AS word, generate_subscripts(ws, 1) AS w
  FROM (SELECT doc_id, node_idx, s, regexp_extract_all(sentence, '\\S+') AS ws FROM sents WHERE {tokens('sentence')} > {limit})),
packable AS (
  SELECT doc_id, node_idx, row_number() OVER (PARTITION BY doc_id, node_idx ORDER BY s, w) AS k,
         piece, length(piece) AS chars, words, grp
  FROM (
    SELECT doc_id, node_idx, s, 0 AS w, sentence AS piece, len(regexp_extract_all(sentence, '\\S+')) AS words, -1 AS grp
    FROM sents WHERE {tokens('sentence')} <= {limit}
    UNION ALL SELECT doc_id, node_idx, s, w, word, 1, s FROM long_words)),
fill AS (
  SELECT doc_id, node_idx, k, chars, words, grp, 0 AS frag FROM packable WHERE k = 1
  UNION ALL
  SELECT doc_id, node_idx, k,
         CASE WHEN fresh THEN uc ELSE nc END, CASE WHEN fresh THEN uw ELSE nw END, grp,
         CASE WHEN fresh THEN frag + 1 ELSE frag END
  FROM (
    SELECT u.doc_id, u.node_idx, u.k, u.chars AS uc, u.words AS uw, f.chars + 1 + u.chars AS nc,
           f.words + u.words AS nw, u.grp, f.frag,
           (u.grp <> f.grp OR {tokens_from('f.chars + 1 + u.chars', 'f.words + u.words')} > {limit}) AS fresh
    FROM fill f JOIN packable u ON u.doc_id = f.doc_id AND u.node_idx = f.node_idx AND u.k = f.k + 1)),
units AS (
  SELECT doc_id, node_idx, 0 AS frag, html FROM sized WHERE tok <= {limit}
  UNION ALL
  SELECT f.doc_id, f.node_idx, f.frag,
         '<{tag}>' || {escape_text("string_agg(u.piece, ' ' ORDER BY u.k)")} || '</{tag}>'
  FROM fill f JOIN packable u ON u.doc_id = f.doc_id AND u.node_idx = f.node_idx AND u.k = f.k
  GROUP BY f.doc_id, f.node_idx, f.frag)"""


def pack_ctes(target: int, cap: int = 35) -> str:
    """``units`` -> ``segs`` (doc_id, chunk_index, text, tokens_est, node_list)."""
    return f"""
placed AS (SELECT doc_id, node_idx, html, {tokens('html')} AS tok,
                  row_number() OVER (PARTITION BY doc_id ORDER BY node_idx, frag) AS k FROM units),
pack AS (
  SELECT doc_id, k, tok AS cur, 1 AS cnt, 0 AS chunk FROM placed WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k,
         CASE WHEN c.cur + p.tok > {target} OR c.cnt >= {cap} THEN p.tok ELSE c.cur + p.tok END,
         CASE WHEN c.cur + p.tok > {target} OR c.cnt >= {cap} THEN 1 ELSE c.cnt + 1 END,
         CASE WHEN c.cur + p.tok > {target} OR c.cnt >= {cap} THEN c.chunk + 1 ELSE c.chunk END
  FROM pack c JOIN placed p ON p.doc_id = c.doc_id AND p.k = c.k + 1),
segs AS (
  SELECT c.doc_id, CAST(c.chunk AS INTEGER) AS chunk_index, string_agg(p.html, chr(10) || chr(10) ORDER BY p.k) AS text,
         CAST(sum(p.tok) AS INTEGER) AS tokens_est, string_agg(CAST(p.node_idx AS VARCHAR), ',' ORDER BY p.k) AS node_list
  FROM pack c JOIN placed p ON p.doc_id = c.doc_id AND p.k = c.k GROUP BY c.doc_id, c.chunk)"""


def segments_with(target: int) -> str:
    limit = max(target, int(target * 1.15))
    return f"WITH RECURSIVE {LINE_NODES},{fragment_ctes('nodes', limit)},{pack_ctes(target)}"


def cycle(key: str, names) -> str:
    quoted = ", ".join(f"'{n}'" for n in names)
    return f"([{quoted}])[CAST({key} % {len(names)} AS INTEGER) + 1]"


def ts(n: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS BIGINT)))"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# Job and segment state: the same arithmetic as tables.state_jobs / tables.state_segments.
STATE = (
    segments_with(200)
    + f""",
segments AS (
  SELECT CAST(doc_id AS VARCHAR) AS job_id, doc_id, chunk_index, text AS original_text,
         CASE WHEN status = 'DONE' THEN replace(text, 'the', 'le') END AS translated_text, status,
         CASE WHEN status = 'FAILED' THEN 'timeout' END AS error_message, node_list, tokens_est, {ts('doc_id')} AS updated_at
  FROM (SELECT *, CASE WHEN s = 0 THEN 'FAILED' WHEN s = 1 THEN 'PROCESSING' WHEN s IN (2, 3) THEN 'PENDING' ELSE 'DONE' END AS status
        FROM (SELECT *, (doc_id * 7 + chunk_index * 3) % 10 AS s FROM segs))),
jobs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS job_id, d.doc_id,
         'doc_' || d.doc_id || '.' || {cycle('d.doc_id', ("epub", "pdf", "docx", "md", "txt"))} AS file_name,
         {cycle('d.doc_id', ("epub", "pdf", "docx", "md", "txt"))} AS file_type, d.lang AS source_lang,
         CASE WHEN d.lang = 'fr' THEN 'en' ELSE 'fr' END AS target_lang,
         CASE WHEN d.doc_id % 3 = 0 THEN 'gemma-base' ELSE 'base' END AS model,
         {cycle('d.doc_id', ("PENDING", "PROCESSING", "PAUSED", "COMPLETED", "FAILED"))} AS status,
         d.source AS glossary_name, 0.15::DOUBLE AS temperature, CAST(d.doc_id % 4 + 1 AS INTEGER) AS concurrency,
         200 AS chunk_size, CASE WHEN d.doc_id % 10 = 3 THEN 'proofreading' ELSE 'translation' END AS job_type,
         'shared/' || (d.doc_id % 50) AS source_path,
         'out/doc_' || d.doc_id || '.' || {cycle('d.doc_id', ("epub", "pdf", "docx", "md", "txt"))} AS output_path,
         CASE WHEN d.doc_id % 2 = 0 THEN 'lm-studio' ELSE 'openai' END AS api_type,
         {ts('d.doc_id')} AS created_at, CASE WHEN d.doc_id % 5 = 3 THEN {ts('d.doc_id + 30')} END AS completed_at,
         CAST(coalesce(c.total_chunks, 0) AS INTEGER) AS total_chunks,
         CAST(coalesce(c.completed_chunks, 0) AS INTEGER) AS completed_chunks
  FROM documents d LEFT JOIN (
    SELECT job_id, count(*) AS total_chunks, count(*) FILTER (status = 'DONE') AS completed_chunks
    FROM segments GROUP BY job_id) c ON c.job_id = CAST(d.doc_id AS VARCHAR))"""
)

# HTML: a token walk with an explicit stack per page.
_TOKEN = (
    "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script[^>]*>|<style\\b[^>]*>.*?</style[^>]*>|<[!?][^>]*>|</[a-z][^>]*>"
    "|<[a-z](?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>|[^<]+|<"
)
_BLOCKS = "'p','h1','h2','h3','h4','h5','h6','li','blockquote','caption','figcaption'"
_VOIDS = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr'"
_CLOSE = "array_to_string(list_transform(list_reverse({0}), lambda x: '</' || x || '>'), '')"


def html_ctes(source: str, prefix: str = "html") -> str:
    """``source`` (page_id, html) -> ``<prefix>_all`` (page_id, k, tag, nested, html): every block element."""
    return f"""
{prefix}_toks AS (
  SELECT page_id, k, tok, name, CASE WHEN name = '' OR regexp_matches(tok, '(?i)^<(script|style)\\b') THEN 't'
    WHEN tok LIKE '</%' THEN 'c' WHEN name IN ({_VOIDS}) THEN 'v' ELSE 'o' END AS kind
  FROM (SELECT page_id, k, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name
        FROM (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS k
              FROM (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS ts FROM {source})))),
{prefix}_walk AS (
  SELECT page_id, 0 AS k, 't' AS kind, '' AS name, CAST([] AS VARCHAR[]) AS before, CAST([] AS VARCHAR[]) AS after, '' AS emit
  FROM {source}
  UNION ALL
  SELECT page_id, k, kind, name, before,
    CASE WHEN kind = 'o' THEN list_append(before, name) WHEN kind = 'c' AND hit > 0 THEN before[1:hit - 1] ELSE before END,
    CASE WHEN kind = 'o' THEN '<' || name || attrs || '>' WHEN kind = 'v' THEN '<' || name || attrs || '/>'
         WHEN kind = 'c' THEN CASE WHEN hit > 0 THEN {_CLOSE.format('before[hit:]')} ELSE '' END ELSE tok END
  FROM (
    SELECT t.page_id, t.k, t.kind, t.name, t.tok, w.after AS before,
           regexp_extract(t.tok, '(?s)^<[a-zA-Z][^\\s/>]*(.*?)\\s*/?>$', 1) AS attrs,
           CASE WHEN list_contains(w.after, t.name) THEN len(w.after) - list_position(list_reverse(w.after), t.name) + 1 ELSE 0 END AS hit
    FROM {prefix}_walk w JOIN {prefix}_toks t ON t.page_id = w.page_id AND t.k = w.k + 1)),
{prefix}_last AS (SELECT page_id, max(k) AS last_k, arg_max(after, k) AS final_stack FROM {prefix}_walk GROUP BY page_id),
{prefix}_open AS (
  SELECT o.page_id, o.k, o.name AS tag, len(o.after) AS depth,
         len(list_filter(o.before, lambda x: x IN ({_BLOCKS}))) > 0 AS nested,
         (SELECT min(e.k) FROM {prefix}_walk e WHERE e.page_id = o.page_id AND e.k > o.k AND len(e.after) < len(o.after)) AS stop
  FROM {prefix}_walk o WHERE o.kind = 'o' AND o.name IN ({_BLOCKS})),
{prefix}_ends AS (
  SELECT b.page_id, b.k, b.tag, b.nested, coalesce(b.stop, l.last_k + 1) AS stop,
         CASE WHEN b.stop IS NULL THEN {_CLOSE.format('l.final_stack[b.depth:]')}
              ELSE {_CLOSE.format('s.before[b.depth:]')} END AS tail
  FROM {prefix}_open b JOIN {prefix}_last l ON l.page_id = b.page_id
  LEFT JOIN {prefix}_walk s ON s.page_id = b.page_id AND s.k = b.stop),
{prefix}_all AS (
  SELECT e.page_id, e.k, e.tag, e.nested, coalesce(string_agg(w.emit, '' ORDER BY w.k), '') || e.tail AS html
  FROM {prefix}_ends e JOIN {prefix}_walk w ON w.page_id = e.page_id AND w.k >= e.k AND w.k < e.stop
  GROUP BY e.page_id, e.k, e.tag, e.nested, e.tail)"""


def tagless(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


ACTIVE = "html"
for _tag in ("script", "style", "iframe", "object"):
    ACTIVE = f"regexp_replace({ACTIVE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
ACTIVE = f"regexp_replace({ACTIVE}, '(?is)</?embed\\b[^>]*>', '', 'g')"

# Markdown: the dressed documents and their classified blocks.
MD_BLOCKS = (
    LINES
    + """,
dressed AS (
  SELECT doc_id, node_idx AS i, CASE WHEN doc_id % 4 = 0 THEN
      CASE WHEN node_idx % 13 = 0 THEN '```' || chr(10) || 'CHAPTER ' || node_idx || ': ' || block || chr(10) || 'CHAPTER ' || (node_idx + 1) || ': ' || block || chr(10) || '```'
           WHEN node_idx % 6 = 0 THEN '```text' || chr(10) || block || chr(10) || '```'
           ELSE '```' || chr(10) || block || chr(10) || '```' END
    ELSE CASE WHEN node_idx % 11 = 0 THEN '# ' || block WHEN node_idx % 5 = 0 THEN '- ' || block
              WHEN node_idx % 7 = 0 THEN '> ' || block WHEN node_idx % 3 = 0 THEN '`' || block || '`' ELSE block END END AS block
  FROM lines)"""
)

MD_NODES = (
    MD_BLOCKS
    + f""",
md_conv AS (
  SELECT doc_id, count(*) AS blocks,
         count(*) >= 8 AND count(*) FILTER (block LIKE '```' || chr(10) || '%') >= 8
         AND count(*) FILTER (block LIKE '```' || chr(10) || '%') / count(*)::DOUBLE >= 0.35 AS converter
  FROM dressed GROUP BY doc_id),
md_kinds AS (
  SELECT d.doc_id, d.i, d.block, c.converter,
         CASE WHEN block LIKE '```%' || chr(10) || '%```' THEN 'fence'
              WHEN regexp_matches(block, '^#{{1,6}}\\s+\\S') THEN 'heading'
              WHEN regexp_matches(block, '^\\s*(?:[-+*]|\\d+[.)])\\s+\\S') THEN 'list_item'
              WHEN block LIKE '>%' THEN 'blockquote' ELSE 'paragraph' END AS kind,
         string_split(block, chr(10)) AS ls
  FROM dressed d JOIN md_conv c ON c.doc_id = d.doc_id),
md_inner AS (
  SELECT doc_id, i, 0 AS sub, 1 AS parts, kind, converter, block,
    CASE WHEN kind = 'fence' THEN array_to_string(ls[2:-2], ' ')
         WHEN kind = 'heading' THEN {strip("regexp_extract(block, '^#{1,6}\\s+(.+)$', 1)")}
         WHEN kind = 'list_item' THEN {strip("regexp_extract(block, '^\\s*(?:[-+*]|\\d+[.)])\\s+(.+)$', 1)")}
         WHEN kind = 'blockquote' THEN regexp_replace(block, '^>\\s?', '') ELSE block END AS body
  FROM md_kinds WHERE NOT (kind = 'fence' AND ls[1] = '```' AND len(ls) = 4)
  UNION ALL
  SELECT doc_id, i, sub, 2, 'fence_heading_line', converter, block, ls[sub + 2]
  FROM md_kinds, (SELECT unnest([0, 1]) AS sub) WHERE kind = 'fence' AND ls[1] = '```' AND len(ls) = 4),
md_nodes AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1 AS INTEGER) AS node_idx, i, sub, parts, kind,
    CASE WHEN kind = 'heading' THEN 'h' || length(regexp_extract(block, '^(#{{1,6}})', 1))
         WHEN kind = 'list_item' THEN 'li' WHEN kind = 'blockquote' THEN 'blockquote' ELSE 'p' END AS tag,
    CASE WHEN kind = 'list_item' THEN regexp_extract(block, '^(\\s*(?:[-+*]|\\d+[.)])\\s+)', 1) END AS marker,
    CASE WHEN kind IN ('heading', 'list_item', 'blockquote', 'paragraph') AND regexp_full_match(body, '`[^`\\n]+`') THEN '`' END AS code_wrapper,
    CASE WHEN kind LIKE 'fence%' THEN string_split(block, chr(10))[1] END AS fence_open,
    kind LIKE 'fence%' AND converter AND string_split(block, chr(10))[1] = '```' AS suppress_fence,
    CASE WHEN kind IN ('heading', 'list_item', 'blockquote', 'paragraph') AND regexp_full_match(body, '`[^`\\n]+`')
         THEN body[2:-2] ELSE body END AS plain
  FROM md_inner)"""
)
MD_HTML = f"'<' || tag || '>' || {inline('plain')} || '</' || tag || '>'"
