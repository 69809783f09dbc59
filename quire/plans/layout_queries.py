"""Registered queries: layout tables, text runs and inference, on tables derived from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import paragraph_blocks
from quire.functions.core import let, words_of
from quire.operators import infer as E
from quire.operators import layout as L
from quire.operators import rebuild as R
from quire.operators import runs as W
from quire.plans import sql as Q
from quire.plans import tables as tb
from quire.session import settle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# ---- spans: twelve source lines per page, each in three spans on two lines, plus head and number -----


def third_cuts(words):
    """Words cut in three by position: floor(n/3), floor(n/3), rest."""
    k = F.floor(F.size(words) / 3).cast("int")
    return (
        F.array_join(F.slice(words, F.lit(1), k), " "),
        F.array_join(F.slice(words, k + 1, k), " "),
        F.array_join(F.slice(words, 2 * k + 1, F.size(words)), " "),
    )


def span_lines(spark, sf):
    rows = tb.documents(spark, sf).select(
        "doc_id", "source", F.posexplode(paragraph_blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("i", "line")
    )
    a, b, c = third_cuts(F.col("ws"))
    return rows.withColumn("ws", words_of(F.col("line"))).select(
        "doc_id", "source", "i", (F.floor(F.col("i") / 12) + 1).cast("int").alias("page_num"),
        (F.col("i") % 12 + 1).alias("block_idx"), a.alias("a"), b.alias("b"), c.alias("c"),
    )


def spans(spark, sf):
    """Span rows of every page; the first line of a page also brings its running head and page number."""
    i = F.col("i")
    size = F.when(i % 17 == 0, 18.0).when(i % 7 == 0, 12.5).otherwise(11.0)

    def span(line, pos, text, sz, font, flags, color):
        return F.struct(
            F.lit(line).alias("line_idx"), F.lit(pos).alias("span_idx"), text.alias("text"), sz.alias("size"),
            font.alias("font"), flags.alias("flags"), F.lit(color).alias("color"),
        )

    def block(idx, members, x0, y0, x1, y1):
        return F.struct(
            idx.cast("int").alias("block_idx"), F.array(*members).alias("spans"), x0.alias("x0"), y0.alias("y0"),
            x1.alias("x1"), y1.alias("y1"),
        )

    def margin(idx, text, top):
        member = span(0, 0, text, F.lit(9.0), F.lit("Serif"), F.lit(0), 0)
        return block(F.lit(idx), [member], F.lit(200.0), F.lit(top), F.lit(300.0), F.lit(top + 10))

    bold = F.when(i % 17 == 0, F.lit(16)).otherwise(F.lit(0))
    italic = F.when(i % 5 == 0, F.lit("Serif-Italic")).otherwise(F.lit("Serif"))
    head = F.when((F.col("a") != "") & (i % 4 == 1), F.concat("a", F.lit("-"))).otherwise(F.col("a"))
    wide = i % 7 == 0
    y0 = (60 + 45 * (i % 12)).cast("double")
    line_block = block(
        F.col("block_idx"),
        [
            span(0, 0, head, size, F.lit("Serif"), bold, 0),
            span(1, 0, F.when(F.col("b") != "", F.concat("b", F.lit(" "))).otherwise(""), size + 0.3, italic, F.lit(0), 255),
            span(1, 1, F.col("c"), size, F.lit("Serif"), F.lit(0), 0),
        ],
        F.when(wide, 150.0).otherwise(50.0), y0, F.when(wide, 350.0).otherwise(450.0), y0 + 30,
    )
    margins = F.array(margin(0, F.col("source"), 20.0), margin(13, F.col("page_num").cast("string"), 660.0))
    blocks = F.when(i % 12 == 0, F.concat(F.array(line_block), margins)).otherwise(F.array(line_block))
    return (
        span_lines(spark, sf).select("doc_id", "page_num", F.explode(blocks).alias("k"))
        .select(
            "doc_id", "page_num", "k.block_idx", F.explode("k.spans").alias("s"), "k.x0", "k.y0", "k.x1", "k.y1",
            F.lit(500.0).alias("page_w"), F.lit(700.0).alias("page_h"),
        )
        .select("doc_id", "page_num", "block_idx", "s.*", "x0", "y0", "x1", "y1", "page_w", "page_h")
    )


def page_table(spark, sf):
    n = F.size(paragraph_blocks(F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    numbers = F.explode(let(F.ceil(n / 12).cast("int"), lambda k: F.when(k > 0, F.sequence(F.lit(1), k))))
    return tb.documents(spark, sf).select(
        "doc_id", numbers.alias("page_num"), F.lit(500.0).alias("page_w"), F.lit(700.0).alias("page_h")
    )


def images(spark, sf):
    """One image per page over 60 % or 10 % of it; it sticks out of the left edge, which must be clipped."""
    share = F.when((F.col("doc_id") + F.col("page_num")) % 9 == 0, 0.6).otherwise(0.1)
    return page_table(spark, sf).select(
        "doc_id", "page_num", F.lit(-40.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), (share * 700).alias("y1")
    )


SPAN_SQL = f"""{Q.LINES},
cut AS (SELECT doc_id, node_idx AS i, node_idx // 12 + 1 AS page_num, node_idx % 12 + 1 AS block_idx, ws, len(ws) // 3 AS n
        FROM (SELECT doc_id, node_idx, regexp_extract_all(block, '\\S+') AS ws FROM lines)),
abc AS (SELECT doc_id, i, page_num, block_idx, array_to_string(ws[1:n], ' ') AS a, array_to_string(ws[n + 1:2 * n], ' ') AS b,
        array_to_string(ws[2 * n + 1:], ' ') AS c, CASE WHEN i % 17 = 0 THEN 18.0 WHEN i % 7 = 0 THEN 12.5 ELSE 11.0 END AS base FROM cut),
body AS (SELECT *, a || CASE WHEN a <> '' AND i % 4 = 1 THEN '-' ELSE '' END AS l0, trim(b || ' ' || c) AS l1, length(a) + CASE WHEN a <> '' AND i % 4 = 1 THEN 1 ELSE 0 END AS wa,
        length(b) AS wb, length(c) AS wc FROM abc),
flags AS (SELECT *, l0 LIKE '%-' AND regexp_matches(l1, '^\\p{{Ll}}') AS glued FROM body),
cands AS (
  SELECT doc_id, page_num, block_idx, i, CASE WHEN l0 = '' THEN l1 WHEN glued THEN l0[:-2] || l1 ELSE l0 || ' ' || l1 END AS plain_text,
    CASE WHEN l0 = '' THEN {Q.escape_text('c')} ELSE
      CASE WHEN i % 17 = 0 THEN '<strong>' ELSE '' END || {Q.escape_text("CASE WHEN glued THEN l0[:-2] ELSE l0 END")} || CASE WHEN i % 17 = 0 THEN '</strong>' ELSE '' END
      || CASE WHEN glued THEN '' ELSE ' ' END
      || CASE WHEN i % 5 = 0 THEN '<em>' || {Q.escape_text('b')} || ' </em>' ELSE {Q.escape_text('b')} || ' ' END || {Q.escape_text('c')} END AS inner_html,
    base, base + 0.5 AS mid, wa, wb, wc, CASE WHEN wa + wc >= wb THEN base ELSE base + 0.5 END AS font_size, i % 7 = 0 AS centered,
    i % 17 = 0 AND wa >= (wa + wb + wc) * 0.55 AS mostly_bold, i % 5 = 0 AND wb >= (wa + wb + wc) * 0.65 AS mostly_italic, i % 12 = 0 AS in_margin
  FROM flags
  UNION ALL SELECT DISTINCT b.doc_id, page_num, 0, -1, source, source, 9.0, 9.0, length(source), 0, 0, 9.0, TRUE, FALSE, FALSE, TRUE
  FROM body b JOIN documents d ON d.doc_id = b.doc_id
  UNION ALL SELECT DISTINCT doc_id, page_num, 13, -1, CAST(page_num AS VARCHAR), CAST(page_num AS VARCHAR), 9.0, 9.0, length(CAST(page_num AS VARCHAR)), 0, 0, 9.0, TRUE, FALSE, FALSE, TRUE FROM body),
size_rows AS (SELECT doc_id, page_num, block_idx, 0 AS o, base AS size, wa + wc AS w FROM cands WHERE wa + wc > 0
   UNION ALL SELECT doc_id, page_num, block_idx, 1, mid, wb FROM cands WHERE wb > 0),
size_sums AS (SELECT doc_id, size, sum(w) AS w, min(page_num * 1000 + block_idx * 10 + o) AS seen FROM size_rows GROUP BY doc_id, size),
body_size AS (SELECT doc_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, seen) AS r FROM size_sums) WHERE r = 1),
repeats AS (SELECT doc_id, lower(plain_text) AS signature FROM cands WHERE in_margin GROUP BY doc_id, lower(plain_text) HAVING count(*) >= 3),
profile AS (SELECT DISTINCT doc_id, page_num, (doc_id + page_num) % 9 = 0 AS passthrough FROM body),
roled AS (SELECT *, CASE WHEN top THEN 'h1' WHEN second THEN 'h2' ELSE 'p' END AS tag,
    CASE WHEN top THEN 'chapter' WHEN second AND chapter THEN 'toc' WHEN second THEN 'section' ELSE 'body' END AS role
  FROM (SELECT *, font_size >= body_size * 1.45 OR (chapter AND font_size >= body_size * 1.30) OR (mostly_bold AND font_size >= body_size * 1.20 AND length(plain_text) <= 180) AS top,
          centered AND length(plain_text) <= 180 AND (font_size >= body_size * 1.07 OR chapter) AS second
        FROM (SELECT *, regexp_matches(plain_text, '(?i)^(chapter|chapitre|part|partie|book|livre|volume|prologue|epilogue|épilogue)\\b') AS chapter
              FROM cands JOIN body_size USING (doc_id))))"""
_NUMBER = "regexp_full_match(plain_text, '(?i)(\\d{1,4}|[ivxlcdm]{1,8})(\\s+\\d{1,4})?')"


@register(
    "pdf_candidates",
    f"WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, plain_text, inner_html, font_size, centered, mostly_bold, mostly_italic, lower(plain_text) AS signature FROM cands",
)
def pdf_candidates(spark, sf):
    return L.pdf_candidates(spans(spark, sf)).select(
        "doc_id", "page_num", "block_idx", "plain_text", "inner_html", "font_size", "centered", "mostly_bold",
        "mostly_italic", "signature",
    )


def candidates(spark, sf):
    """Blocks built once for the queries that read them more than once."""
    return settle(L.pdf_candidates(spans(spark, sf)), "candidates")


@register("pdf_body_size", f"WITH {SPAN_SQL} SELECT doc_id, body_size FROM body_size")
def pdf_body_size(spark, sf):
    return L.pdf_body_size(candidates(spark, sf))


@register(
    "pdf_margin_repeats",
    f"WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, plain_text FROM cands c WHERE NOT EXISTS (SELECT 1 FROM repeats r WHERE r.doc_id = c.doc_id AND r.signature = lower(c.plain_text))",
)
def pdf_margin_repeats(spark, sf):
    return L.pdf_margin_repeats(candidates(spark, sf)).select("doc_id", "page_num", "block_idx", "plain_text")


@register("pdf_page_numbers", f"WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, plain_text FROM cands WHERE NOT {_NUMBER}")
def pdf_page_numbers(spark, sf):
    return L.pdf_page_numbers(candidates(spark, sf)).select("doc_id", "page_num", "block_idx", "plain_text")


@register(
    "pdf_page_profile",
    f"WITH {SPAN_SQL} SELECT doc_id, page_num, TRUE AS has_text, TRUE AS has_images, CASE WHEN passthrough THEN 0.6 ELSE 0.1 END AS image_ratio, passthrough FROM profile",
)
def pdf_page_profile(spark, sf):
    profile = L.pdf_page_profile(page_table(spark, sf), candidates(spark, sf), images(spark, sf))
    return profile.withColumn("image_ratio", F.round("image_ratio", 6))


@register("pdf_roles", f"WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, body_size, tag, role FROM roled")
def pdf_roles(spark, sf):
    return L.pdf_roles(candidates(spark, sf)).select("doc_id", "page_num", "block_idx", "body_size", "tag", "role")


@register(
    "pdf_nodes",
    f"""WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, block_idx) - 1 AS INTEGER) AS node_idx, tag, role,
        '<' || tag || '>' || inner_html || '</' || tag || '>' AS html
    FROM roled c JOIN profile USING (doc_id, page_num) WHERE NOT passthrough AND NOT {_NUMBER}
      AND NOT EXISTS (SELECT 1 FROM repeats r WHERE r.doc_id = c.doc_id AND r.signature = lower(c.plain_text))""",
)
def pdf_nodes(spark, sf):
    return L.pdf_nodes(spans(spark, sf), page_table(spark, sf), images(spark, sf))


@register(
    "pdf_nodes_legacy",
    f"""WITH {SPAN_SQL}, old AS (
      SELECT doc_id, page_num, block_idx, trim(l0 || ' ' || l1) AS text,
        (CASE WHEN a <> '' THEN base ELSE 0 END + CASE WHEN b <> '' THEN base + 0.3 ELSE 0 END + base)
          / (1 + CASE WHEN a <> '' THEN 1 ELSE 0 END + CASE WHEN b <> '' THEN 1 ELSE 0 END) AS font_size,
        i % 7 = 0 AS narrow, i % 17 = 0 AND a <> '' AS is_bold, i % 5 = 0 AND b <> '' AS is_italic FROM body
      UNION ALL SELECT doc_id, page_num, block_idx, plain_text, 9.0, TRUE, FALSE, FALSE FROM cands WHERE block_idx IN (0, 13)),
    tagged AS (SELECT *, CASE WHEN font_size >= 15 THEN 'h1' WHEN font_size >= 12.5 THEN 'h2' ELSE 'p' END AS tag FROM old)
    SELECT doc_id, page_num, block_idx, round(font_size::DOUBLE, 4) AS font_size, 0 AS color, CASE WHEN narrow THEN 'center' ELSE 'center' END AS align, is_bold, is_italic, tag,
      '<' || tag || '>' || {Q.escape_text('text')} || '</' || tag || '>' AS html
    FROM tagged WHERE NOT regexp_full_match(text, '(?i)(\\d{{1,4}}|[ivxlcdm]{{1,8}})(\\s+\\d{{1,4}})?')""",
)
def pdf_nodes_legacy(spark, sf):
    return L.pdf_nodes_legacy(spans(spark, sf)).withColumn("font_size", F.round("font_size", 4))


@register(
    "pdf_outline",
    f"""WITH {SPAN_SQL}, t AS (SELECT doc_id, page_num, block_idx, {Q.strip("regexp_replace(l0 || ' ' || b || ' ' || c, '\\s+', ' ', 'g')")} AS title FROM body WHERE i % 17 = 0)
    SELECT doc_id, page_num, block_idx, 1 AS level, title FROM t WHERE title <> '' AND length(title) <= 220""",
)
def pdf_outline(spark, sf):
    return L.pdf_outline(spans(spark, sf))


@register(
    "export_loss_check",
    f"""WITH {SPAN_SQL}, want AS (SELECT doc_id, sum(length(plain_text)) + count(*) - 1 AS n FROM cands GROUP BY doc_id),
    page_text AS (SELECT doc_id, page_num, CASE WHEN (doc_id + page_num) % 13 = 0 THEN '' ELSE string_agg(CASE WHEN doc_id % 7 = 0 THEN substr(plain_text, 1, 20) ELSE plain_text END, ' ' ORDER BY block_idx) END
        || CASE WHEN doc_id % 11 = 0 THEN chr(65533) ELSE '' END AS t FROM cands GROUP BY doc_id, page_num),
    pages_out AS (SELECT p.*, passthrough FROM page_text p JOIN profile USING (doc_id, page_num)),
    got AS (SELECT doc_id, length(regexp_replace(trim(string_agg(t, ' ')), '\\s+', ' ', 'g')) AS n, bool_or(NOT passthrough AND t = '') AS empty_page, bool_or(t LIKE '%' || chr(65533) || '%') AS bad FROM pages_out GROUP BY doc_id)
    SELECT doc_id, want.n AS expected_chars, got.n AS rebuilt_chars, CASE WHEN empty_page THEN 'empty page' WHEN bad THEN 'invalid characters' WHEN got.n < want.n * 0.88::DOUBLE THEN 'text lost' END AS problem
    FROM want JOIN got USING (doc_id)""",
)
def export_loss_check(spark, sf):
    cands = candidates(spark, sf)
    text = F.when(F.col("doc_id") % 7 == 0, F.substring("plain_text", 1, 20)).otherwise(F.col("plain_text"))
    joined = F.array_join(F.transform("ps", lambda p: p["t"]), " ")
    pages = cands.groupBy("doc_id", "page_num").agg(
        F.array_sort(F.collect_list(F.struct("block_idx", text.alias("t")))).alias("ps")
    ).select(
        "doc_id", "page_num",
        F.concat(
            F.when((F.col("doc_id") + F.col("page_num")) % 13 == 0, "").otherwise(joined),
            F.when(F.col("doc_id") % 11 == 0, "�").otherwise(""),
        ).alias("text"),
        ((F.col("doc_id") + F.col("page_num")) % 9 == 0).alias("passthrough"),
    )
    return L.export_loss_check(pages, cands.select("doc_id", F.col("plain_text").alias("text")))


@register(
    "role_markup",
    f"""WITH {SPAN_SQL} SELECT doc_id, page_num, block_idx, CASE role WHEN 'chapter' THEN '<h1 class="chapter-title">' || inner_html || '</h1>'
        WHEN 'toc' THEN '<h2 class="toc-entry">' || inner_html || '</h2>' WHEN 'section' THEN '<h2 class="section-title">' || inner_html || '</h2>'
        ELSE '<p>' || inner_html || '</p>' END AS html FROM roled""",
)
def role_markup(spark, sf):
    facts = L.block_facts(L.pdf_candidates(spans(spark, sf))).drop("signature", "page_number")
    roled = L.roles_of(settle(facts, "candidates"))
    html = F.concat(F.lit('<p id="x">'), "inner_html", F.lit("</p>"))
    return roled.select("doc_id", "page_num", "block_idx", L.role_markup(html, F.col("role")).alias("html"))


@register(
    "page_groups",
    f"""WITH {SPAN_SQL}, g AS (SELECT *, sum(CASE WHEN passthrough THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num) AS grp FROM profile)
    SELECT doc_id, page_num, CAST(grp AS INTEGER) AS reflow_group FROM g WHERE NOT passthrough""",
)
def page_groups(spark, sf):
    pages = page_table(spark, sf).withColumn("passthrough", (F.col("doc_id") + F.col("page_num")) % 9 == 0)
    return R.page_groups(pages.select("doc_id", "page_num", "passthrough"))


# ---- text runs: each line is a paragraph of three runs; every third line sits in a table ------------


def runs(spark, sf):
    i, in_table = F.col("i"), F.col("i") % 3 == 2
    null_int = F.lit(None).cast("int")
    lines = span_lines(spark, sf)
    style = F.when(~in_table & (i % 11 == 0), "Heading 1").when(~in_table & (i % 7 == 0), "heading 2 char").otherwise("Normal")
    runs_of = F.array(
        *[
            F.struct(F.lit(k).alias("run_idx"), text.alias("text"), F.lit(k == 0).alias("bold"), F.lit(k == 1).alias("italic"),
                     (i % 5 == k).alias("underline"))
            for k, text in enumerate((
                F.when(F.col("a") != "", F.concat("a", F.lit(" "))).otherwise(""),
                F.when(F.col("b") != "", F.concat("b", F.lit(" "))).otherwise(""),
                F.col("c"),
            ))
        ]
    )
    return lines.select(
        "doc_id",
        F.when(in_table, "table_paragraph").otherwise("paragraph").alias("kind"),
        F.when(in_table, F.lit(0)).otherwise(null_int).alias("table_idx"),
        F.when(in_table, F.floor(i / 6).cast("int")).otherwise(null_int).alias("row_idx"),
        F.when(in_table, F.floor(i / 3).cast("int") % 2).otherwise(null_int).alias("col_idx"),
        F.when(in_table, F.lit(0)).otherwise(i).alias("par_idx"),
        style.alias("style_name"), F.explode(runs_of).alias("r"),
    ).select("doc_id", "kind", "table_idx", "row_idx", "col_idx", "par_idx", "r.*", "style_name")


_U = lambda k, x: f"CASE WHEN i % 5 = {k} THEN '<u>' || {x} || '</u>' ELSE {x} END"
RUN_SQL = f"""{SPAN_SQL},
paras AS (SELECT *, i % 3 = 2 AS in_table, CASE WHEN i % 3 <> 2 AND i % 11 = 0 THEN 'h1' WHEN i % 3 <> 2 AND i % 7 = 0 THEN 'h2' ELSE 'p' END AS tag,
   CASE WHEN a <> '' THEN {_U(0, "'<b>' || " + Q.escape("a || ' '") + " || '</b>'")} ELSE '' END
   || CASE WHEN b <> '' THEN {_U(1, "'<i>' || " + Q.escape("b || ' '") + " || '</i>'")} ELSE '' END || {_U(2, Q.escape("c"))} AS inner_html
   FROM abc)"""


@register(
    "docx_nodes",
    f"""WITH {RUN_SQL} SELECT doc_id, CASE WHEN in_table THEN 'table_paragraph' ELSE 'paragraph' END AS kind,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY in_table, i) - 1 AS INTEGER) AS node_idx, tag, '<' || tag || '>' || inner_html || '</' || tag || '>' AS html FROM paras""",
)
def docx_nodes(spark, sf):
    return W.docx_nodes(runs(spark, sf)).select("doc_id", "kind", "node_idx", "tag", "html")


def _cut_sql(at: str, seen: str, first: bool) -> str:
    """End of a run that starts at ``at``: the proportional one, or behind the last blank before it."""
    ideal = f"(CASE WHEN total > 0 THEN CAST(round_even(length(t) * {seen} / total::DOUBLE, 0) AS INTEGER) ELSE {'length(t)' if first else at} END)"
    window = f"substr(t, {at} + 1, greatest({ideal}, {at}) - {at} + 1)"
    blank = f"({at} + length({window}) - instr(reverse({window}), ' '))"
    return f"greatest({at}, CASE WHEN total > 0 AND instr({window}, ' ') > 0 AND {blank} > {at} THEN {blank} + 1 ELSE {ideal} END)"


_CUT = f"""WITH {RUN_SQL}, src AS (SELECT *, CASE WHEN a <> '' THEN a || ' ' ELSE '' END AS r0, CASE WHEN b <> '' THEN b || ' ' ELSE '' END AS r1, c AS r2 FROM paras),
   x AS (SELECT *, replace(r0 || r1 || r2, 'e', 'eh') AS t, length(r0 || r1 || r2) AS total FROM src),
   x0 AS (SELECT *, {_cut_sql('0', 'length(r0)', True)} AS e0 FROM x),
   x1 AS (SELECT *, {_cut_sql('e0', 'length(r0 || r1)', False)} AS e1 FROM x0),
   ps AS (SELECT *, unnest([0, 1, 2]) AS run_idx, unnest([substr(t, 1, e0), substr(t, e0 + 1, e1 - e0), substr(t, e1 + 1)]) AS text FROM x1)
   SELECT doc_id, CASE WHEN in_table THEN 'table_paragraph' ELSE 'paragraph' END AS kind, CASE WHEN in_table THEN 0 END AS table_idx,
     CASE WHEN in_table THEN CAST(i // 6 AS INTEGER) END AS row_idx, CASE WHEN in_table THEN CAST(i // 3 % 2 AS INTEGER) END AS col_idx,
     CAST(CASE WHEN in_table THEN 0 ELSE i END AS INTEGER) AS par_idx, run_idx, text FROM ps"""


@register("redistribute_runs", _CUT)
def redistribute_runs(spark, sf):
    table = runs(spark, sf)
    whole = table.groupBy(*W.PARAGRAPH).agg(F.array_sort(F.collect_list(F.struct("run_idx", "text"))).alias("ts"))
    new = whole.select(*W.PARAGRAPH, F.replace(F.array_join(F.transform("ts", lambda x: x["text"]), ""), F.lit("e"), F.lit("eh")).alias("new_text"))
    return W.redistribute_runs(table, new)


# ---- inference ---------------------------------------------------------------------------------


def requests(spark, sf, target):
    return tb.segments(spark, sf, target).select(
        F.col("doc_id").cast("string").alias("job_id"), "chunk_index", F.col("text").alias("source_html"),
        F.lit("Translate.").alias("system_prompt"), F.lit("base").alias("model"), F.lit(0.15).alias("temperature"),
    )


_TRANSLATED = "replace(replace(text, chr(10) || chr(10), chr(10)), 'the', 'le')"


@register(
    "output_budget",
    Q.STATE
    + """ SELECT job_id, chunk_index, CAST(CASE WHEN doc_id % 2 = 0 THEN least(6000, greatest(CASE WHEN doc_id % 6 = 0 THEN 3000 ELSE 1200 END, floor(est * 1.5::DOUBLE)))
        ELSE least(16384, greatest(4500, floor(est * 1.6::DOUBLE))) END AS INTEGER) AS budget
      FROM (SELECT *, greatest(1, length(original_text) // 3) AS est FROM segments)""",
)
def output_budget(spark, sf):
    n = F.col("job_id").cast("long")
    provider = F.when(n % 2 == 0, "lm-studio").otherwise("openai")
    model = F.when(n % 6 == 0, "GPT-OSS-x").otherwise("base")
    return tb.state_segments(spark, sf).select(
        "job_id", "chunk_index", E.output_budget(F.col("original_text"), provider, model).alias("budget")
    )


@register(
    "retry_disposition",
    """WITH a AS (SELECT event_id, event_id % 4 + 1 AS attempt, CASE event_type WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'network' WHEN 'purchase' THEN 'other' ELSE 'status' END AS outcome,
         CASE WHEN event_type IN ('click', 'error') THEN [408, 409, 429, 400, 500, 503, 502][CAST(user_id % 7 AS INTEGER) + 1] END AS code FROM events),
    d AS (SELECT *, CASE WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'network' OR code IN (502, 503, 504) THEN 'provider_down' WHEN code = 400 THEN 'fatal'
         WHEN attempt >= 3 THEN 'exhausted' ELSE 'retry' END AS disposition FROM a)
    SELECT event_id, attempt, disposition, CASE WHEN disposition = 'retry' THEN CASE attempt WHEN 1 THEN 1.0 ELSE 2.0 END END AS wait_seconds FROM d""",
)
def retry_disposition(spark, sf):
    t = F.col("event_type")
    outcome = F.when(t == "view", "ok").when(t == "signup", "network").when(t == "purchase", "other").otherwise("status")
    code = F.element_at(F.array(*[F.lit(c) for c in (408, 409, 429, 400, 500, 503, 502)]), (F.col("user_id") % 7 + 1).cast("int"))
    attempts = tb.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 4 + 1).alias("attempt"), outcome.alias("outcome"),
        F.when(t.isin("click", "error"), code).alias("status_code"),
    )
    return E.retry_disposition(attempts).select("event_id", "attempt", "disposition", "wait_seconds")


def flaky(inner):
    """A model that refuses some texts, thinks without answering on others, and is unreachable under one name."""

    def model(prompt, text, name, temperature):
        if name == "away":
            raise E.ProviderDown("offline")
        if len(text) % 10 == 3:
            raise E.FatalModelError("refused")
        if len(text) % 10 == 5:
            return "<think>hm</think>"
        return "<think>hm</think>" + inner(prompt, text, name, temperature)

    return model


@register(
    "translate_segments",
    Q.segments_with(200)
    + f""", r AS (SELECT *, length(text) % 10 AS l FROM segs)
    SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index,
      doc_id % 6 <> 1 AND l NOT IN (3, 5) AS ok,
      CASE WHEN doc_id % 6 = 1 THEN 'provider down' WHEN l = 3 THEN 'refused' WHEN l = 5 THEN 'failed after 3 tries: empty answer' END AS reason,
      doc_id % 6 = 1 AS provider_down, CASE WHEN doc_id % 6 = 1 THEN NULL WHEN l = 5 THEN 3 ELSE 1 END AS attempts,
      CASE WHEN doc_id % 6 <> 1 AND l NOT IN (3, 5) THEN {_TRANSLATED} END AS result_text FROM r""",
)
def translate_segments(spark, sf):
    model = flaky(E.word_map_model({"the": "le"}))
    away = F.when(F.col("job_id").cast("long") % 6 == 1, "away").otherwise(F.col("model"))
    out = E.translate_segments(
        requests(spark, sf, 200).withColumn("model", away), model, spark.sparkContext.defaultParallelism
    )
    # How many segments of a job were asked before its provider was found down depends on the tasks.
    down = F.col("provider_down")
    return out.select(
        "job_id", "chunk_index", "ok", F.when(down, "provider down").otherwise(F.col("reason")).alias("reason"),
        "provider_down", F.when(~down, F.col("attempts")).alias("attempts"), "result_text",
    )


def busy(inner):
    """A model that is busy at the first try of some texts, fails at every try of others, and is down under one name."""

    def model(prompt, text, name, temperature, attempt):
        if name == "away":
            raise E.StatusError(503)
        last = len(text) % 10
        if last == 3 and attempt == 1:
            raise E.StatusError(429)
        if last == 4:
            raise E.StatusError(500, "broken")
        if last == 5:
            raise E.StatusError(404, "no such model")
        return inner(prompt, text, name, temperature)

    return model


@register(
    "translate_in_lanes",
    Q.segments_with(200)
    + f""", r AS (SELECT *, length(text) % 10 AS l, doc_id % 4 + 1 AS c, doc_id % 6 = 1 AS off FROM segs)
    SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, CAST(chunk_index % c AS INTEGER) AS lane, off AS provider_down,
      CASE WHEN off THEN NULL WHEN l = 3 THEN 2 WHEN l = 4 THEN 3 ELSE 1 END AS attempts,
      CASE WHEN off THEN NULL WHEN l = 3 THEN 1.0::DOUBLE WHEN l = 4 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS waited,
      CASE WHEN off THEN NULL WHEN l = 4 THEN 'failed after 3 tries: broken' WHEN l = 5 THEN 'no such model' END AS call_error,
      CASE WHEN NOT off AND l NOT IN (4, 5) THEN replace(text, 'the', 'le') END AS answer FROM r""",
)
def translate_in_lanes(spark, sf):
    """At most ``concurrency`` lanes a job, tries in waves; the waits are noted and not slept here."""
    away = F.when(F.col("job_id").cast("long") % 6 == 1, "away").otherwise(F.col("model"))
    asked = requests(spark, sf, 200).withColumns(
        {
            "model": away, "prompt": F.col("system_prompt"), "text": F.col("source_html"), "first_block": F.lit(0),
            "concurrency": (F.col("job_id").cast("long") % 4 + 1).cast("int"),
        }
    )
    out = E.call_in_lanes(asked, busy(E.word_map_model({"the": "le"})), spark.sparkContext.defaultParallelism, wait=lambda seconds: None)
    down = F.col("provider_down")
    return out.select(
        "job_id", "chunk_index", "lane", "provider_down",
        *[F.when(~down, F.col(c)).alias(c) for c in ("attempts", "waited", "call_error", "answer")],
    )


def dropping(limit):
    """A model that loses the last block when it is given more than ``limit``."""
    inner = E.word_map_model({"the": "le"})

    def model(prompt, text, name, temperature):
        blocks = text.split("\n\n")
        return inner(prompt, "\n".join(blocks[:-1] if len(blocks) > limit else blocks), name, temperature)

    return model


@register(
    "structure_recovery",
    Q.segments_with(1000)
    + f""" SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, recovered OR n <= 4 AS ok,
      -- two calls for a piece that loses a block, then its parts: eights, or halves of eight and fewer
      CASE WHEN n <= 4 THEN 1 WHEN NOT recovered THEN 2 WHEN n <= 8 THEN [5, 4, 5, 4][n - 4]
           ELSE 2 + 4 * (n // 8) + CASE WHEN n % 8 = 0 THEN 0 WHEN n % 8 <= 4 THEN 1 ELSE [5, 4, 5][n % 8 - 4] END END AS attempts,
      CASE WHEN recovered OR n <= 4 THEN {_TRANSLATED} END AS result_text
    FROM (SELECT *, doc_id % 5 <> 0 AS recovered, len(string_split(node_list, ',')) AS n FROM segs)""",
)
def structure_recovery(spark, sf):
    items = requests(spark, sf, 1000)
    n = F.col("job_id").cast("long")
    recover = F.when(n % 5 != 0, True).when(n % 10 == 0, False)  # NULL for the others
    out = E.translate_segments(items, dropping(4), spark.sparkContext.defaultParallelism, recover)
    return out.select("job_id", "chunk_index", "ok", "attempts", "result_text")


def _results(spark, sf):
    """First-pass results without a model call: the substituted segments."""
    return tb.segments(spark, sf, 200).select(
        F.col("doc_id").cast("string").alias("job_id"), "chunk_index", F.lit(True).alias("ok"),
        F.replace(F.replace("text", F.lit("\n\n"), F.lit("\n")), F.lit("the"), F.lit("le")).alias("result_text"),
    )


@register(
    "proofread_segments",
    Q.segments_with(200)
    + f""" SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, CASE WHEN length(first) % 10 IN (3, 5) THEN first ELSE replace(first, 'le', 'la') END AS result_text
       FROM (SELECT *, {_TRANSLATED} AS first FROM segs)""",
)
def proofread_segments(spark, sf):
    model = flaky(E.word_map_model({"le": "la"}))
    out = E.proofread_segments(_results(spark, sf), model, spark.sparkContext.defaultParallelism, "base")
    return out.select("job_id", "chunk_index", "result_text")


@register(
    "proofread_batch",
    Q.segments_with(200)
    + f""", r AS (SELECT doc_id, chunk_index, {_TRANSLATED} AS result_text, (doc_id + chunk_index) % 20 <> 0 AS ok FROM segs)
    SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, result_text FROM r WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE NOT ok)""",
)
def proofread_batch(spark, sf):
    results = _results(spark, sf).withColumn("ok", (F.col("job_id").cast("long") + F.col("chunk_index")) % 20 != 0)
    return E.proofread_batch(results).select("job_id", "chunk_index", "result_text")


@register(
    "model_catalog",
    """WITH p AS (SELECT o_orderkey, 'prov-' || o_custkey AS provider, o_orderkey % 9 AS f FROM orders)
    SELECT DISTINCT provider, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || (o_orderkey % 20) ELSE 'n' || (o_orderkey % 20) END AS model, NULL::VARCHAR AS error FROM p WHERE f NOT IN (1, 2)
    UNION ALL SELECT DISTINCT provider, NULL, 'unreachable' FROM p WHERE f = 1
    UNION ALL SELECT 'prov-' || c_custkey, 'current', NULL FROM customer""",
)
def model_catalog(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, F.lit("m")).otherwise(F.lit("n")), (k % 20).cast("string"))
    null = F.lit(None).cast("string")
    data = F.array(F.struct(F.concat(F.lit("models/"), name).alias("id"), null.alias("name"), null.alias("model")))
    named = F.array(F.struct(null.alias("id"), F.lit("").alias("name"), name.alias("model")))
    body = (
        F.when(k % 9 == 2, "not json").when(k % 2 == 0, F.to_json(F.struct(data.alias("data"))))
        .otherwise(F.to_json(F.struct(named.alias("models"))))
    )
    payloads = tb.table(spark, sf, "orders").select(
        F.concat(F.lit("prov-"), F.col("o_custkey").cast("string")).alias("provider"),
        F.when(k % 9 == 1, 401).otherwise(200).alias("status"), body.alias("body"),
    )
    active = tb.table(spark, sf, "customer").select(
        F.concat(F.lit("prov-"), F.col("c_custkey").cast("string")).alias("provider"), F.lit("current").alias("model")
    )
    return E.model_catalog(payloads, active)
