"""Registered queries: glossaries, prompts, answer cleaning and structure checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import clean as C
from quire.functions import html as H
from quire.operators import prompt as P
from quire.params import INLINE_TAGS, BLOCK_TAGS, LANGUAGE_NAMES
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


# ---- glossaries: one glossary per brand and 200 parts ------------------------------------------

GLOSSARY_NAME_SQL = "p_brand || '-' || CAST(floor(p_partkey / 200) AS BIGINT)"


def parts(spark, sf):
    return tb.table(spark, sf, "part").withColumn(
        "glossary", F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 200).cast("string"))
    )


def raw_items(spark, sf):
    """Items with planted violations of every limit."""
    k = F.col("p_partkey")
    return parts(spark, sf).select(
        "p_partkey",
        F.when(k % 43 == 0, F.lit(None)).when(k % 29 == 0, "##").when(k % 37 == 0, F.repeat(F.lit("n"), 101)).otherwise(F.col("glossary")).alias("glossary"),
        F.when(k % 17 == 0, "").when(k % 41 == 0, F.repeat(F.lit("s"), 501)).otherwise(F.col("p_name")).alias("source"),
        F.when(k % 23 == 0, F.repeat(F.lit("t"), 501)).otherwise(F.col("p_type")).alias("target"),
        F.when(k % 31 == 0, F.repeat(F.lit("c"), 51)).otherwise(F.lit("general")).alias("category"),
        F.when(k % 19 == 0, F.repeat(F.lit("x"), 2001)).alias("note"),
    )


@register(
    "glossary_validate",
    """SELECT p_partkey, CASE WHEN p_partkey % 43 = 0 THEN 'name missing' WHEN p_partkey % 29 = 0 THEN 'name characters' WHEN p_partkey % 37 = 0 THEN 'name length'
         WHEN p_partkey % 17 = 0 THEN 'source missing' WHEN p_partkey % 41 = 0 THEN 'source length'
         WHEN p_partkey % 23 = 0 THEN 'target length' WHEN p_partkey % 31 = 0 THEN 'category length'
         WHEN p_partkey % 19 = 0 THEN 'note length' END AS reject_reason FROM part""",
)
def glossary_validate(spark, sf):
    return P.glossary_validate(raw_items(spark, sf)).select("p_partkey", "reject_reason")


@register(
    "glossary_key",
    "SELECT c_custkey, lower(regexp_replace('É_' || c_name || ' / ' || c_mktsegment || '-x', '[^\\p{L}\\p{N}_-]', '', 'g')) AS key FROM customer",
)
def glossary_key(spark, sf):
    name = F.concat(F.lit("É_"), "c_name", F.lit(" / "), "c_mktsegment", F.lit("-x"))
    return tb.table(spark, sf, "customer").select("c_custkey", P.glossary_key(name).alias("key"))


_LINE_SQL = """CASE p_partkey % 4 WHEN 0 THEN p_name || ' | ' || p_type || ' | size ' || p_size
  WHEN 1 THEN p_name || ' -> ' || p_type WHEN 2 THEN p_name || ', ' || p_type || ',' ELSE '  ' || p_name END"""


def pasted(spark, sf):
    k = F.col("p_partkey")
    line = (
        F.when(k % 4 == 0, F.concat("p_name", F.lit(" | "), "p_type", F.lit(" | size "), F.col("p_size").cast("string")))
        .when(k % 4 == 1, F.concat("p_name", F.lit(" -> "), "p_type"))
        .when(k % 4 == 2, F.concat("p_name", F.lit(", "), "p_type", F.lit(",")))
        .otherwise(F.concat(F.lit("  "), "p_name"))
    )
    # A glossary paste: 200 lines at most, with a comment and a blank line around them.
    return (
        parts(spark, sf).groupBy("glossary")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("ls"))
        .select("glossary", F.concat(F.lit("# terms\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("paste"))
    )


def parsed(spark, sf):
    return P.glossary_parse_lines(pasted(spark, sf), ["glossary"], "paste")


_PARSED = f"""parsed AS (
  SELECT {GLOSSARY_NAME_SQL} AS glossary, CAST(row_number() OVER (PARTITION BY {GLOSSARY_NAME_SQL} ORDER BY p_partkey) + 1 AS INTEGER) AS pos,
         p_name AS source, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE p_type END AS target, 'general' AS category,
         CASE WHEN p_partkey % 4 = 0 THEN 'size ' || p_size ELSE '' END AS note, p_partkey
  FROM part)"""


@register("glossary_parse_lines", f"WITH {_PARSED} SELECT glossary, pos, source, target, category, note FROM parsed")
def glossary_parse_lines(spark, sf):
    return parsed(spark, sf)


@register(
    "glossary_import",
    f"""WITH {_PARSED}, sizes AS (SELECT glossary, max(pos) + 1 AS n FROM parsed GROUP BY glossary)
    SELECT glossary, pos, source, target, category, note FROM parsed
    UNION ALL SELECT p.glossary, CAST(n + pos - 2 AS INTEGER), CAST(p_partkey AS VARCHAR), source, 'imported', NULL
    FROM parsed p JOIN sizes s ON s.glossary = p.glossary WHERE p_partkey % 10 <> 0""",
)
def glossary_import(spark, sf):
    item = F.struct(
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey").cast("string")).otherwise(" ").alias("source"),
        F.col("p_name").alias("target"), F.lit("imported").alias("category"),
    )
    lists = parts(spark, sf).groupBy("glossary").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("xs"), F.min("p_partkey").alias("k")
    ).withColumn("items", F.transform("xs", lambda x: x["item"]))
    files = lists.select(
        "glossary",
        F.when(F.col("k") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items"))).alias("content"),
    )
    return P.glossary_import(parsed(spark, sf), files)


def _rule_sql():
    note = "CASE WHEN note <> '' THEN ' (' || note || ')' ELSE '' END"
    return (
        f"CASE WHEN source = target THEN '- ''' || source || ''': keep as it is' || {note} || '.' "
        f"ELSE '- ''' || source || ''' -> always ''' || target || '''' || {note} || '.' END"
    )


_PROMPTS = f"""{_PARSED}, prompts AS (SELECT glossary, chr(10) || '{P.GLOSSARY_HEADER}' || chr(10)
   || string_agg({_rule_sql()}, chr(10) ORDER BY pos) || chr(10) AS prompt FROM parsed GROUP BY glossary)"""


@register("glossary_prompt", f"WITH {_PROMPTS} SELECT glossary, prompt FROM prompts")
def glossary_prompt(spark, sf):
    return P.glossary_prompt(parsed(spark, sf))


def _language_sql(code: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_NAMES.items())
    return f"CASE lower({code}) {cases} ELSE {code} END"


_PAIR_SQL = P.PAIR_PROMPT.replace("'", "''")


def _pair_sql(src: str, tgt: str) -> str:
    return f"replace(replace('{_PAIR_SQL}', '%1$s', {_language_sql(src)}), '%2$s', {_language_sql(tgt)})"


@register(
    "system_prompt",
    f"""SELECT doc_id, {_pair_sql('src', 'tgt')} AS prompt FROM (
        SELECT doc_id, upper(lang) AS src, CASE WHEN doc_id % 5 = 0 THEN 'tlh' ELSE 'ja' END AS tgt FROM documents)""",
)
def system_prompt(spark, sf):
    target = F.when(F.col("doc_id") % 5 == 0, "tlh").otherwise("ja")
    return tb.documents(spark, sf).select("doc_id", P.system_prompt(F.upper("lang"), target).alias("prompt"))


@register(
    "job_prompt",
    f"""WITH {_PROMPTS}, j AS (SELECT doc_id, lang, CASE WHEN doc_id % 9 = 0 THEN 'custom for ' || source END AS custom,
        doc_id % 10 = 3 AS proof, 'brand' || (doc_id % 30) || '-' || (doc_id % 3) AS key FROM documents)
    SELECT doc_id, coalesce(custom, CASE WHEN proof THEN '{P.PROOFREAD_PROMPT}' ELSE {_pair_sql('lang', "'fr'")} END)
           || coalesce(chr(10) || prompt, '') AS system_prompt
    FROM j LEFT JOIN prompts ON replace(lower(glossary), '#', '') = key""",
)
def job_prompt(spark, sf):
    d = F.col("doc_id")
    jobs = tb.documents(spark, sf).select(
        "doc_id",
        F.when(d % 9 == 0, F.concat(F.lit("custom for "), "source")).alias("custom_prompt"),
        F.when(d % 10 == 3, "proofreading").otherwise("translation").alias("job_type"),
        F.col("lang").alias("source_lang"),
        F.lit("fr").alias("target_lang"),
        F.concat(F.lit("BRAND#"), (d % 30).cast("string"), F.lit("-"), (d % 3).cast("string")).alias("glossary_name"),
    )
    return P.job_prompt(jobs, P.glossary_prompt(parsed(spark, sf))).select("doc_id", "system_prompt")


_CLEANED = f"cleaned AS (SELECT page_id, {Q.ACTIVE} AS html FROM pages)"


@register(
    "structure_prompt",
    f"""WITH RECURSIVE {_CLEANED}, {Q.html_ctes('cleaned').lstrip()},
    tags AS (SELECT page_id, count(*) AS n, string_agg(tag, ', ' ORDER BY k) AS names FROM html_all WHERE NOT nested GROUP BY page_id)
    SELECT page_id, CASE WHEN n > 0 THEN 'Translate.' || chr(10) || chr(10) || '{P.STRUCTURE_RULE}' ELSE 'Translate.' END AS first,
      CASE WHEN n > 0 THEN 'Translate.' || chr(10) || chr(10) || '{P.STRUCTURE_RULE}' ELSE 'Translate.' END || chr(10) || chr(10)
      || replace(replace('{P.REPAIR_RULE}', '%d', CAST(coalesce(n, 0) AS VARCHAR)), '%s', coalesce(names, '')) AS repair
    FROM pages LEFT JOIN tags USING (page_id)""",
)
def structure_prompt(spark, sf):
    v = P.structure_prompt(F.lit("Translate."), F.col("html"))
    return tb.pages(spark, sf).select("page_id", v.alias("v")).select("page_id", "v.first", "v.repair")


# ---- answers: conversation turns wrapped the way models wrap them ------------------------------


def turns(spark, sf, answer):
    return tb.table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"))


def text_and_turn():
    return F.col("text"), F.col("turn")


def cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


@register("clean_response", f"SELECT conv_id, turn, {Q.strip('text')} AS cleaned FROM conversations")
def clean_response(spark, sf):
    text, turn = text_and_turn()
    answer = (
        F.when(turn % 3 == 0, cat("<Think>plan: ", text, "</think>\n[THINKING]x[/thinking]", text, " \n"))
        .when(turn % 3 == 1, cat("```html\n", text, "\n```\n"))
        .otherwise(text)
    )
    return turns(spark, sf, answer).select("conv_id", "turn", C.clean_response(F.col("answer")).alias("cleaned"))


@register(
    "unclosed_think",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || ' ' WHEN 1 THEN '<p>' || text || '</p>' || chr(10) || '<li>end</li>' ELSE text END AS cleaned
       FROM conversations""",
)
def unclosed_think(spark, sf):
    text, turn = text_and_turn()
    answer = (
        F.when(turn % 3 == 0, cat(text, " <think>first I weigh it"))
        .when(turn % 3 == 1, cat("<THINK>so: <p>", text, "</p> then <li>end</li>"))
        .otherwise(cat("<think>", text, "</think>"))
    )
    return turns(spark, sf, answer).select("conv_id", "turn", C.unclosed_think(F.col("answer")).alias("cleaned"))


@register("collapse_stutter")
def collapse_stutter(spark, sf):
    text, _ = text_and_turn()
    # No SQL side: RE2 has no back-references. Checked against Python's re in the tests.
    answer = F.regexp_replace(text, r"\b([a-z]{4})\b", "$1 $1 $1")
    return turns(spark, sf, answer).select("conv_id", "turn", C.collapse_stutter(F.col("answer")).alias("cleaned"))


def _norm_sql(x):
    return f"{Q.strip(f'''regexp_replace({Q.tagless(f'lower({x})')}, '\\s+', ' ', 'g')''')}"


def _repeats(source: str, joined: str, removed: str) -> str:
    """``source`` (conv_id, turn, p, piece, tail) -> text with consecutive significant repeats resolved."""
    return f"""
    pieces AS ({source}),
    normed AS (SELECT *, {_norm_sql('piece')} AS norm FROM pieces),
    seen AS (SELECT *, lag(norm) OVER (PARTITION BY conv_id, turn ORDER BY p) AS prev FROM normed WHERE length(norm) > 6),
    flagged AS (SELECT n.*, coalesce(s.prev = s.norm, FALSE) AS dup FROM normed n LEFT JOIN seen s USING (conv_id, turn, p))
    SELECT conv_id, turn, {joined} AS cleaned FROM flagged {removed} GROUP BY conv_id, turn"""


_DOUBLED = "regexp_replace(text, '([^.!?\\n]+[.!?])( |$)', '\\1 \\1\\2', 'g')"


@register(
    "dedupe_sentences",
    "WITH "
    + _repeats(
        f"""SELECT conv_id, turn, p, string_split(item, chr(1))[1] AS piece, coalesce(string_split(item, chr(1))[2], '') AS tail FROM (
            SELECT conv_id, turn, unnest(items) AS item, generate_subscripts(items, 1) AS p FROM (
              SELECT conv_id, turn, string_split(regexp_replace({_DOUBLED}, '([.!?])(\\s+)|(\\n+)', '\\1' || chr(1) || '\\2\\3' || chr(2), 'g'), chr(2)) AS items
              FROM conversations))""",
        "string_agg(CASE WHEN dup THEN tail ELSE piece || tail END, '' ORDER BY p)",
        "",
    ),
)
def dedupe_sentences(spark, sf):
    text, _ = text_and_turn()
    answer = F.regexp_replace(text, r"([^.!?\n]+[.!?])( |\z)", "$1 $1$2")
    return turns(spark, sf, answer).select("conv_id", "turn", C.dedupe_sentences(F.col("answer")).alias("cleaned"))


@register(
    "dedupe_lines",
    "WITH "
    + _repeats(
        """SELECT conv_id, turn, p, piece, '' AS tail FROM (
            SELECT conv_id, turn, unnest(items) AS piece, generate_subscripts(items, 1) AS p FROM (
              SELECT conv_id, turn, string_split(regexp_replace(text, '([^\\n]+)', '\\1' || chr(10) || '<b>\\1</b>', 'g'), chr(10)) AS items
              FROM conversations))""",
        "string_agg(piece, chr(10) ORDER BY p)",
        "WHERE NOT dup",
    ),
)
def dedupe_lines(spark, sf):
    text, _ = text_and_turn()
    answer = F.regexp_replace(text, "([^\n]+)", "$1\n<b>$1</b>")
    return turns(spark, sf, answer).select("conv_id", "turn", C.dedupe_lines(F.col("answer")).alias("cleaned"))


@register(
    "dedupe_paragraphs",
    "WITH "
    + _repeats(
        f"""SELECT conv_id, turn, p, piece, '' AS tail FROM (
            SELECT conv_id, turn, unnest(items) AS piece, generate_subscripts(items, 1) AS p, items[-1] AS final FROM (
              SELECT conv_id, turn, string_split(regexp_replace(text, '([^\\n]+)', '<p>\\1</p>' || chr(10) || '<p>\\1</p>', 'g'), '</p>') AS items
              FROM conversations)) WHERE {Q.strip('piece')} <> '' OR piece = final""",
        "string_agg(piece, '</p>' ORDER BY p)",
        "WHERE NOT dup",
    ),
)
def dedupe_paragraphs(spark, sf):
    text, _ = text_and_turn()
    answer = F.regexp_replace(text, "([^\n]+)", "<p>$1</p>\n<p>$1</p>")
    return turns(spark, sf, answer).select("conv_id", "turn", C.dedupe_paragraphs(F.col("answer")).alias("cleaned"))


# ---- structure ---------------------------------------------------------------------------------

_ANSWER_SQL = """CASE page_id % 4 WHEN 0 THEN replace(html, 'the', 'le') WHEN 1 THEN replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>')
   WHEN 2 THEN replace(replace(html, '<b>', '<i>'), '</b>', '</i>') ELSE html || '<p>extra</p>' END"""


def answers(spark, sf):
    h, k = F.col("html"), F.col("page_id") % 4

    def swap(a, b):
        return F.replace(F.replace(h, F.lit(f"<{a}>"), F.lit(f"<{b}>")), F.lit(f"</{a}>"), F.lit(f"</{b}>"))

    answer = (
        F.when(k == 0, F.replace(h, F.lit("the"), F.lit("le"))).when(k == 1, swap("h1", "h2"))
        .when(k == 2, swap("b", "i")).otherwise(F.concat(h, F.lit("<p>extra</p>")))
    )
    return tb.pages(spark, sf).withColumn("answer", answer)


_INLINE_ALT = "|".join(sorted(INLINE_TAGS, key=len, reverse=True))
_ALLOWED = ", ".join(f"'{t}'" for t in BLOCK_TAGS + INLINE_TAGS)


def _inline_sql(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '<({_INLINE_ALT})[\\s/>]', 1), ',')"


def _sanitized_sql(x: str) -> str:
    """Token by token: keep text, allowed tags without attributes, nothing else."""
    toks = f"regexp_extract_all({x}, '<[^>]*>|[^<]+')"
    name = "regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)"
    return (
        f"array_to_string(list_transform({toks}, lambda t: CASE WHEN t NOT LIKE '<%' THEN t WHEN {name} NOT IN ({_ALLOWED}) THEN '' "
        f"WHEN t LIKE '</%' THEN t WHEN t LIKE '%/>' THEN '<' || {name} || '/>' ELSE '<' || {name} || '>' END), '')"
    )


_ANSWER_ACTIVE = Q.ACTIVE.replace("html", f"({_ANSWER_SQL})", 1)


@register(
    "verify_structure",
    f"""WITH RECURSIVE {_CLEANED}, answered AS (SELECT page_id, {_ANSWER_ACTIVE} AS html FROM pages),
    {Q.html_ctes('cleaned', 'src').lstrip()}, {Q.html_ctes('answered', 'ans').lstrip()},
    s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS pos FROM src_all WHERE NOT nested),
    a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS pos FROM ans_all WHERE NOT nested),
    ns AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id), na AS (SELECT page_id, count(*) AS n FROM a GROUP BY page_id),
    pairs AS (SELECT s.page_id, s.pos, s.tag AS want, a.tag AS got, {_inline_sql('s.html')} <> {_inline_sql('a.html')} AS inline_bad
              FROM s JOIN a USING (page_id, pos)),
    firsts AS (SELECT page_id, min(pos) AS pos FROM pairs WHERE want <> got OR inline_bad GROUP BY page_id),
    reasons AS (
      SELECT p.page_id, CASE WHEN coalesce(ns.n, 0) <> coalesce(na.n, 0) THEN 'blocks: ' || coalesce(ns.n, 0) || ' expected, ' || coalesce(na.n, 0) || ' received'
        WHEN q.want <> q.got THEN 'tag at block ' || q.pos || ': ' || q.want || ' expected, ' || q.got || ' received'
        WHEN q.inline_bad THEN 'inline tags at block ' || q.pos END AS reason
      FROM pages p LEFT JOIN ns USING (page_id) LEFT JOIN na USING (page_id) LEFT JOIN firsts f USING (page_id)
      LEFT JOIN pairs q ON q.page_id = f.page_id AND q.pos = f.pos),
    fixed AS (SELECT page_id, string_agg({_sanitized_sql('html')}, chr(10) ORDER BY pos) AS repaired FROM a GROUP BY page_id)
    SELECT page_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN coalesce(repaired, '') END AS repaired
    FROM reasons LEFT JOIN fixed USING (page_id)""",
)
def verify_structure(spark, sf):
    v = C.verify_structure(F.col("html"), F.col("answer"))
    return answers(spark, sf).select("page_id", v.alias("v")).select("page_id", "v.ok", "v.reason", "v.repaired")


@register(
    "sanitize_blocks",
    f"""WITH RECURSIVE {_CLEANED}, {Q.html_ctes('cleaned').lstrip()}
    SELECT page_id, string_agg({_sanitized_sql('html')}, chr(10) ORDER BY k) AS html FROM html_all WHERE NOT nested GROUP BY page_id""",
)
def sanitize_blocks(spark, sf):
    blocks = H.checked_blocks(F.col("html"))
    joined = F.array_join(F.transform(blocks, lambda b: H.sanitize_block(b["html"])), "\n")
    return tb.pages(spark, sf).select("page_id", joined.alias("html"))
