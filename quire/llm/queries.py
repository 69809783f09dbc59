"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import pieces, prefix_trie, token_file
from quire.llm.collocations import collocations
from quire.llm.exact_dedup import mark_exact
from quire.llm.html_render import extract_text
from quire.llm.license_scan import scan_licenses
from quire.llm.line_dedup import mark_lines
from quire.llm.mixing import taken_words
from quire.llm.near_dedup import mark_near
from quire.llm.ngram_lm import score_texts
from quire.llm.quality_model import score_quality
from quire.llm.quality_rules import apply_rules
from quire.session import scratch_folder, settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_exact(table(spark, sf_dir, "documents"), ["doc_id"])
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = score_quality(table(spark, sf_dir, "documents"), labels, ["doc_id"])
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return ruled.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = taken_words(table(spark, sf_dir, "documents"), ["doc_id"])
    return taken.select("row.doc_id", "size", "source_size", "target", "taken")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"), ["page_id"])
    return texts.select("row.page_id", F.char_length("text").alias("n_chars"), "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), ["doc_id"], model))
    return coded.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select(
        "row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return marked.select("row.doc_id", "n_lines", "n_links", F.size("dropped").alias("n_dropped"), "dropped")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    return token_file.digests(token_file.read_tokens(spark, path))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_near(table(spark, sf_dir, "documents"), ["doc_id"])
    return marked.select("row.doc_id", "class_id", "class_size", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = prefix_trie.coded_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    turns, convs = prefix_trie.rebuilt(settle(coded, "trie-coded"))
    return prefix_trie.prefix_trie(turns, convs)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lm_scores": op7_lm_scores,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_file": op9_token_file,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_license_scan": op13_license_scan,
}

ORACLES = {
    "op1_exact_dedup": """
        WITH h AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                                'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op3_quality_rules": r"""
        WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
        again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
        ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
               FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
               WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words
              FROM d JOIN t USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                     CASE WHEN n_words > 0 THEN n_symbols * 100.0::DOUBLE / n_words ELSE 0 END AS x1,
                     CASE WHEN n_lines > 0 THEN n_dup_lines * 100.0::DOUBLE / n_lines ELSE 0 END AS x2,
                     CASE WHEN n_words > 0 THEN word_chars * 100.0::DOUBLE / n_words ELSE 0 END / 100 AS x3,
                     CASE WHEN n_words > 0 THEN n_repeat_words * 100.0::DOUBLE / n_words ELSE 0 END AS x4 FROM m),
        e AS (SELECT lang, source, unnest([(n_symbols + 1) * 100.0::DOUBLE / (n_words + 1),
                                           (n_dup_lines + 1) * 100.0::DOUBLE / (n_lines + 1), x3,
                                           (n_repeat_words + 16) * 100.0::DOUBLE / (n_words + 16)]) AS x,
                     unnest([1, 2, 3, 4]) AS k2 FROM b WHERE NOT base_failed),
        q AS (SELECT lang, source, k2 AS k,
                     CASE WHEN x > 0 THEN greatest(1, ceil(ln(x * 100) / ln(1.04::DOUBLE)) + 1) ELSE 0 END AS bkt FROM e),
        s AS (SELECT lang, source, k, bkt, count(*) AS n, 0 AS lvl FROM q GROUP BY ALL
              UNION ALL SELECT lang, NULL, k, bkt, count(*), 1 FROM q GROUP BY ALL
              UNION ALL SELECT NULL, NULL, k, bkt, count(*), 2 FROM q GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, k ORDER BY bkt) AS seen,
                     sum(n) OVER (PARTITION BY lvl, lang, source, k) AS total FROM s),
        v AS (SELECT lvl, lang, source, k, max(total) AS total,
                     min(CASE WHEN seen >= total * 0.25 THEN bkt END) AS lo,
                     min(CASE WHEN seen >= total * 0.75 THEN bkt END) AS hi FROM c GROUP BY ALL),
        f AS (SELECT lvl, lang, source, k, total, h + 6.0::DOUBLE * (h - l) AS fence
              FROM (SELECT *, CASE WHEN hi > 0 THEN pow(1.04::DOUBLE, hi - 1) / 100 ELSE 0 END AS h,
                              CASE WHEN lo > 1 THEN pow(1.04::DOUBLE, lo - 2) / 100 ELSE 0 END AS l FROM v)),
        g AS (SELECT o.lang, o.source, o.k,
                     CASE WHEN o.total >= 50 THEN o.fence WHEN w.total >= 50 THEN w.fence ELSE a.fence END AS fence
              FROM f o JOIN f w ON w.lvl = 1 AND w.k = o.k AND w.lang IS NOT DISTINCT FROM o.lang
              JOIN f a ON a.lvl = 2 AND a.k = o.k WHERE o.lvl = 0),
        p AS (SELECT lang, source, max(CASE WHEN k = 1 THEN fence END) AS f1, max(CASE WHEN k = 2 THEN fence END) AS f2,
                     max(CASE WHEN k = 3 THEN fence END) AS f3, max(CASE WHEN k = 4 THEN fence END) AS f4
              FROM g GROUP BY lang, source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND coalesce(x1 <= f1 AND x2 <= f2 AND x3 <= f3 AND x4 <= f4, FALSE) AS kept
        FROM b LEFT JOIN p ON p.lang IS NOT DISTINCT FROM b.lang AND p.source IS NOT DISTINCT FROM b.source""",
}
