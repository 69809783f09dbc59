"""Glossaries and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.core import strip
from quire.functions.html import checked_blocks
from quire.params import LANGUAGE_NAMES

# Glossary limits.
MAX_ITEMS = 50_000
MAX_DESCRIPTION = 5_000
MAX_LENGTHS = {"source": 500, "target": 500, "category": 50, "note": 2000}
MAX_NAME = 100

# Prompt wording.
PAIR_PROMPT = (
    "You translate books from %1$s to %2$s. Write fluent, natural %2$s. Keep proper names unless a glossary rule "
    "says otherwise, keep every sentence, keep all HTML tags as they are and answer with the %2$s text only."
)
PROOFREAD_PROMPT = (
    "You proofread a finished translation. Correct spelling, grammar and typography, translate leftovers, keep style, "
    "names and all HTML tags, and answer with the corrected text only."
)
GLOSSARY_HEADER = "GLOSSARY RULES (mandatory):"
STRUCTURE_RULE = (
    "FORMAT FIRST: repeat exactly the block tags you receive, in the same order, starting with the first tag that is "
    "really in the text, whatever an earlier instruction says."
)
REPAIR_RULE = "FORMAT CORRECTION: return exactly %d blocks in this order (%s). Do not merge, drop or add a block."


def glossary_key(name: Column) -> Column:
    """File-safe key: letters, digits, ``-`` and ``_`` in lower case; NULL when nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")), F.lit(""))


def glossary_validate(items: DataFrame) -> DataFrame:
    """Add ``reject_reason``; the item count is pre-aggregated per glossary, not windowed."""
    counts = items.groupBy("glossary").agg(F.count("*").alias("items"))
    name = F.col("glossary")
    reason = F.when(name.isNull(), "name missing").when((name == "") | (F.length(name) > MAX_NAME), "name length").when(
        ~F.rlike(name, F.lit(r"[\p{L}\p{N}]")), "name characters"
    ).when(F.coalesce(F.length("source"), F.lit(0)) == 0, "source missing")
    for field, limit in MAX_LENGTHS.items():
        reason = reason.when(F.length(field) > limit, f"{field} length")
    if "description" in items.columns:
        reason = reason.when(F.length("description") > MAX_DESCRIPTION, "description length")
    reason = reason.when(F.col("items") > MAX_ITEMS, "too many items")
    counted = items.join(counts.withColumnRenamed("glossary", "_name"), name.eqNullSafe(F.col("_name")), "left")
    return counted.withColumn("reject_reason", reason).drop("items", "_name")


def glossary_parse_lines(pasted: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Pasted lines -> items. Separator precedence: pipe, arrow, comma."""
    line = strip(F.col("line"))
    sep = (
        F.when(F.contains(line, F.lit("|")), r"\|")
        .when(F.contains(line, F.lit("->")), "->")
        .when(F.contains(line, F.lit(",")), ",")
    )
    parts = F.when(sep.isNotNull(), F.transform(F.split(line, sep), strip)).otherwise(F.array(line))
    at = lambda i: F.coalesce(F.get(F.col("parts"), F.lit(i)), F.lit(""))
    return (
        pasted.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
        .where((line != "") & ~line.startswith("#"))
        .select(*keep, "pos", parts.alias("parts"))
        .where(at(0) != "")
        .select(
            *keep,
            "pos",
            at(0).alias("source"),
            F.coalesce(F.nullif(at(1), F.lit("")), at(0)).alias("target"),
            F.lit("general").alias("category"),
            at(2).alias("note"),
        )
    )


ITEM = "struct<source:string,target:string,category:string,note:string>"


def glossary_import(existing: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """Append the items of JSON documents (a list, or an object with ``items``) after the existing ones.

    Both inputs carry ``glossary``; positions continue after the existing ones.
    Items without a source are dropped, as on save.
    """
    as_list = F.from_json(F.col(content), f"array<{ITEM}>")
    as_object = F.from_json(F.col(content), f"items array<{ITEM}>")
    is_list = F.startswith(strip(F.col(content)), F.lit("["))
    items = F.when(is_list, as_list).otherwise(as_object["items"])
    offset = existing.groupBy("glossary").agg((F.max("pos") + 1).alias("offset"))
    added = (
        files.select("glossary", F.posexplode(items).alias("pos", "item"))
        .join(offset, "glossary", "left")
        .select(
            "glossary",
            (F.coalesce("offset", F.lit(0)) + F.col("pos")).cast("int").alias("pos"),
            "item.source",
            F.coalesce("item.target", F.lit("")).alias("target"),
            F.coalesce("item.category", F.lit("general")).alias("category"),
            "item.note",
        )
    )
    return existing.unionByName(added).where(strip(F.coalesce("source", F.lit(""))) != "")


def glossary_rule(source: Column, target: Column, note: Column) -> Column:
    """One rule line: keep the term, or always use the target."""
    suffix = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise("")
    keep = (F.coalesce(target, F.lit("")) == "") | (source == target)
    return F.when(keep, F.concat(F.lit("- '"), source, F.lit("': keep as it is"), suffix, F.lit("."))).otherwise(
        F.concat(F.lit("- '"), source, F.lit("' -> always '"), target, F.lit("'"), suffix, F.lit("."))
    )


def glossary_prompt(items: DataFrame) -> DataFrame:
    """One prompt text per glossary. A valid glossary holds at most MAX_ITEMS items, which bounds the group."""
    line = glossary_rule(F.col("source"), F.col("target"), F.col("note"))
    return (
        items.groupBy("glossary")
        .agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
        .select(
            "glossary",
            F.concat(
                F.lit("\n" + GLOSSARY_HEADER + "\n"),
                F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
                F.lit("\n"),
            ).alias("prompt"),
        )
    )


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(code)), code)


def system_prompt(source_lang: Column, target_lang: Column) -> Column:
    return F.format_string(PAIR_PROMPT, language_name(source_lang), language_name(target_lang))


def job_prompt(jobs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Custom prompt, else proofreading, else language pair; plus the glossary text when it exists.

    ``jobs`` needs ``custom_prompt, job_type, source_lang, target_lang, glossary_name``;
    ``prompts`` is the output of ``glossary_prompt``. The glossary side is joined
    on its key; AQE broadcasts it only if its measured size is small.
    """
    base = (
        F.when(F.coalesce("custom_prompt", F.lit("")) != "", F.col("custom_prompt"))
        .when(F.col("job_type") == "proofreading", F.lit(PROOFREAD_PROMPT))
        .otherwise(system_prompt(F.col("source_lang"), F.col("target_lang")))
    )
    keyed = prompts.select(glossary_key(F.col("glossary")).alias("_g"), F.col("prompt").alias("_glossary_prompt"))
    out = jobs.withColumn("_g", glossary_key(F.col("glossary_name"))).join(keyed, "_g", "left")
    suffix = F.coalesce(F.concat(F.lit("\n"), F.col("_glossary_prompt")), F.lit(""))
    return out.withColumn("system_prompt", F.concat(base, suffix)).drop("_g", "_glossary_prompt")


def structure_prompt(prompt: Column, source_html: Column) -> Column:
    """(first, repair) prompts of a segment; no format rule when the source has no block."""
    tags = F.transform(checked_blocks(source_html), lambda b: b["tag"])
    first = F.when(F.size(tags) > 0, F.concat(prompt, F.lit("\n\n" + STRUCTURE_RULE))).otherwise(prompt)
    repair = F.concat(
        first, F.lit("\n\n"), F.format_string(REPAIR_RULE, F.size(tags), F.array_join(tags, ", "))
    )
    return F.struct(first.alias("first"), repair.alias("repair"))
