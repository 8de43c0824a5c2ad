"""Checks of draft bodies and their summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import markdown as md
from noteloom.functions import text as tx
from noteloom.operators.assembly import PLACEHOLDER

ERRORS = ("empty_body", "unbalanced_code_fence", "create_path_exists", "update_path_missing", "duplicate_path_in_batch", "delete_not_allowed", "yaml_unsupported_type", "empty_title")


#: What the language check doesn't read, taken out in this order: code, formulas and addresses.
NOT_PROSE = (r"(?s)```.*?```", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+\$", r"`[^`\n]+`", r"https?://\S+")


def prose(text: Column) -> Column:
    return reduce(lambda t, form: F.regexp_replace(t, form, " "), NOT_PROSE, text)


def letter_counts(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the letters that the language check counts: ``own`` of the language's script, ``letters`` of both.

    Whole runs of letters are taken out, which is many times fewer matches than letters.
    """
    without = lambda letters: F.length("prose") - F.length(F.regexp_replace("prose", f"[{letters}]+", ""))
    counted = rows.withColumn("prose", prose(text)).withColumn("own", without("а-яА-ЯёЁ"))
    return counted.withColumn("letters", F.col("own") + without("a-zA-Z")).drop("prose")


def body_codes(body: Column, is_new: Column, own: Column | None = None, letters: Column | None = None, is_map: Column | None = None) -> Column:
    """The codes of all rules that a body breaks; an empty body is told alone, a map needs no structure.

    Where rows are many, take ``own`` and ``letters`` from ``letter_counts``, which goes over the prose once.
    """
    text = F.coalesce(body, F.lit(""))
    if own is None or letters is None:
        own = tx.cyrillic(prose(text))
        letters = own + F.regexp_count(prose(text), F.lit("[a-zA-Z]"))
    checked = is_new if is_map is None else is_new & ~is_map
    rules = F.array_compact(
        F.array(
            F.when(tx.fences(text) % 2 == 1, "unbalanced_code_fence"),
            F.when(F.length(text) < 40, "very_short_note").when(checked & (md.content_blocks(text, PLACEHOLDER) < 3), "note_too_short_structural"),
            F.when((letters >= 200) & (own / letters < 0.3), "note_language_mismatch"),
        )
    )
    return F.when(tx.strip(text) == "", F.array(F.lit("empty_body"))).otherwise(rules)


def report(issues: DataFrame, key: str = "task_id") -> DataFrame:
    """``errors, warnings, ok`` of each task."""
    bad = F.col("code").isin(*ERRORS)
    out = issues.groupBy(key).agg(F.count_if(bad).alias("errors"), F.count_if(~bad).alias("warnings"))
    return out.withColumn("ok", F.col("errors") == 0)


def front_matter_codes(title: Column, kinds: Column) -> Column:
    """Codes of a draft's front matter from the kinds of its values (list elements too) and of its title."""
    odd = F.exists(kinds, lambda k: ~k.isin("string", "number", "boolean", "null"))
    return F.array_compact(F.array(F.when(odd, "yaml_unsupported_type"), F.when(tx.strip(title) == "", "empty_title")))


def delete_codes(deletes: DataFrame, allowed: bool, key: str = "task_id") -> DataFrame:
    """One error for each task that deletes without being allowed to."""
    return deletes.select(key).distinct().where(F.lit(not allowed)).withColumn("code", F.lit("delete_not_allowed"))


def summary(issues: DataFrame) -> DataFrame:
    """``code, level, n`` for each code."""
    level = F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning")
    return issues.groupBy("code").agg(F.count("*").alias("n")).withColumn("level", level)


def uncovered(headings: DataFrame, bodies: DataFrame) -> DataFrame:
    """Planned headings that a note's text does not hold as ``## heading``."""
    joined = headings.join(bodies, "note_id")
    return joined.where(~F.col("body").contains(F.concat(F.lit("## "), F.col("heading")))).select("note_id", "heading")
