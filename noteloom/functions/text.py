"""Text and Markdown functions as column expressions."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions import markdown as md

#: Fixed values.
DASHES = "‐‑‒–—―"
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
EMPTY_NAME = "Без названия"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"(?U)\s+"
WHITE = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space, of any Unicode kind, at both ends."""
    return F.btrim(text, F.lit(WHITE))


def content_hash(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 16)


def cut_at_space(text: Column, limit: int | Column) -> Column:
    """``text`` up to ``limit`` characters; a longer one ends at the last space before it, with an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("…")))


def summary(body: Column, limit: int = 400) -> Column:
    """Lines that are neither blank nor headings, joined by spaces and cut."""
    lines = F.transform(F.split(body, LINE_END), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return cut_at_space(F.array_join(kept, " "), limit)


def inline_tags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?U)(?<!\S)#([\w\-/А-Яа-яЁё]+)"), F.lit(1))


def all_tags(front: Column, body: Column) -> Column:
    """The tags of the front matter, leading ``#`` removed, and of the body, as a sorted set."""
    own = F.transform(F.coalesce(front, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, "^#+", ""))
    return F.array_sort(F.array_distinct(F.concat(own, inline_tags(body))))


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target#anchor|alias]]``, trimmed, as a sorted set."""
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


@lru_cache(maxsize=1)
def composites() -> str:
    """Letters with the marks that they are composed with, as JSON: the two-part compositions of European scripts."""
    pairs = {}
    for c in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(c):
            pairs[parts] = chr(c)
    return json.dumps(pairs)


def composed(text: Column) -> Column:
    """Letters and the marks behind them as single characters, for European scripts; others stay.

    As a column expression it also serves inside functions of arrays; ``markdown.nfc`` is the whole normal form.
    """
    known = F.from_json(F.lit(composites()), "map<string,string>")
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).[\x{300}-\x{36f}]*"), F.lit(0))
    joined = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
    return F.when(text.rlike(r"[\x{300}-\x{36f}]"), joined).otherwise(text)


def normalized_title(title: Column) -> Column:
    """For comparison of links: composed, trimmed, every dash a hyphen; the case stays."""
    return F.translate(strip(composed(title)), DASHES, "-" * len(DASHES))


def slug(title: Column) -> Column:
    """A file name: slashes to spaces, forbidden characters out, white space collapsed."""
    plain = F.regexp_replace(strip(md.nfc(title)), r"[\\/]+", " ")
    plain = strip(F.regexp_replace(F.regexp_replace(plain, r'[\\/:*?"<>|#^\[\]]', ""), SPACE, " "))
    return F.when(plain == "", EMPTY_NAME).otherwise(plain)


def note_path(folder: Column, title: Column) -> Column:
    inner = F.regexp_replace(folder, "^/+|/+$", "")
    return F.when(inner == "", F.concat(slug(title), F.lit(".md"))).otherwise(F.concat(inner, F.lit("/"), slug(title), F.lit(".md")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def collapse_brackets(text: Column) -> Column:
    """Doubled link brackets collapsed to one pair."""
    return F.regexp_replace(text, r"\[{2,}([^\[\]]+)\]{2,}", "[[$1]]")


def strip_brackets(text: Column) -> Column:
    """Outer brackets removed, however many, with the white space they leave."""
    plain = strip(text)
    left, right = F.regexp_extract(plain, r"(?U)^[\[\s]*", 0), F.regexp_extract(plain, r"(?U)[\]\s]*$", 0)
    opened, closed = F.length(F.regexp_replace(left, r"(?U)\s", "")), F.length(F.regexp_replace(right, r"(?U)\s", ""))
    pairs = F.least(opened, closed)
    head, tail = F.concat(F.lit(r"^(?:\s*\[){"), pairs.cast("string"), F.lit("}")), F.concat(F.lit(r"(?:\]\s*){"), pairs.cast("string"), F.lit("}$"))
    return strip(F.regexp_replace(F.regexp_replace(plain, head, F.lit("")), tail, F.lit("")))


def snapped(raw: Column, titles: Column) -> Column:
    """The canonical title of a link by a map of normalized titles; null for nothing and for addresses."""
    link = strip_brackets(raw)
    bad = (link == "") | link.contains("://") | link.startswith("www.")
    return F.when(~bad, F.coalesce(F.element_at(titles, normalized_title(link)), link))


def tag(raw: Column) -> Column:
    low = F.lower(strip(F.regexp_replace(strip(raw), "^#+", "")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, SPACE, "-"), r"(?U)[^\w\-/]", ""), "^[-/]+|[-/]+$", "")


def normalized_tags(raw: Column, most: int = 6) -> Column:
    """Lower-case tags without marks, blanks, bare numbers or repeats; the first ``most``."""
    kept = F.filter(F.transform(raw, tag), lambda t: (t != "") & ~t.rlike(r"(?U)^\d+$"))
    return F.slice(F.array_distinct(kept), 1, most)


def add_domain_tag(tags: Column, domain: Column) -> Column:
    own = F.concat(F.lit("domain/"), domain)
    return F.when(F.array_contains(tags, own), tags).otherwise(F.array_append(tags, own))


def domain_of(tags: Column) -> Column:
    found = F.filter(tags, lambda t: t.startswith("domain/"))
    return F.coalesce(F.regexp_replace(F.get(found, F.lit(0)), "^domain/", ""), F.lit(""))


def fences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^ {0,3}```"))


def closed_fence(text: Column) -> Column:
    return F.when(fences(text) % 2 == 1, F.concat(F.regexp_replace(text, r"\n+$", ""), F.lit("\n```"))).otherwise(text)


def headings_within(text: Column, least: int = 2, most: int = 4, shift: int = 0) -> Column:
    """Heading levels moved by ``shift`` and kept in a range, outside code fences."""

    def step(state: Column, line: Column) -> Column:
        fence = line.rlike("^ {0,3}```")
        marks = F.regexp_extract(line, r"^(#{1,6})\s", 1)
        level = F.least(F.greatest(F.length(marks) + shift, F.lit(least)), F.lit(most))
        fixed = F.concat(F.repeat(F.lit("#"), level), F.substr(line, F.length(marks) + 1))
        out = F.when(~fence & ~state["inside"] & (marks != ""), fixed).otherwise(line)
        return F.struct((state["inside"] != fence).alias("inside"), F.array_append(state["lines"], out).alias("lines"))

    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))
    return F.array_join(F.aggregate(F.split(text, LINE_END), zero, step)["lines"], "\n")


def without_own_heading(text: Column, heading: Column) -> Column:
    """A section whose first line that is not blank repeats its heading, without that line."""
    first = F.regexp_extract(text, r"^\s*#{1,6}\s+([^\n]*)(?:\n|$)", 1)
    same = F.lower(strip(F.regexp_replace(strip(first), "#+$", ""))) == F.lower(strip(heading))
    return F.when((first != "") & same, F.regexp_replace(text, r"^\s*#{1,6}\s+[^\n]*(?:\n+|$)", "")).otherwise(text)


def prepared_section(markdown: Column, heading: Column) -> tuple[Column, Column]:
    """A section without look-alikes and its own heading, its headings within bounds; and whether its fences pair up."""
    text = without_own_heading(md.glitch_free(strip(markdown)), heading)
    text = strip(headings_within(text))
    return text, fences(text) % 2 == 0


def plain_text(markdown: Column, skip_quotes: bool = False) -> Column:
    """Without code, tables, headings and callout heads; links as their shown text."""
    lines = F.transform(F.split(F.regexp_replace(markdown, r"(?s)```.*?(```|$)", " "), LINE_END), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("#") & ~x.startswith(">" if skip_quotes else "> [!"))
    unquoted = F.transform(kept, lambda x: F.when(x.startswith(">"), strip(F.regexp_replace(x, "^[> ]+", ""))).otherwise(x))
    text = F.array_join(unquoted, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")
    return F.regexp_replace(text, "[*`]", "")


def first_sentence(text: Column, limit: int = 150) -> Column:
    flat = strip(F.regexp_replace(text, SPACE, " "))
    return cut_at_space(F.get(F.split(flat, r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ])", 2), F.lit(0)), limit)


def cyrillic(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[а-яА-ЯёЁ]"))


def cyrillic_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("[а-яА-ЯёЁa-zA-Z]"))
    return F.when(letters > 0, cyrillic(text) / letters).otherwise(1.0)


def estimated_tokens(text: Column) -> Column:
    per = F.when(cyrillic(text) / F.length(text) > 0.3, 2.3).otherwise(4.0)
    return F.when(F.length(text) > 0, F.floor(F.length(text) / per) + 1).otherwise(0).cast("long")


def repaired_json(raw: Column) -> Column:
    """Code fences around it removed, and number words after a decimal point written as digits."""
    text = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    for k, word in enumerate(NUMBER_WORDS):
        text = F.regexp_replace(text, rf"(?i)(\d)\.\s*{word}\b", rf"$1.{k}")
    return text


def callout(kind: Column, title: Column, body: Column) -> Column:
    lines = F.transform(F.split(body, LINE_END), lambda x: F.when(strip(x) == "", ">").otherwise(F.concat(F.lit("> "), x)))
    return F.concat(F.lit("> [!"), kind, F.lit("] "), title, F.lit("\n"), F.array_join(lines, "\n"))


def page_text(html: Column) -> Column:
    """Visible text of a page by column functions: no scripts, styles, navigation, comments or tags."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
