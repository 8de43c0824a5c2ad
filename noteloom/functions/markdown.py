"""Markdown rewriting that depends on what came before in the text: Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that look like Cyrillic ones.
LOOKALIKE = {
    "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х",
}
#: What links and look-alikes are not changed in, as blocks, as spans of a line and as whole lines.
BLOCKS = r"^ {0,3}```.*?(?:^ {0,3}```[^\n]*$|\Z)|^[ \t]*\$\$[ \t]*$.*?(?:^[ \t]*\$\$[ \t]*$|\Z)"
SPANS = r"`[^`\n]*`|\$\$[^$\n]*\$\$|\$[^$\n]+\$|\[\[[^\]\n]*\]\]|\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|www\.\S+"
LINES = r"^(?: {0,3}#{1,6}(?:[ \t]|$)|[ \t]*\||[ \t]*>[ \t]*\[!)[^\n]*$"
KEPT = re.compile(f"(?P<kept>{BLOCKS}|{SPANS})|[A-Za-zА-Яа-яЁё]+|‑", re.M | re.S)
CLOSED = re.compile(f"{BLOCKS}|{LINES}|{SPANS}", re.M | re.S)


def without_lookalikes(text: str) -> str:
    """Latin look-alikes in mostly Cyrillic words made Cyrillic, fixed hyphens plain; code and links stay."""

    def fixed(m: re.Match) -> str:
        word = m[0]
        if m["kept"]:
            return word
        if word == "‑":
            return "-"
        latin = [c for c in word if c.isascii()]
        mixed = latin and len(word) - len(latin) > len(latin) and all(c in LOOKALIKE for c in latin)
        return "".join(LOOKALIKE.get(c, c) for c in word) if mixed else word

    return KEPT.sub(fixed, text)


def with_links(text: str, titles: list[str]) -> str:
    """One link for each title, longest first, at its first whole mention in prose; titles already linked stay."""
    for title in sorted({t for t in titles if t}, key=lambda t: (-len(t), t)):
        if any(f"[[{title}{end}" in text for end in ("]", "|", "#")):
            continue
        closed = iter([m.span() for m in CLOSED.finditer(text)])
        low, high = next(closed, (len(text), len(text)))
        for m in re.finditer(rf"(?<!\w){re.escape(title)}(?!\w)", text):
            while high <= m.start() and low < len(text):
                low, high = next(closed, (len(text), len(text)))
            if m.end() <= low:
                text = f"{text[: m.start()]}[[{title}]]{text[m.end() :]}"
                break
    return text


def mapped(function, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: None if x is None else function(x))

    return run


def glitch_free(text: Column) -> Column:
    return mapped(without_lookalikes)(text)


def nfc(text: Column) -> Column:
    return mapped(lambda x: unicodedata.normalize("NFC", x))(text)


def linked(text: Column, titles: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            yield pd.Series([None if t is None else with_links(t, [] if x is None else list(x)) for t, x in zip(texts, lists, strict=True)], dtype=object)

    return run(text, titles)


#: Tags that begin a block of HTML which goes on to the next blank line.
HTML_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary "
    "table tbody td tfoot th thead title tr track ul"
).replace(" ", "|")
#: How blocks of HTML begin, and how they end; those that end with "" end before a blank line.
HTML = [
    (re.compile(start, re.I), re.compile(end, re.I) if end else None)
    for start, end in (
        (r"<(?:script|pre|style|textarea)(?:\s|>|$)", r"</(?:script|pre|style|textarea)>"),
        (r"<!--", r"-->"),
        (r"<\?", r"\?>"),
        (r"<![a-z]", r">"),
        (r"<!\[CDATA\[", r"\]\]>"),
        (rf"</?(?:{HTML_TAGS})(?:\s|/?>|$)", ""),
        (r"(?:<[a-z][a-z0-9-]*(?:\s+[a-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[a-z][a-z0-9-]*\s*>)\s*$", ""),
    )
]
FENCE, HEAD = re.compile(r" {0,3}(?:(`{3,})[^`]*$|(~{3,}))"), re.compile(r" {0,3}#{1,6}(?:\s|$)")
RULE, UNDERLINE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$"), re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
QUOTE, ITEM = re.compile(r" {0,3}> ?"), re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?=\s|$)")
DELIMITERS = re.compile(r" {0,3}(?=[|:-])(?!-\s)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def cells(row: str) -> int:
    """How many cells a table's row has."""
    return len(re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", row.strip())))


def html_kind(line: str, open_paragraph: bool) -> int | None:
    bare = line.lstrip(" ")
    if len(line) - len(bare) > 3 or not bare.startswith("<"):
        return None
    return next((k for k, (start, _) in enumerate(HTML[:6] if open_paragraph else HTML) if start.match(bare)), None)


class Blocks:
    """The open block at one level of containers, fed line by line; ``count`` is what counts at this level.

    Paragraphs of ``least`` characters, lists, tables and fenced code count; headings, quotes, HTML and
    indented code don't. A container hands its lines to a level of its own.
    """

    def __init__(self, least: int = 0, placeholder: str = ""):
        self.least, self.placeholder, self.count = least, placeholder, 0
        self.kind, self.held, self.inner = "", [], None

    def lazy(self) -> bool:
        """Whether a paragraph is open here or in the innermost container."""
        return self.kind == "text" or (self.kind in ("quote", "list") and self.inner.lazy())

    def close(self) -> None:
        if self.kind == "text":
            prose = "\n".join(self.held).strip()
            self.count += len(prose) >= self.least and prose != self.placeholder
        self.kind, self.held, self.inner = "", [], None

    def feed(self, line: str) -> None:
        blank = not line.strip()
        if self.kind and self.goes_on(line, blank):
            return
        self.close()
        if not blank:
            self.begin(line)

    def goes_on(self, line: str, blank: bool) -> bool:
        """Whether ``line`` belongs to the open block."""
        if self.kind == "fence":
            if re.match(rf" {{0,3}}{re.escape(self.mark[0])}{{{len(self.mark)},}}[ \t]*$", line):
                self.kind = ""
            return True
        if self.kind == "html":
            end = HTML[self.mark][1]
            if end and end.search(line):
                self.kind = ""
            return bool(end) or not blank
        if self.kind == "indented":
            return blank or line.startswith("    ")
        if self.kind == "table":
            return not blank and not interrupts(line)
        if self.kind == "quote":
            if m := QUOTE.match(line):
                self.inner.feed(line[m.end() :])
            elif not blank and self.inner.lazy() and not interrupts(line):
                self.inner.feed(line)
            else:
                return False
            return True
        if self.kind == "list":
            return self.in_list(line, blank)
        return self.in_text(line, blank)

    def in_list(self, line: str, blank: bool) -> bool:
        if blank:
            self.inner.feed("")
        elif len(line) - len(line.lstrip(" ")) >= self.offset:
            self.inner.feed(line[self.offset :])
        elif (m := ITEM.match(line)) and (m[4] or m[2]) == self.mark and not RULE.match(line):
            self.item(line, m)
        elif not m and self.inner.lazy() and not interrupts(line):
            self.inner.feed(line.lstrip(" "))
        else:
            return False
        return True

    def in_text(self, line: str, blank: bool) -> bool:
        if blank:
            return False
        if UNDERLINE.match(line):
            self.kind = ""
            return True
        head = self.held[-1]
        if DELIMITERS.match(line) and "|" in head and cells(head) == cells(line):
            self.held.pop()
            if self.held:
                self.close()
            self.count += 1
            self.kind, self.held = "table", []
            return True
        if interrupts(line):
            return False
        self.held.append(line)
        return True

    def begin(self, line: str) -> None:
        if line.startswith("    "):
            self.kind = "indented"
        elif m := FENCE.match(line):
            self.kind, self.mark = "fence", m[1] or m[2]
            self.count += 1
        elif HEAD.match(line) or RULE.match(line):
            pass
        elif m := QUOTE.match(line):
            self.kind, self.inner = "quote", Blocks()
            self.inner.feed(line[m.end() :])
        elif m := ITEM.match(line):
            self.kind, self.mark = "list", m[4] or m[2]
            self.count += 1
            self.item(line, m)
        elif (k := html_kind(line, False)) is not None:
            end = HTML[k][1]
            self.kind, self.mark = ("" if end and end.search(line) else "html"), k
        else:
            self.kind, self.held = "text", [line]

    def item(self, line: str, m: re.Match) -> None:
        rest = line[m.end() :]
        gap = len(rest) - len(rest.lstrip(" "))
        gap = gap if rest.strip() and 1 <= gap <= 4 else 1
        self.offset, self.inner = m.end() + gap, Blocks()
        self.inner.feed(rest[gap:])


def interrupts(line: str) -> bool:
    """Whether a line begins a block of its own behind an open paragraph."""
    if FENCE.match(line) or HEAD.match(line) or RULE.match(line) or QUOTE.match(line) or html_kind(line, True) is not None:
        return True
    m = ITEM.match(line)
    return bool(m and line[m.end() :].strip() and m[3] in (None, "1"))


def content_blocks_of(text: str, least: int, placeholder: str) -> int:
    """Top-level paragraphs of ``least`` characters, lists, tables and fenced code blocks of a text."""
    blocks = Blocks(least, placeholder)
    for line in re.split(r"\r\n|\n|\r", text):
        blocks.feed(line.expandtabs(4) if "\t" in line[: len(line) - len(line.lstrip())] else line)
    blocks.close()
    return blocks.count


def content_blocks(text: Column, placeholder: str, least: int = 40) -> Column:
    """``content_blocks_of``; texts of nothing but paragraphs are told by column functions and not sent to Python."""
    plain = ~text.rlike(r"(?m)^[ \t]*(?:[-+*_=>#`~<|:]|\d{1,9}[.)]|[ \t])|\||\r")
    prose = F.transform(F.split(text, r"\n[ \t]*(?:\n[ \t]*)*\n|^\n+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    simple = F.size(F.filter(prose, lambda x: (F.length(x) >= least) & (x != placeholder)))
    found = mapped(lambda x: content_blocks_of(x, least, placeholder), "int")(F.when(~plain, text))
    return F.when(text.isNotNull(), F.when(plain, simple).otherwise(found))


def chosen_places(text: str, count: int) -> list[int] | None:
    found: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*([1-9]\d*)(?:\s*-\s*([1-9]\d*))?\s*", part)
        if not m:
            return None
        ends = sorted((int(m[1]), int(m[2] or m[1])))
        if ends[1] > count:
            return None
        found.update(range(ends[0] - 1, ends[1]))
    return sorted(found, reverse=True)


def selection(text: Column, count: int) -> Column:
    """``1,3-5`` as places from 0, without repeats, highest first; null where a part is no number or range up to ``count``."""
    return mapped(lambda x: chosen_places(x, count), "array<int>")(text)
