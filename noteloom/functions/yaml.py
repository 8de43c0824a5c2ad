"""Front matter: the part of YAML that notes use, as JSON that Spark reads into a VARIANT.

Block and flow maps and lists at any depth, plain, quoted and multi-line scalars, comments.
Dates stay text in ISO form. Anchors, tags and several documents are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column

from noteloom.functions.markdown import mapped

#: What plain scalars mean something else than their text.
WORDS = {
    **dict.fromkeys(("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"), True), **dict.fromkeys(("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"), False),
    **dict.fromkeys(("", "~", "null", "Null", "NULL"), None),
}
INTEGER, FLOAT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)"), re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9]+)(?:[eE][-+][0-9]+)?")
KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-][^\n]*?|-(?=\S)[^\n]*?)\s*:(?=\s|$)""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "b": "\b", "a": "\a", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class Unreadable(ValueError):
    pass


def plain(text: str):
    """What a plain scalar stands for."""
    if text in WORDS:
        return WORDS[text]
    if INTEGER.fullmatch(text):
        return int(text.replace("_", ""))
    return float(text.replace("_", "")) if FLOAT.fullmatch(text) else text


def folded(lines: list[str]) -> str:
    """Lines of one flow scalar: a line end is a space, an empty line one."""
    out = lines[0].rstrip()
    empty = 0
    for line in lines[1:]:
        if not line.strip():
            empty += 1
            continue
        out, empty = out + ("\n" * empty or " ") + line.strip(), 0
    return out


def quoted(text: str) -> str:
    inner = folded(text[1:-1].split("\n")) if "\n" in text else text[1:-1]
    if text[0] == "'":
        return inner.replace("''", "'")
    code = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "xuU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1])
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", code, inner)


def uncommented(text: str) -> str:
    return re.sub(r"(?:^|\s)#.*", "", text).strip()


class Reader:
    """Recursive descent over lines; ``at`` is the next line."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def indent(self) -> int | None:
        """Of the next line that is neither blank nor a comment; None at the end."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1
        if self.at == len(self.lines):
            return None
        line = self.lines[self.at]
        if line.lstrip(" ").startswith("\t"):
            raise Unreadable("tab")
        return len(line) - len(line.lstrip(" "))

    def node(self, least: int):
        depth = self.indent()
        if depth is None or depth < least:
            return None
        text = self.lines[self.at][depth:]
        if re.match(r"-(\s|$)", text):
            return self.sequence(depth)
        if KEY.match(text):
            return self.mapping(depth)
        self.at += 1
        return self.value(text, depth - 1)

    def sequence(self, depth: int) -> list:
        out = []
        while self.indent() == depth and re.match(r"-(\s|$)", line := self.lines[self.at][depth:]):
            rest = line[1:]
            if not uncommented(rest):
                self.at += 1
                out.append(self.node(depth + 1))
            elif KEY.match(rest.lstrip()) or re.match(r"-(\s|$)", rest.lstrip()):  # what begins on the item's own line
                self.lines[self.at] = " " * (depth + len(line) - len(rest.lstrip())) + rest.lstrip()
                out.append(self.node(depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest.lstrip(), depth))
        return out

    def mapping(self, depth: int) -> dict:
        out = {}
        while self.indent() == depth:
            line = self.lines[self.at][depth:]
            m = KEY.match(line)
            if not m:
                break
            name = line[: m.end() - 1].rstrip()
            name, rest = quoted(name) if name[0] in "\"'" else name, line[m.end() :].strip()
            self.at += 1
            if uncommented(rest):
                out[name] = self.value(rest, depth)
            else:  # a list may stand as deep as its key
                inner = self.indent()
                listed = inner == depth and re.match(r"-(\s|$)", self.lines[self.at][depth:])
                out[name] = self.node(depth if listed else depth + 1)
        if (inner := self.indent()) is not None and inner > depth:
            raise Unreadable("indentation")
        return out

    def value(self, text: str, depth: int):
        """The value that begins with ``text`` and goes on over deeper lines."""
        if text[0] in "|>":
            return self.block(text, depth)
        if text[0] in "\"'[{":
            closed = self.closed(text, depth)
            got, rest = flow(closed, 0)
            if uncommented(closed[rest:]):
                raise Unreadable(closed[rest:])
            return got
        if text[0] in "&*!%@`":
            raise Unreadable(text)
        lines = [uncommented(text)]
        while not re.search(r"(?:^|\s)#", text) and self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= depth:
                break
            lines.append(uncommented(line))
            self.at += 1
        while len(lines) > 1 and not lines[-1]:
            lines.pop()
        return plain(lines[0]) if len(lines) == 1 else folded(lines)

    def closed(self, text: str, depth: int) -> str:
        """``text`` with the lines up to its closing quote or bracket."""
        while True:
            try:
                flow(text, 0)
                return text
            except IndexError:
                if self.at == len(self.lines):
                    raise Unreadable("not closed") from None
                text, self.at = text + "\n" + self.lines[self.at], self.at + 1

    def block(self, head: str, depth: int) -> str:
        m = re.fullmatch(r"([|>])(?:([1-9])?([-+])?|([-+])([1-9]))", uncommented(head))
        if not m:
            raise Unreadable(head)
        keep, lines = m[3] or m[4], []
        margin = depth + int(m[2] or m[5]) if m[2] or m[5] else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip() and own <= depth:
                break
            margin = own if margin is None and line.strip() else margin
            lines.append(line[margin or 0 :] if line.strip() else line[margin:] if margin and len(line) > margin else "")
            self.at += 1
        body = [*lines]
        while body and not body[-1]:
            body.pop()
        end = "\n" * (len(lines) - len(body) + bool(body)) if keep == "+" else "" if keep == "-" or not body else "\n"
        if m[1] == "|":
            return "\n".join(body) + end
        out = ""
        for before, line in zip([None, *body], body, strict=False):
            deep = line[:1] == " " or (before or "")[:1] == " "
            out += ("" if before is None else "\n" if deep or not line else "" if not before else " ") + line
        return out + end


def flow(text: str, at: int):
    """A flow value at ``at`` and where it ends; IndexError where the text ends before it."""
    while text[at].isspace():
        at += 1
    if text[at] in "\"'":
        end = at + 1
        while text[end] != text[at] or (text[at] == "'" and text[end + 1 : end + 2] == "'"):
            end += 2 if text[end] == "\\" and text[at] == '"' or text[end] == text[at] else 1
        return quoted(text[at : end + 1]), end + 1
    if text[at] not in "[{":
        m = re.compile(r"(?:[^,\[\]{}#:]|:(?=[^\s,\]}])|(?<=\S)#)*").match(text, at)
        if m.end() == len(text):
            raise IndexError
        return plain(" ".join(m[0].split())), m.end()
    close, is_map = "]}"[text[at] == "{"], text[at] == "{"
    out, at = ({} if is_map else []), at + 1
    while True:
        while text[at].isspace() or text[at] == ",":
            at += 1
        if text[at] == close:
            return out, at + 1
        key, at = flow(text, at)
        while text[at].isspace():
            at += 1
        value = None
        if text[at] == ":":
            value, at = flow(text, at + 1)
            if not is_map:
                key = {key: value}
        if is_map:
            if isinstance(key, (list, dict)):
                raise Unreadable("key")
            out[str(key) if key is not None else ""] = value
        else:
            out.append(key)
        while text[at].isspace():
            at += 1
        if text[at] not in "," + close:
            raise Unreadable(text[at:])


def read(text: str):
    """The value of a YAML text; ``Unreadable`` where it isn't of the forms above."""
    reader = Reader(text.replace("\r\n", "\n"))
    try:
        out = reader.node(0)
    except (IndexError, RecursionError) as e:
        raise Unreadable(str(e)) from None
    if reader.indent() is not None:
        raise Unreadable(reader.lines[reader.at])
    return out


def json_of(text: str) -> str | None:
    try:
        return json.dumps(read(text), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


def as_json(text: Column) -> Column:
    """YAML texts as JSON, in Arrow batches; null for null and for what can't be read."""
    return mapped(json_of)(text)
