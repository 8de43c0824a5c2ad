"""PII surrogates: keyed, reversible-format replacements of detected entities.

Every entity is reduced to a canonical form, so one person's number in two notations gets
one surrogate. The characters of each class (digits, vowels, consonants, by script) form a
number in that class's base, and a keyed Feistel permutation E over all numbers of that
length gives E^-1(E(x) + 1). That is a bijection without fixed points: different entities
of a kind and shape keep different surrogates over the whole corpus without any lookup,
and none keeps its own value. Given names and surnames of the lists below go to others of
their list and length, in an order drawn by the key. Titles stay, and the last letter of a
name that no list has, for gender. Characters of any other script form classes by the
script and kind that their Unicode names give, so none passes through unread.
"""

from __future__ import annotations

import hashlib
import hmac
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.tables import small_batches

#: Character classes that map onto themselves.
CLASSES = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâãäåèéêëìíîïòóôõöùúûü",
    "çñ",
    "аеиоуыэюяё",
    "бвгджзклмнпрстфхцчшщй",
]
HEX = "0123456789abcdef"
#: Further letters by blocks: Latin beyond ASCII, Greek, Cyrillic. Only those with one letter of each case.
for low, high in ((0xDF, 0x250), (0x370, 0x400), (0x430, 0x530)):
    block = [c for c in map(chr, range(low, high)) if c.islower() and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c]
    CLASSES.append("".join(c for c in block if not any(c in known for known in CLASSES)))
#: Titles in any case; those that are also other words or short forms need their own case, a dot, or capitals after them.
TITLES = (
    r"(?i:Mr|Mrs|Prof|Herr|Frau|Señor|Señora|Sra|Monsieur|Madame|Mme|Mlle|Господин|Госпожа)"
    r"|Ms|Miss|Dr|Sr|(?i:Ms|Dr|Sr)(?=\.)|(?:MISS|DR)(?=\s\p{Lu}{2})"
)
#: Names by gender and script; a name's surrogate is another of its list and length.
NAMES = {
    "female": "Ada Amy Ana Eva Ida Lea Mia Zoe Anna Clara Emma Ella Elsa Jane Lena Lisa Mary Nina Rosa Ruth Sara "
    "Alice Carla Diana Emily Irene Julia Laura Linda Maria Paula Sofia Susan Agnes Greta "
    "Amelia Andrea Astrid Bianca Carmen Helena Louise Monica Regina Sandra Sophie Teresa",
    "male": "Ben Dan Ian Jan Leo Max Sam Tom Adam Carl Eric Hugo Ivan Jack John Karl Luis Otto Paul Pete Rolf "
    "Aaron Bruno David Diego Felix Henry James Jorge Lukas Marco Oscar Peter Simon "
    "Albert Carlos Daniel Edward George Joseph Jürgen Martin Miguel Robert Thomas Walter",
    "family": "Diaz Klee Lang Ross Wolf Adams Bauer Brown Clark Evans Jones Klein López Lopez Moser Silva Smith Weber White "
    "Becker Cooper Fuchs Garcia Keller Martin Miller Moreno Parker Richter Romero Schulz Taylor Torres Turner Walker Wagner Wilson",
    "female, Cyrillic": "Анна Вера Инна Нина Алина Дарья Елена Ирина Мария Ольга Марина Полина Тамара Галина",
    "male, Cyrillic": "Глеб Егор Иван Олег Антон Борис Денис Игорь Павел Роман Виктор Кирилл Михаил Сергей",
}
#: Names that are also common words, months or days. They count as a name only beside a name or title.
COMMON = set("april august baker bill bishop brown chance chase christian cook day dean drew faith frank grace grant green hope "
             "an as at by de do du el en es go he hi il if in is it la le me my no of ok on or so to un up us we "
             "hunter jack joy june king lane lang law long major mark may miller rich rose sunday price white will wolf young".split())
PARTICLE = r"(?:d['’]|(?:de|von|van|der|den|di|da|la|le) ){0,2}"
WORD = rf"{PARTICLE}(?=\p{{L}}\p{{M}}*['’]?\p{{L}})\p{{Lu}}[\p{{L}}\p{{M}}]*(?:['’]\p{{L}}[\p{{L}}\p{{M}}]+)*"
CASELESS = r"(?:\p{Han}{1,4}|(?!\p{Han})\p{Lo}[\p{Lo}\p{M}]*)"
SPACE = r"[^\S\r\n]{1,4}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
NATIONAL = r"0\d{1,4}[ /-]\d{5,8}"
NAME = rf"(?:{WORD}(?:-{WORD})*|{CASELESS})"
INITIAL = r"\p{Lu}\p{M}*(?:\.|(?![\p{L}\p{M}'’]))"
PATTERNS = {
    "email": r"[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\+\d{2} \d{2,4} \d{5,8}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d)|(?<![\d.,-])" + NATIONAL + r"(?!\d)",
    "name": rf"\b(?:{TITLES})(?:\.\s{{0,4}}|{SPACE})(?:(?:{INITIAL}{SPACE}?){{0,3}}{NAME}(?:{SPACE}\p{{Lu}}\.)?(?:{SPACE}{NAME})?|(?!I\b){INITIAL})",
}
FINDER = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
HINT = regex.compile(rf"[@\d]|::|\b(?:{TITLES})\b")
TITLE = regex.compile(rf"(?:{TITLES})\.?\s*(?=\S)")
SEPARATOR = regex.compile(r"([\s\-'’.])")
CLASS_OF = {c: k for k, chars in enumerate(CLASSES) for c in chars}
#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()


#: Script, kind, whether there is a capital of one letter, and whether it is an ordinary form, none for display only.
Kind = tuple[str, str, bool, bool]


@lru_cache(1)
def further_classes() -> dict[Kind, str]:
    """Letters and numbers outside ``CLASSES`` by script, kind, and whether they have a capital of one letter."""
    found: dict[Kind, list[str]] = defaultdict(list)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.isalnum() and c not in CLASS_OF and c == lowered(c):
            found[kind_of(c)].append(c)
    return {kind: "".join(chars) for kind, chars in found.items()}


def lowered(c: str) -> str:
    """The small letter of a capital, if capital and small letter are one of each."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


@lru_cache(100_000)
def kind_of(c: str) -> Kind:
    script = "everyday ideograph" if "\u4e00" <= c <= "\u9fa5" else unicodedata.name(c, "?").split()[0]
    paired = len(c.upper()) == 1 and c.upper() != c and lowered(c.upper()) == c
    return script, unicodedata.category(c), paired, unicodedata.is_normalized("NFKC", c)


def letters_of(kind: int | Kind) -> str:
    return CLASSES[kind] if isinstance(kind, int) else further_classes()[kind]


@lru_cache(100_000)
def place_of(c: str) -> tuple[int | Kind, int] | None:
    """The class of a letter or number and its place in it; None for other characters."""
    kind = CLASS_OF.get(c, kind_of(c) if c.isalnum() else None)
    return None if kind is None else (kind, letters_of(kind).index(c))


def country_digits(number: str) -> int:
    """How many digits of an international number are its country's."""
    digits = "".join(str(int(c)) for c in number if c.isdecimal())
    return 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3


def iban_remainder(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


class Permutation:
    """Keyed fixed-point-free bijections on digit lists of any base and length."""

    def __init__(self, key: bytes):
        self.key = key

    @lru_cache(maxsize=100_000)  # noqa: B019  one object a worker
    def pad(self, tweak: str, round_: int, side: tuple[int, ...], size: int) -> int:
        said = f"{tweak}|{round_}|{size}|{','.join(map(str, side))}".encode()
        return int.from_bytes(hmac.digest(self.key, said, hashlib.sha256), "big") % size

    def feistel(self, tweak: str, digits: list[int], base: int, sign: int) -> list[int]:
        half = len(digits) // 2
        sides = [digits[:half], digits[half:]]
        for r in range(8) if sign > 0 else reversed(range(8)):
            a, b = sides[r % 2], sides[1 - r % 2]
            size = base ** len(b)
            value = 0
            for d in b:
                value = value * base + d
            value = (value + sign * self.pad(tweak, r, tuple(a), size)) % size
            for k in reversed(range(len(b))):
                value, b[k] = divmod(value, base)
        return sides[0] + sides[1]

    def __call__(self, tweak: str, digits: list[int], base: int) -> list[int]:
        if not digits:
            return []
        tweak = f"{tweak}|{base}|{len(digits)}"
        out = self.feistel(tweak, list(digits), base, 1)
        for k in reversed(range(len(out))):  # add one
            out[k] = (out[k] + 1) % base
            if out[k]:
                break
        return self.feistel(tweak, out, base, -1)


def digit_like(c: str, d: int) -> str:
    """The digit ``d`` of the script that the digit ``c`` is of."""
    return chr(ord(c) - int(c) + d)


class Replacer:
    def __init__(self, key: bytes):
        self.permute = Permutation(key)
        self.listed: dict[str, str] = {}  # each name of a list to the next one of its length, in keyed order
        for kind, names in NAMES.items():
            by_length = defaultdict(set)
            for name in names.lower().split():
                by_length[len(name)].add(name)
            for some in by_length.values():
                some = sorted(some - self.listed.keys(), key=lambda n: hmac.digest(key, f"{kind}|{n}".encode(), hashlib.sha256))
                if len(some) > 1:
                    self.listed |= zip(some, some[1:] + some[:1], strict=True)

    def text(self, tweak: str, value: str) -> str:
        """Characters of each class permuted among the strings of the same shape; others and case stay."""
        out = [lowered(c) for c in value]
        places: dict[int | Kind, list[tuple[int, int]]] = defaultdict(list)
        for i, c in enumerate(out):
            if place := place_of(c):
                places[place[0]].append((i, place[1]))
        for kind, found in places.items():
            chars = letters_of(kind)
            shape = f"{tweak}|{kind if isinstance(kind, int) else ' '.join(map(str, kind))}"
            for (i, _), d in zip(found, self.permute(shape, [d for _, d in found], len(chars)), strict=True):
                out[i] = chars[d]
        return "".join(c.upper() if lowered(v) != v else c for c, v in zip(out, value, strict=True))

    def digits(self, tweak: str, value: str, keep: int = 0) -> str:
        """The digits after the first ``keep``, permuted; everything between them stays."""
        at = [i for i, c in enumerate(value) if c.isdecimal()][keep:]
        out = list(value)
        for i, d in zip(at, self.permute(tweak, [int(value[i]) for i in at], 10), strict=True):
            out[i] = digit_like(value[i], d)
        return "".join(out)

    def email(self, value: str) -> str:
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self.text('local', local)}@{self.text('host', host)}.{top}"

    def iban(self, value: str) -> str:
        """Digits of the account change; the check digits keep their remainder, so valid numbers stay valid."""
        country, check, rest = value[:2], value[2:4], value[4:]
        body = self.digits(f"iban|{country}", rest)
        body = body if body != rest else self.text(f"iban|{country}", rest)
        if 2 <= int(check) <= 98:
            old, new = (iban_remainder(country, "00", x.replace(" ", "")) for x in (rest, body))
            check = f"{(int(check) + old - new - 2) % 97 + 2:02d}"
        return country + check + body

    def ipv6(self, value: str) -> str:
        low = value.lower()
        at = [i for i, c in enumerate(low) if c in HEX]
        out = list(low)
        for i, d in zip(at, self.permute("ipv6", [HEX.index(low[i]) for i in at], 16), strict=True):
            out[i] = HEX[d]
        return "".join(c.upper() if value.isupper() else c for c in out)

    def ip(self, value: str) -> str:
        out = self.permute("ip", [int(x) for x in value.split(".")], 256)
        return ".".join(map(str, out))

    def ssn(self, value: str) -> str:
        return self.digits("ssn", value)

    def card(self, value: str) -> str:
        """The last digit keeps the Luhn remainder, so valid numbers stay valid and others do not become so."""
        at = max(i for i, c in enumerate(value) if c.isdecimal())
        head = self.digits("card", value[:at])
        rest = (luhn(value[: at + 1]) - luhn(head + "0")) % 10
        return head + digit_like(value[at], rest) + value[at + 1 :]

    def phone(self, value: str) -> str:
        """A country's digits stay, or the zero before an area; the rest changes."""
        keep = country_digits(value) if value[0] == "+" else 1 if regex.fullmatch(NATIONAL, value) else 0
        return self.digits("phone", value, keep)

    def word(self, value: str) -> str:
        """One word of a name, the same in any place and case.

        A listed one goes to another of its list. Of others the last letter stays, for gender,
        where the script has capitals; they never come out as a listed one. Initials change whole.
        """
        low = "".join(map(lowered, value))
        if low in self.listed:
            new = self.listed[low]
        elif sum(c.isalnum() for c in value) == 1 or lowered(value[0]) == value[0]:
            return self.text("initial" if len(value) == 1 else "name", value)
        else:
            end = max(i for i, c in enumerate(low) if c.isalnum())
            new = self.text("name", low[:end]) + low[end:]
            while new in self.listed:
                new = self.text("name", new[:end]) + new[end:]
        return "".join(c.upper() if lowered(v) != v else c for c, v in zip(new, value, strict=True))

    def name(self, value: str) -> str:
        at = TITLE.match(value).end()
        return value[:at] + "".join(self.word(p) if named(p) else p for p in SEPARATOR.split(value[at:]))


def named(word: str) -> bool:
    """Whether a piece of a name is one of its words: particles are not."""
    return word[:1].isalpha() and (lowered(word[0]) != word[0] or not word[0].islower())


def luhn(number: str) -> int:
    total = 0
    for k, c in enumerate(reversed([c for c in number if c.isdecimal()])):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def mentions(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Where else a text has the words of its names.

    One that the text also has as a common word, in small letters, or that is one of
    ``COMMON``, counts only right beside another word of a name. Ideographs have no ends
    of words, so two or more of them are found anywhere.
    """
    known = {w for a, b, kind in spans if kind == "name" for w in SEPARATOR.split(text[TITLE.match(text, a).end() : b]) if named(w)}
    ideographs = {w for w in known if regex.fullmatch(r"\p{Han}{2,}", w)}
    known = {w for w in known - ideographs if len(w) > 1}
    if not known | ideographs:
        return
    folded = {w.lower() for w in known if lowered(w[0]) != w[0]}
    forms = known | {w.capitalize() for w in folded} | {w.upper() for w in folded}
    one_of = lambda words: "|".join(map(regex.escape, sorted(words, key=lambda w: (-len(w), w))))
    parts = [rf"(?<![\p{{L}}\p{{M}}])(?:{one_of(forms)})(?![\p{{L}}\p{{M}}])"] if forms else []
    parts += [one_of(ideographs)] if ideographs else []
    small = folded and {m.group() for m in regex.finditer(rf"(?<![\p{{L}}\p{{M}}])(?:{one_of(folded)})(?![\p{{L}}\p{{M}}])", text)}
    doubtful = {w for w in folded if w in small or w in COMMON}
    found = [(m.start(), m.end(), m.group().lower() in doubtful) for m in regex.finditer("|".join(parts), text)]
    outside, at = [], iter([*spans, (len(text), len(text), "")])
    a, b, _ = next(at)
    for m in found:
        while b <= m[0] and a < len(text):
            a, b, _ = next(at)
        if m[1] <= a:
            outside.append(m)
    for k, (start, end, doubt) in enumerate(outside):
        before, after = outside[k - 1] if k else None, outside[k + 1] if k + 1 < len(outside) else None
        beside = (before and regex.fullmatch(r"[\s\-]", text[before[1] : start])) or (after and regex.fullmatch(r"[\s\-]", text[end : after[0]]))
        if not doubt or beside:
            yield start, end, "word"


def replaced(text: str, replacer: Replacer) -> tuple[str, list[dict]]:
    """The text with surrogates, and where the entities were in the original.

    Words of a name that has a title are replaced wherever else the text has them as names.
    """
    spans = [(m.start(), m.end(), m.lastgroup) for m in FINDER.finditer(text)] if HINT.search(text) else []
    spans = sorted([*spans, *mentions(text, spans)])
    out, last, found = [], 0, []
    for a, b, kind in spans:
        new = getattr(replacer, kind)(text[a:b])
        out += [text[last:a], new]
        last = b
        found.append({"kind": "name" if kind == "word" else kind, "start": a, "end": b, "surrogate": new})
    return "".join([*out, text[last:]]), found


ENTITIES = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("surrogate", "string"))
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def rewritten(batches: Iterable[pa.RecordBatch], text_col: str, key: bytes) -> Iterator[pa.RecordBatch]:
    replacer = Replacer(key)
    for batch in batches:
        names = batch.schema.names
        done = [(None, []) if t is None else replaced(t, replacer) for t in batch.column(names.index(text_col)).to_pylist()]
        keep = [n for n in names if n != "entities"]
        columns = [pa.array([t for t, _ in done], pa.string()) if n == text_col else batch.column(names.index(n)) for n in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([e for _, e in done], ARROW)], names=[*keep, "entities"])


def substitute(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the replaced ``entities`` (places in the original).

    ``key`` is a secret: with one key equal entities get equal surrogates in every row and
    every run, and who has it can undo them. Names are found by their titles, in any case and
    with any white space; their words are then replaced wherever the document has them as names,
    but those that are common words only beside another word of a name. A null text stays null and an empty one empty, both without
    entities. Other columns are kept, one named ``entities`` is replaced; repeated rows
    come out alike; texts are whole and no row is shuffled.
    """
    small_batches(docs.sparkSession)
    schema = docs.drop("entities").withColumn(text_col, F.col(text_col).cast("string")).schema.add("entities", ENTITIES)
    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return typed.mapInArrow(lambda it: rewritten(it, text_col, key), schema)


def clashes(found: DataFrame) -> DataFrame:
    """Of entities ``e`` and their texts ``original``, the surrogates of more than one value or of their own."""
    original = F.lower(F.substring("original", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")))
    pairs = found.select("e.kind", F.lower("e.surrogate").alias("surrogate"), original.alias("value")).distinct()
    counted = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max(F.col("value") == F.col("surrogate")).alias("same"))
    return counted.where("n > 1 or same")


def collisions(docs: DataFrame, replaced_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Surrogates that stand for more than one original of a kind, or equal theirs: no rows if all is well.

    Ids must be unique; rows with a null id take no part.
    """
    texts = docs.select(id_col, F.col(text_col).alias("original"))
    return clashes(replaced_docs.select(id_col, F.explode("entities").alias("e")).join(texts, id_col))


def own_collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``collisions`` of ``substitute`` under a key, with each original beside its surrogate: no text is shuffled, ids are not read."""
    text = F.col(text_col).cast("string")
    done = substitute(docs.select(text.alias("original"), text.alias("text")), key)
    return clashes(done.select("original", F.explode("entities").alias("e")))
