"""Secret scans in column functions alone: fixed forms, and a battery of randomness tests.

Places come from the gaps between matches: a split gives the gaps, an extract the matches,
and a prefix sum of their lengths the starts. Strings of key-like characters that hold
both letters and digits are candidates. For each one an encoding is inferred, and under
the hypothesis that it is random in that alphabet three p-values are taken: chi-squared
uniformity, runs about the middle of the alphabet, and lag-one serial correlation. They are
combined by Fisher's rule. What is random is a secret, so a report is false where its string
is not random. Within strata of encoding and length over all documents, the share of false
reports is estimated from the p-values, which are uniform for random strings, and held to
``rate``. This works on counts by stratum and tenth of a decade, a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of the base kinds, in the order in which they are listed.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 300
#: Candidates below this tenth of a decade, so with p-values above 0.1, tell how many random ones there are.
SURE = 10
#: Strata of fewer candidates borrow from their neighbours.
FEW = 20


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where lambdas inside ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array, by doubling steps."""

    def add(sums: Column, step: Column) -> Column:
        longer = F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0)))
        return F.when(step < F.size(sums), longer).otherwise(sums)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(31)]), values, add)


def places(text: Column, pattern: str, group: int, least: int) -> Column:
    """``start, end, value`` of the matches of ``pattern`` whose ``group`` has ``least`` characters."""

    def found(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.get(x["gaps"], i) + F.coalesce(F.length(F.get(x["m"], i - 1)), F.lit(0)))
        ends = F.zip_with(prefix_sums(steps), x["m"], lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end")))
        return F.zip_with(ends, x["v"], lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value")))

    parts = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
    )
    return F.filter(bound(parts, found), lambda x: F.length(x["value"]) >= least)


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def struct_of(old: Column, keep: str, **new: Column) -> Column:
    return F.struct(*[old[c].alias(c) for c in keep.split()], *[v.alias(c) for c, v in new.items()])


def tail(z: Column, t: Column) -> Column:
    """The normal distribution's upper tail, to seven places, with ``t = 1 / (1 + 0.3275911 |z| / sqrt 2)``."""
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = series * F.exp(-z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def tested(candidates: Column) -> Column:
    """Candidates with their length stratum and the tenth of a decade of the combined p-value.

    Each step is a pass over the candidates that binds what the next one uses, so no
    expression is written into another more than once.
    """
    base = "start end value"

    def coded(x: Column) -> Column:
        body = F.rtrim(F.translate(x["value"], "-_=", "+/ "))
        kind = F.when(body.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
        return struct_of(x, base, kind=kind, body=body)

    def cased(x: Column) -> Column:
        letters = F.when(x["kind"] == "hex", ALPHABETS["hex"]).when(x["kind"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
        body = F.when(x["kind"] == "hex", F.lower(x["body"])).otherwise(x["body"])
        return struct_of(x, base + " kind", letters=letters, body=body, chars=F.regexp_extract_all(body, F.lit("."), F.lit(0)))

    def valued(x: Column) -> Column:
        values = F.transform(x["chars"], lambda c: F.position(c, x["letters"]).cast("double"))
        kinds = F.array_distinct(x["chars"])  # no more than the alphabet has
        seen = F.transform(kinds, lambda c: F.pow((F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"), 2))
        n, m = F.size(x["chars"]).cast("double"), F.length(x["letters"]).cast("double")
        return struct_of(x, base + " kind", v=values, n=n, m=m, squares=sum_of(seen), mean=sum_of(values) / n)

    def centred(x: Column) -> Column:
        high = F.transform(x["v"], lambda v: (v > x["m"] / 2).cast("double"))
        return struct_of(x, base + " kind n m squares", off=F.transform(x["v"], lambda v: v - x["mean"]), high=high, above=sum_of(high))

    def measured(x: Column) -> Column:
        runs = sum_of(F.transform(x["high"], lambda h, i: F.when((i > 0) & (h != F.get(x["high"], i - 1)), 1.0).otherwise(0.0)))
        products = sum_of(F.transform(x["off"], lambda a, i: F.coalesce(a * F.get(x["off"], i + 1), F.lit(0.0))))
        return struct_of(
            x, base + " kind n", free=x["m"] - 1, chi=x["m"] / x["n"] * x["squares"] - x["n"], runs=runs + 1,
            mean=2 * x["above"] * (x["n"] - x["above"]) / x["n"] + 1, products=products, spread=sum_of(F.transform(x["off"], lambda a: a * a)),
        )

    def scored(x: Column) -> Column:
        unit = F.lit(2.0) / (9 * x["free"])
        chi = (F.pow(F.greatest(x["chi"], F.lit(0.0)) / x["free"], 1 / 3) - (1 - unit)) / F.sqrt(unit)
        var = (x["mean"] - 1) * (x["mean"] - 2) / (x["n"] - 1)
        runs = F.when(var > 0, F.abs(x["runs"] - x["mean"]) / F.sqrt(var)).otherwise(40.0)
        serial = F.when(x["spread"] > 0, F.abs(x["products"] / x["spread"] + 1 / x["n"]) * F.sqrt(x["n"] - 1)).otherwise(40.0)
        return struct_of(x, base + " kind n", z=F.array(chi, runs, serial))

    def rated(x: Column) -> Column:
        pairs = F.transform(x["z"], lambda z: F.struct(z.alias("z"), (1 / (1 + 0.3275911 * F.abs(z) / F.sqrt(F.lit(2.0)))).alias("t")))
        logs = F.transform(pairs, lambda q, i: -F.log(F.greatest(F.when(i > 0, 2.0).otherwise(1.0) * tail(q["z"], q["t"]), F.lit(1e-12))))
        return struct_of(x, base, stratum=F.concat_ws(":", x["kind"], F.floor(F.log2(x["n"])).cast("string")), half=sum_of(logs))

    def combined(x: Column) -> Column:
        p = F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2)
        return struct_of(x, base + " stratum", bin=F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40))))).cast("int"))

    for step in (coded, cased, valued, centred, measured, scored, rated, combined):
        candidates = F.transform(candidates, step)
    return candidates


def candidates_of(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string,stratum:string,bin:int>>")
    return F.when(text.rlike(CANDIDATE), tested(places(text, CANDIDATE, 0, 24))).otherwise(none)


def pooled(counts: DataFrame) -> DataFrame:
    """Counts ``stratum, bin, count`` in which strata of fewer than ``FEW`` candidates also have those of the next shorter and longer ones."""
    kind, level = F.split_part("stratum", F.lit(":"), F.lit(1)), F.split_part("stratum", F.lit(":"), F.lit(2)).cast("int")
    near = counts.withColumn("to", F.explode(F.array(level - 1, level, level + 1))).withColumn("own", level == F.col("to"))
    dealt = near.withColumn("stratum", F.concat_ws(":", kind, F.col("to").cast("string")))
    total = F.sum(F.when(F.col("own"), F.col("count")).otherwise(0)).over(Window.partitionBy("stratum"))
    kept = dealt.withColumn("total", total).where("total > 0").where((F.col("total") < FEW) | F.col("own"))
    return kept.groupBy("stratum", "bin").agg(F.sum("count").alias("count"))


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> dict[str, int]:
    """For each stratum the bin up to which candidates are reported; at most a few hundred strata.

    A stratum is an encoding and a power of two of the length, so their number is bounded.
    Random candidates have uniform p-values, whatever their length. So those above
    ``SURE`` tell how many random ones a stratum has, and how many of them to expect above
    any bound; what is above the bound beyond that is not random. The bound is the lowest at
    which this share of those reported is at most ``rate``; it may lie anywhere between two
    candidates, so that a stratum's only random string is found too. Strata of few candidates are
    judged with their neighbours. A random string whose p-value is above that of ``SURE`` (nine in
    ten) is found however few are like it, as is a lone string of words if its own is as high.
    """
    found = docs.select(F.explode(candidates_of(F.coalesce(F.col(text_col), F.lit("")))).alias("c"))
    counts = pooled(found.groupBy("c.stratum", "c.bin").count())
    stratum = Window.partitionBy("stratum")
    random_ = F.sum(F.when(F.col("bin") < SURE, F.col("count")).otherwise(0)).over(stratum) / (1 - 10 ** (-SURE / 10))
    placed = counts.withColumn("reported", F.sum("count").over(stratum.orderBy("bin"))).withColumn("random", random_)
    beyond = F.coalesce(F.lead("bin").over(stratum.orderBy("bin")), F.lit(BINS + 1))  # up to there no more are reported
    placed = placed.withColumn("beyond", beyond)
    wanted = F.col("random") * (1 - F.pow(F.lit(10.0), -F.col("beyond") / 10))
    rows = placed.where(F.col("reported") * (1 - rate) <= wanted).groupBy("stratum").agg(F.max("bin").alias("bin")).collect()
    return {r.stratum: r.bin for r in rows}


def scan(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """``docs`` with ``secrets``: spans of ``kind, start, end, value``, by start and then by kind.

    Starts and ends are code points, ends exclusive. A null or empty text has none. The
    base kinds are each found from left to right without overlaps; ``random`` spans that
    lie in a base span are left out. Other columns are kept, one named ``secrets`` is
    replaced; repeated rows and null ids are scanned like any other, and texts are whole.
    """
    limits = thresholds(docs, text_col, rate)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    bases = [
        F.when(text.rlike(ASSIGN), places(text, ASSIGN, 1, 8)).otherwise(none),
        F.when(text.contains("AKIA"), places(text, ACCESS, 0, 16)).otherwise(none),
        F.when(text.rlike(HEX), places(text, HEX, 0, 32)).otherwise(none),
    ]

    def named(spans: Column, k: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("place"), s["end"].alias("end"), s["value"].alias("value")),
        )

    base = F.concat(*[named(b, k) for k, b in enumerate(bases)])
    limit_of = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.lit(None).cast("map<string,int>")
    kept = F.filter(candidates_of(text), lambda c: c["bin"] <= F.coalesce(F.element_at(limit_of, c["stratum"]), F.lit(-1)))
    frame = docs.withColumn("secrets", F.struct(base.alias("base"), kept.alias("kept")))
    base, kept = F.col("secrets.base"), F.col("secrets.kept")
    fresh = F.filter(kept, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    spans = F.array_sort(F.concat(base, named(fresh, 3)))
    names = F.array(*[F.lit(k) for k in KINDS])
    out = F.transform(
        spans,
        lambda s: F.struct(F.get(names, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
    )
    return frame.withColumn("secrets", out)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == F.lit(kind)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """``docs`` with every found secret's value replaced by ``mark``; texts without any are unchanged.

    A value is the end of its span. Values that overlap become one mark; the same characters
    elsewhere in the text stay.
    """
    found = scan(docs, text_col, rate)
    values = F.transform("secrets", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end")))
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("gaps"))

    def add(state: Column, x: Column) -> Column:
        over = x["start"] < state["at"]
        gap = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        gaps = F.when(over, state["gaps"]).otherwise(F.array_append(state["gaps"], gap))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), gaps.alias("gaps"))

    def joined(state: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, F.length(text))
        return F.array_join(F.array_append(state["gaps"], rest), mark)

    clean = F.aggregate(F.array_sort(values), zero, add, joined)
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, clean).otherwise(text)).drop("secrets")
