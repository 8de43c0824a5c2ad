"""Quality classifier: a sparse rule ensemble that compiles to column expressions.

Small trees over text statistics are grown on a bounded labelled sample. Every path from
a root is a rule, a conjunction of thresholds; a lasso logistic fit keeps few of them. The
kept rules with their weights become one column expression over the statistics, which are
column functions themselves, so scoring is a plain projection of whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; for null and empty texts all are 0."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text).cast("double")

    def share(chars: str) -> Column:
        return F.when(size > 0, (size - F.length(F.translate(text, chars, ""))) / size).otherwise(0.0)

    def variety(pattern: str) -> Column:
        parts = F.split(text, pattern)
        return F.when(size > 0, F.size(F.array_distinct(parts)) / F.size(parts)).otherwise(0.0)

    return {
        "size": size,
        "marks": share("#$%&*!"),
        "bars": share("|"),
        "upper": share(UPPER),
        "digits": share("0123456789"),
        "spaces": share(" \n\t"),
        "lines": share("\n"),
        "stops": share("."),
        "commas": share(","),
        "word_variety": variety(" "),
        "line_variety": variety("\n"),
        "odd": share("<>{}[]=@_/\\\"'+()"),
    }


Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    names: list[str]
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def column(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = None
            for k, above, limit in rule:
                test = values[self.names[k]] > limit if above else values[self.names[k]] <= limit
                held = test if held is None else held & test
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, out: set) -> None:
    """Add to ``out`` the path of every node below the root of a tree grown on ``rows``."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 40 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None)
    part, target = x[rows], y[rows]
    parent = target.var() * len(rows)
    for k in features.tolist():
        for limit in np.unique(np.quantile(part[:, k], np.linspace(0.04, 0.96, 24))):
            left = part[:, k] <= limit
            n = int(left.sum())
            if 10 <= n <= len(rows) - 10:
                gain = parent - target[left].var() * n - target[~left].var() * (len(rows) - n)
                if gain > best[0]:
                    best = (gain, (k, float(limit), left))
    if best[1] is not None:
        k, limit, left = best[1]
        grow(x, y, rows[left], features, depth - 1, (*path, (k, False, limit)), out)
        grow(x, y, rows[~left], features, depth - 1, (*path, (k, True, limit)), out)


def holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, limit in rule:
        out &= (x[:, k] > limit) if above else (x[:, k] <= limit)
    return out


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 40, penalty: float = 0.002, rounds: int = 400) -> RuleModel:
    """Rules from trees on random rows and features, then proximal gradient steps with momentum."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, [], [], float(np.log(share / (1 - share))))
    rng, found = np.random.default_rng(7), set()
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 2500), replace=False)
        grow(x, y, rows, rng.choice(x.shape[1], min(5, x.shape[1]), replace=False), 3, (), found)
    rules = sorted(found)
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    mean = z.mean(axis=0)
    z -= mean
    step = 4 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, bias, v, b, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(rounds):
        slope = 1 / (1 + np.exp(-(z @ v + b))) - y
        new = v - step * (z.T @ slope / len(y))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_bias, new_t = b - step * slope.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, b = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    kept = np.flatnonzero(w)
    return RuleModel(names, [rules[k] for k in kept], w[kept].tolist(), float(bias - mean @ w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 12_000) -> RuleModel:
    """A model from at most ``most_rows`` labelled rows, those whose ids have the least hashes.

    Rows with a null label or text id are left out; a text that is null counts as empty.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    some = named.select(id_col, F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64(id_col), id_col, "y").limit(most_rows)
    values = statistics(F.col(text_col))
    rows = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select("y", *[v.alias(k) for k, v in values.items()]).collect()
    data = np.array(sorted([tuple(r) for r in rows]), float).reshape(-1, len(values) + 1)
    return fit_rules(list(values), data[:, 1:], data[:, 0])


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1. Null and empty texts are scored by zero statistics.

    Other columns are kept, one named ``score`` is replaced; repeated rows score alike.
    """
    held = docs.withColumn("_statistics", F.struct(*[v.alias(k) for k, v in statistics(F.col(text_col)).items()]))
    values = {k: F.col(f"_statistics.{k}") for k in model.names}
    return held.withColumn("score", model.column(values)).drop("_statistics")
