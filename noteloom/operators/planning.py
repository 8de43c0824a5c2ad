"""Plans and tasks: kinds of subpoints, units still to do, listings, names for linking, failover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as tx

#: The kinds of subpoints that each domain knows; the first domain stands for unknown ones.
KINDS = {
    "technical": ("definition", "mechanism", "parameters", "example", "comparison", "pitfalls"),
    "humanities": ("context", "key_idea", "interpretations", "terms_persons", "critique", "connections"),
    "life_management": ("principle", "when_to_apply", "steps", "scenario", "mistakes", "checklist"),
}


def normalized_kind(domain: Column, kind: Column) -> Column:
    """``kind`` if the domain knows it, else ``other``."""
    known = F.lit(False)
    for name, kinds in KINDS.items():
        mine = (domain == name) | (~domain.isin(*KINDS) if name == "technical" else F.lit(False))
        known = known | (mine & kind.isin(*kinds))
    return F.when(known, kind).otherwise("other")


def undone(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return units.join(done.select(*keys).distinct(), keys, "left_anti")


def first_success(attempts: DataFrame) -> DataFrame:
    """The first attempt of each request that worked; requests whose attempts all failed are left out."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("attempt"))
    return attempts.where("ok").withColumn("place", place).where("place = 1").drop("place", "ok")


def preview(label: Column, limit: int = 60) -> Column:
    return F.when(F.length(label) > limit, F.concat(F.substring(label, 1, limit - 3), F.lit("…"))).otherwise(label)


def moscow_time(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Europe/Moscow"), "dd.MM.yyyy HH:mm"), F.lit(" по мск"))


def link_names(drafts: DataFrame) -> DataFrame:
    """``name`` by which each draft is linked: its title if it is new, the stem of its file if it exists."""
    name = F.when(F.col("action") == "create", F.col("title")).otherwise(tx.stem(F.col("path")))
    return drafts.select(name.alias("name")).distinct()


def totals(subpoints: DataFrame) -> DataFrame:
    """Notes and subpoints of each plan."""
    return subpoints.groupBy("task_id").agg(F.count_distinct("note_id").alias("n_notes"), F.count("*").alias("n_subpoints"))


def moved(plans: DataFrame, domain: str) -> DataFrame:
    """``plans (kinds array)`` under another domain: kinds normalized, ``resets`` counts those that changed."""
    kinds = F.transform("kinds", lambda k: normalized_kind(F.lit(domain), k))
    changed = F.size(F.filter(F.zip_with("kinds", kinds, lambda a, b: a != b), lambda x: x))
    return plans.select(*[c for c in plans.columns if c != "kinds"], kinds.alias("kinds"), changed.cast("long").alias("resets"))


def renamed(items: Column, place: int, name: Column) -> Column:
    """A plan's items with another one at a place."""
    return F.transform(items, lambda x, i: F.when(i == place, name).otherwise(x))


def removed(items: Column, place: int) -> Column:
    return F.filter(items, lambda x, i: i != place)


def added(items: Column, item: Column) -> Column:
    return F.array_append(items, item)


def staged_listing(tasks: DataFrame, drafts: DataFrame, results: DataFrame) -> DataFrame:
    """``task_id, label, created, creates, updates, validation``: staged tasks as a reader sees them, oldest first.

    ``tasks`` has ``task_id, raw_query, created_at``, ``results`` ``task_id, errors, warnings, ok`` of those that were checked. A task
    without a query is called by its map of content, else by its first new note, else by a dash.
    """
    new = F.col("action") == "create"
    own = drafts.groupBy("task_id").agg(
        F.min_by(F.when(new & F.col("is_moc"), F.col("title")), F.when(new & F.col("is_moc"), F.col("ord"))).alias("map"), F.min_by(F.when(new, F.col("title")), F.when(new, F.col("ord"))).alias("first"),
        F.count_if(new).alias("creates"), F.count_if(~new).alias("updates"),
    )
    rows = tasks.join(own, "task_id", "left").join(results, "task_id", "left")
    named = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("raw_query", "map", "first")], F.lit("—"))
    warned = F.concat(F.lit("warnings="), F.col("warnings").cast("string"), F.lit(")"))
    checked = F.when(F.col("ok").isNull(), "не проверялся").when(F.col("ok"), F.concat(F.lit("OK ("), warned)).otherwise(
        F.concat(F.lit("ЕСТЬ ОШИБКИ (errors="), F.col("errors").cast("string"), F.lit(", "), warned)
    )
    return rows.orderBy("created_at", "task_id").select(
        "task_id", preview(named).alias("label"), moscow_time(F.col("created_at")).alias("created"),
        F.coalesce("creates", F.lit(0)).alias("creates"), F.coalesce("updates", F.lit(0)).alias("updates"), checked.alias("validation"),
    )
