"""Tags: cleaning, merging and the rule tagger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dicts

NO_TAGS = "array<string>"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_token(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[\s\-/]+", "_"), "[^a-z0-9_]", "")


def normalize_tags(raw: Column, limit: int = dicts.MAX_TAGS, tags: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Known tags of an array, aliases resolved, in first-seen order, at most ``limit``."""
    tags, aliases = tags or dicts.TAG_IDS, dicts.TAG_ALIASES if aliases is None else aliases
    known, names, targets = _array(tags), _array(list(aliases)), _array(list(aliases.values()))

    def one(x: Column) -> Column:
        t = clean_token(x)
        return F.when(F.array_contains(known, t), t).when(F.array_contains(names, t), F.get(targets, F.array_position(names, t).cast("int") - 1))

    found = F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast(NO_TAGS)), one), lambda t: t.isNotNull()))
    return F.slice(found, 1, limit)


def split_tags(raw: Column) -> Column:
    return F.split(raw, "[,，、;；|]")


def merge_tags(lists: Column, limit: int = dicts.MAX_TAGS) -> Column:
    """An array of tag arrays to one: by how many hold a tag, then by first sight."""
    flat = F.flatten(lists)
    seen = F.array_distinct(flat)
    scored = F.transform(seen, lambda t, i: F.struct((-F.size(F.filter(flat, lambda x: x == t))).alias("n"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(scored), lambda s: s["t"]), 1, limit)


def load_rules(rows: DataFrame) -> list[tuple[str, list[str], list[str]]]:
    """Rules from a table (tag, pos, kind: keyword or exclude, pattern), tags by their least pos; the dictionary is the caller's."""
    found: dict[str, tuple[list, list]] = {}
    for r in rows.orderBy("pos").collect():  # a dictionary, some hundred rows
        found.setdefault(r["tag"], ([], []))[r["kind"] == "exclude"].append(r["pattern"])
    return [(tag, keep, drop) for tag, (keep, drop) in found.items()]


def rule_scores(title: Column, body: Column, rules: list) -> Column:
    """Array of (-score, position, tag) of all rules not excluded."""
    full = F.concat_ws(" ", title, body)
    out = []
    for pos, (tag, patterns, excludes) in enumerate(rules):
        score = sum((F.when(title.rlike(f"(?i){p}"), 2).when(body.rlike(f"(?i){p}"), 1).otherwise(0) for p in patterns), F.lit(0))
        if excludes:
            score = F.when(full.rlike("(?i)" + "|".join(f"(?:{e})" for e in excludes)), 0).otherwise(score)
        out.append(F.struct((-score).alias("s"), F.lit(pos).alias("p"), F.lit(tag).alias("t")))
    return F.array(*out)


def rule_tags(title: Column, body: Column, rules: list, limit: int = dicts.MAX_TAGS, least: int = dicts.RULE_MIN_SCORE) -> Column:
    """The best ``limit`` tags by rule: a pattern in the title counts 2, else in the body 1."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    good = F.filter(rule_scores(title, body, rules), lambda s: s["s"] <= -least)
    return F.slice(F.transform(F.array_sort(good), lambda s: s["t"]), 1, limit)


def tag_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """Per tag: events, mentions (null counts as the number of sources, else 1; a stored 0 stays 0), events of high importance."""
    held = F.nullif(F.size("sources"), F.lit(0)) if "sources" in events.columns else F.lit(None).cast("int")
    mentions = F.coalesce(F.col("mention_count") if "mention_count" in events.columns else F.lit(None).cast("int"), F.when(held > 0, held), F.lit(1))
    rows = events.select(*by, F.explode(F.array_distinct("tags")).alias("tag"), "importance", mentions.alias("_mentions"))
    return rows.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("events"), F.sum("_mentions").cast("long").alias("mentions"), F.count_if(F.col("importance") >= dicts.HIGH_IMPORTANCE).alias("high"))


def tag_spec(tags: DataFrame) -> DataFrame:
    """(group, spec): a group's tags as lines, from a table (tag, grp, label, descr, deprecated, pos); deprecated ones are hidden."""
    line = F.concat(F.lit("- "), "tag", F.lit(" ("), F.coalesce("label", F.lit("")), F.lit("): "), F.coalesce("descr", F.lit("")))
    shown = tags.where(~F.coalesce("deprecated", F.lit(False)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"])
    return shown.groupBy("grp").agg(F.array_join(lines, "\n").alias("spec"))


def report(events: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(tag, events, pct of all events) for every tag of the dictionary; an unused one has 0."""
    spark = events.sparkSession
    known = spark.createDataFrame([(t, k) for k, t in enumerate(tags or dicts.TAG_IDS)], "tag string, pos int")
    counts = events.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("events"))
    every = events.agg(F.count(F.lit(1)).alias("_all"))
    out = known.join(counts, "tag", "left").join(F.broadcast(every), F.lit(True))
    return out.select("tag", F.coalesce("events", F.lit(0)).alias("events"), F.round(F.coalesce(F.try_divide(100 * F.coalesce("events", F.lit(0)), F.col("_all")), F.lit(0.0)), 6).alias("pct"))
