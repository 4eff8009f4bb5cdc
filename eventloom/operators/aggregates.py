"""Aggregations over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dicts, tagging, text


def as_map(df: DataFrame, by: list[str], key: str, value: str, out: str) -> DataFrame:
    """Rows to one map a group; keys are few (categories, tags)."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def daily_summary(events: DataFrame) -> DataFrame:
    """One row a date: totals, and maps by category and tag."""
    base = events.groupBy("date").agg(F.count(F.lit(1)).alias("total_db"), F.count_if("is_top").alias("total_top"))
    cats = as_map(events.groupBy("date", "category").agg(F.count(F.lit(1)).alias("n")), ["date"], "category", "n", "by_category")
    stats = tagging.tag_stats(events, ["date"])
    tags = as_map(stats.select("date", "tag", "events"), ["date"], "tag", "events", "by_tag")
    mentions = as_map(stats.select("date", "tag", "mentions"), ["date"], "tag", "mentions", "mentions_by_tag")
    high = as_map(stats.where("high > 0").select("date", "tag", "high"), ["date"], "tag", "high", "high_importance_by_tag")
    for part in (cats, tags, mentions, high):
        base = base.join(part, "date", "left")
    return base.withColumn("tags_version", F.lit(dicts.TAGS_VERSION))


def top_entities(events: DataFrame, n: int = 10) -> DataFrame:
    """Entities by the number of events that name them; the display name is the least."""
    rows = events.select("seq", F.explode("who").alias("name")).select("seq", "name", text.entity_key("name").alias("key")).where(F.length("key") >= 2)
    counted = rows.groupBy("key", "seq").agg(F.min("name").alias("name")).groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.min("name").alias("name"))
    return counted.orderBy(F.col("events").desc(), "key").limit(n)


def category_share(events: DataFrame) -> DataFrame:
    """Events of each category and their percent of all."""
    counts = events.groupBy(F.coalesce("category", F.lit("_other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total), F.lit(True)).withColumn("pct", F.round(100 * F.col("n") / F.col("_all"), 6)).drop("_all")


def headline(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("category").alias("categories"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))


def event_key_clusters(events: DataFrame, most_names: int = 6) -> DataFrame:
    """Groups by event key: the head has the largest importance, then the least seq; vague keys stand alone.

    Source names, split at slashes, come in the order of the rows, each once, the first few with
    the number of the rest; the other rows' titles likewise. Only distinct values are collected.
    """
    key = F.regexp_replace(F.lower(F.trim("event_key")), r"\s*[|｜]\s*", "|")
    key = F.regexp_replace(key, r"\s+", " ")
    unclear = key.isNull() | ~F.contains(key, F.lit("|")) | (F.length(key) < 5)
    rows = events.withColumn("_key", F.when(unclear, F.concat(F.lit("single:"), F.col("seq").cast("string"))).otherwise(key))
    head = F.max_by(F.struct("seq", "title"), F.struct(F.col("importance"), (-F.col("seq")).alias("s")))
    groups = rows.groupBy("_key").agg(head.alias("_h"), F.count(F.lit(1)).alias("n"), F.max("importance").alias("importance"))
    part = rows.select("_key", "seq", F.posexplode(F.split(F.coalesce("source_name", F.lit("")), "/")).alias("i", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    names = part.groupBy("_key", "name").agg(F.min(F.struct("seq", "i")).alias("f")).groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "name"))), lambda s: s["name"]).alias("_names"))
    titles = rows.join(groups.select("_key", F.col("_h.seq").alias("_head")), "_key").where(F.col("seq") != F.col("_head")).groupBy("_key", "title").agg(F.min("seq").alias("at"))
    titles = titles.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda s: s["title"]).alias("others"))
    out = groups.join(names, "_key", "left").join(titles, "_key", "left")
    held = F.coalesce("_names", F.array().cast("array<string>"))
    more = F.size(held) - most_names
    label = F.concat(F.array_join(F.slice(held, 1, most_names), " / "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))
    return out.select(F.col("_h.seq").alias("head_seq"), F.col("_h.title").alias("title"), "n", "importance", label.alias("sources"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))


def paired_tags(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(seq, tag, predicted, truth) by a full outer join of two (seq, tags) tables; rows that either lacks are left out."""
    both = predicted.where(F.col("tags").isNotNull()).select("seq").join(truth.where(F.col("tags").isNotNull()).select("seq"), "seq")
    one = lambda df, n: df.join(both, "seq", "left_semi").select("seq", F.explode(F.array_distinct("tags")).alias("tag"), F.lit(True).alias(n))
    out = one(predicted, "predicted").join(one(truth, "truth"), ["seq", "tag"], "full")
    return out.select("seq", "tag", F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("truth", F.lit(False)).alias("truth"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Precision and recall by tag from rows (tag, predicted, truth)."""
    out = pairs.groupBy("tag").agg(F.count_if(F.col("predicted") & F.col("truth")).alias("tp"), F.count_if(F.col("predicted") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("predicted") & F.col("truth")).alias("fn"))
    return out.withColumns({"precision": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6)})


def worst_tags(pairs: DataFrame, n: int = 12) -> DataFrame:
    """The tags with the most disagreements, ties by name."""
    return agreement(pairs).orderBy((F.col("fp") + F.col("fn")).desc(), "tag").limit(n)


def overall_agreement(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: usable rows, those with equal tag sets, and precision and recall over all tags."""
    same = lambda c: F.array_sort(F.array_distinct(c))
    rows = predicted.select("seq", same("tags").alias("p")).join(truth.select("seq", same("tags").alias("t")), "seq").where(F.col("p").isNotNull() & F.col("t").isNotNull())
    hit = F.size(F.array_intersect("p", "t"))
    out = rows.agg(F.count(F.lit(1)).alias("usable"), F.count_if(F.col("p") == F.col("t")).alias("exact"), F.sum(hit).alias("_tp"), F.sum(F.size("p")).alias("_p"), F.sum(F.size("t")).alias("_t"))
    return out.select("usable", "exact", F.round(F.coalesce(F.try_divide("_tp", "_p"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.try_divide("_tp", "_t"), F.lit(0.0)), 6).alias("recall"))


def quality_audit(events: DataFrame, warn_below: float = 0.8) -> DataFrame:
    """One row: events, real covers, their share and whether it warns, weak long texts, and whether the run fails (no event, or no real cover)."""
    from eventloom.functions import text

    real = F.coalesce(F.col("cover_image.kind").isin("remote", "local") & (F.coalesce("cover_image.url", F.lit("")) != ""), F.lit(False))
    out = events.agg(F.count(F.lit(1)).alias("events"), F.count_if(real).alias("covers"), F.count_if(~text.good_fulltext("full_content", "summary", 80, 1.3)).alias("weak_texts"))
    share = F.coalesce(F.try_divide(F.col("covers"), F.col("events")), F.lit(0.0))
    return out.withColumns({"cover_share": F.round(share, 6), "warn": share < warn_below, "failed": (F.col("events") == 0) | (F.col("covers") == 0)})


def summaries_or_recomputed(events: DataFrame, stored: DataFrame) -> DataFrame:
    """One summary a date of ``events``: the stored one (as JSON), else what the events give."""
    own = daily_summary(events)
    fresh = own.select("date", F.to_json(F.struct(*[F.col(c) for c in own.columns if c != "date"])).alias("_fresh"))
    out = fresh.join(stored.select("date", F.col("summary").alias("_stored")), "date", "left")
    return out.select("date", F.coalesce("_stored", "_fresh").alias("summary"), F.col("_stored").isNotNull().alias("was_stored"))
