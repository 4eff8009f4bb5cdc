"""Trending boost: entities new against a baseline that several sources name within days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import Scratch

RECENT_DAYS, BASELINE_DAYS, LEAST_SOURCES, STRONG_SOURCES, CEILING, LEAST_LENGTH = 7, 30, 3, 5, 9, 3


def recent_hits(entities: DataFrame, history: DataFrame, today, recent_days: int = RECENT_DAYS, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """(entity, source, date) of the recent days, once each, for ``entities`` that no baseline day names.

    ``history`` has (entity, source, date): joined by equality, so hot entities are reduced to
    distinct rows before they are shuffled.
    """
    day = F.lit(today).cast("date")
    past = history.where((F.col("date") >= F.date_sub(day, baseline_days)) & (F.col("date") < day)).select("entity", F.coalesce("source", F.lit("")).alias("source"), "date").distinct()
    fresh = F.col("date") >= F.date_sub(day, recent_days)
    new = entities.select("entity").distinct().join(past.where(~fresh).select("entity").distinct(), "entity", "left_anti")
    return past.where(fresh).join(new, "entity", "left_semi")


def with_current(hits: DataFrame, events: DataFrame, history: DataFrame, today, recent_days: int = RECENT_DAYS, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """``hits`` and (entity, source, ``today``) of the current events (seq, who, sources) that name a new entity.

    An entity that no recent day names counts too, by its current events alone. The sources are those
    of all events; ``event_trends`` gives each event its own.
    """
    day = F.lit(today).cast("date")
    known = history.where((F.col("date") >= F.date_sub(day, baseline_days)) & (F.col("date") < F.date_sub(day, recent_days))).select("entity").distinct()
    said = events.select("seq", F.explode("sources").alias("source"))
    now = named_entities(events).join(said, "seq").select("entity", F.coalesce("source", F.lit("")).alias("source"), day.alias("date")).distinct()
    return hits.unionByName(now.join(known, "entity", "left_anti"))


def trending_entities(hits: DataFrame) -> DataFrame:
    """(entity, sources, days) of recent hits."""
    return hits.groupBy("entity").agg(F.count_distinct("source").alias("sources"), F.count_distinct("date").alias("days"))


def named_entities(events: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(seq, pos, name, entity): the first two names of each event, and what is looked for."""
    named = events.select("seq", F.posexplode(F.slice("who", 1, 2)).alias("pos", "name"))
    return named.withColumn("entity", F.lower(F.trim("name"))).where(F.length("entity") >= least_length)


def event_trends(events: DataFrame, hits: DataFrame) -> DataFrame:
    """(seq, pos, name, sources, days) of events (seq, who, sources: array of names): the entity's recent sources
    together with the event's own, and its days together with the present one."""
    named = named_entities(events)
    own = named.join(events.select("seq", F.explode(F.array_distinct(F.transform("sources", lambda s: F.coalesce(s, F.lit(""))))).alias("source")), "seq")
    more = own.join(hits.select("entity", "source").distinct(), ["entity", "source"], "left_anti").groupBy("seq", "pos").agg(F.count(F.lit(1)).alias("more"))
    found = named.join(trending_entities(hits), "entity").join(more, ["seq", "pos"], "left")
    return found.select("seq", "pos", "name", (F.col("sources") + F.coalesce("more", F.lit(0))).alias("sources"), (F.col("days") + 1).alias("days"))


def boost(events: DataFrame, hits: DataFrame, least_sources: int = LEAST_SOURCES, strong_sources: int = STRONG_SOURCES, least_days: int = 2, ceiling: int = CEILING) -> DataFrame:
    """Events (seq, importance, who, sources) with ``trending`` (entity, sources, days), their best trend:
    of the first two names, most sources, the first of equals; importance rises, to ``ceiling`` at most."""
    good = event_trends(events, hits).where((F.col("sources") >= least_sources) & (F.col("days") >= least_days))
    best = good.groupBy("seq").agg(F.max_by(F.struct(F.col("name").alias("entity"), "sources", "days"), F.struct("sources", (-F.col("pos")).alias("p"))).alias("trending"))
    out = events.join(best, "seq", "left")
    bump = F.when(F.col("trending.sources") >= strong_sources, 2).otherwise(1)
    raised = F.greatest(F.col("importance"), F.least(F.col("importance") + bump, F.lit(ceiling)))
    return out.withColumn("importance", F.when(F.col("trending").isNull(), F.col("importance")).otherwise(raised))


def _bounded(entity: Column) -> Column:
    """The entity between characters other than a-z and 0-9, as a pattern."""
    return F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(entity, r"([.^$*+?{}\[\]\\|()\-])", r"\\$1"), F.lit("(?![a-z0-9])"))


def _pairs(text: Column) -> Column:
    """Neighbouring characters of a text, other than two of a-z, 0-9 and white space."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.filter(F.array_distinct(each), lambda p: ~p.rlike(r"^[a-z0-9\s]{2}$"))).otherwise(F.array().cast("array<string>"))


def history_matches(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, text_id) where a text holds the entity between characters other than a-z and 0-9, in any script.

    See ``history_told``.
    """
    return history_told(entities, texts, ["text_id"])


def history_told(entities: DataFrame, texts: DataFrame, told: list[str]) -> DataFrame:
    """(entity, *told), distinct: these columns of the texts (text_id, text) that hold an entity.

    Entities are lower-case. Texts are indexed by their ASCII words and by their pairs of
    neighbouring other characters; an entity is asked for under its longest word or, where it has
    none, its rarest pair, and the bounded pattern decides on what meets. An entity that is one
    ASCII word is held exactly where the word is, so no text travels for it, and what is told is
    made distinct before it is shuffled. Entities without a word or a pair (one character) are
    asked for under that character.
    """
    scratch = Scratch(texts.sparkSession, "history")
    longest = F.array_sort(F.transform(F.regexp_extract_all("entity", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    asked = scratch.save(entities.where("entity <> ''").select("entity").distinct().withColumn("word", F.get(longest, F.lit(0))["w"]), "asked")
    low = texts.select("text_id", F.lower("text").alias("text"))
    words = low.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    single = F.col("word") == F.col("entity")
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("entity")
    plain = texts.select(said, *told).distinct().join(asked.where(single).select("entity"), "entity")
    met = words.join(asked.where(F.col("word").isNotNull() & ~single), "word").select("entity", "text_id")
    bare = asked.where(F.col("word").isNull()).select("entity", F.explode(F.when(F.size(_pairs(F.col("entity"))) > 0, _pairs(F.col("entity"))).otherwise(F.array("entity"))).alias("key"))
    if bare.head(1):
        # Only keys that some entity has leave the texts; each entity is then asked for under the one that fewest texts have.
        keys = scratch.save(bare.select("key").distinct(), "keys")
        units = F.concat(_pairs(F.col("text")), F.array_distinct(F.filter(F.split("text", ""), lambda c: (c != "") & ~c.rlike(r"[a-z0-9\s]"))))
        held = scratch.save(low.select("text_id", F.explode(units).alias("key")).join(keys, "key", "left_semi"), "held")
        counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        rarest = bare.join(counts, "key", "left").groupBy("entity").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).select("entity", F.col("k.key").alias("key"))
        met = met.unionByName(held.join(rarest, "key").select("entity", "text_id"))
    held = met.join(low, "text_id").where(F.regexp_like("text", _bounded(F.col("entity")))).select("entity", "text_id")
    if told != ["text_id"]:
        held = held.join(texts.select(*{"text_id": 0, **dict.fromkeys(told)}), "text_id")
    return plain.unionByName(held.select("entity", *told)).distinct()


def hits_in_texts(current: DataFrame, history: DataFrame, today, recent_days: int = RECENT_DAYS, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """(entity, source, date) as ``recent_hits``, for the first two names of current events (seq, who), looked for in
    the texts of history (text_id, text, source, date)."""
    scratch = Scratch(history.sparkSession, "trending")
    day = F.lit(today).cast("date")
    past = history.where((F.col("date") >= F.date_sub(day, baseline_days)) & (F.col("date") < day))
    asked = scratch.save(named_entities(current).select("entity").distinct(), "asked")
    found = history_told(asked, past.select("text_id", "text", "source", "date"), ["source", "date"])
    return scratch.save(recent_hits(asked, scratch.save(found, "found"), today, recent_days, baseline_days), "hits")
