"""Scores, quotas and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import dicts, text
from eventloom.operators.skew import join_facts

METRICS = ("importance", "mention", "diversity", "recency", "entity", "taiwan", "opensource", "depth")


def totals(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` beside one row of aggregates: a broadcast of exactly one row, not a window over everything."""
    one = df.agg(*[c.alias(n) for n, c in columns.items()])
    return df.join(F.broadcast(one), F.lit(True), "left")


def with_metric_facts(events: DataFrame) -> DataFrame:
    """Events with what the metrics read: distinct source names and kinds, the widest entity, region and open-source scores.

    ``sources`` and ``who`` give them; an entity counts the events that name it, once each.
    """
    src = F.coalesce("sources", F.slice(F.array(F.lit(None).cast(events.schema["sources"].dataType.elementType)), 1, 0))
    distinct = lambda field: F.size(F.array_distinct(F.filter(F.transform(src, lambda s: s[field]), lambda x: F.coalesce(x, F.lit("")) != "")))
    keyed = events.select("seq", F.explode(F.array_distinct(F.transform(F.coalesce("who", F.array().cast("array<string>")), text.entity_key))).alias("key"))
    counts = keyed.where(F.col("key") != "").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    widest = join_facts(keyed, counts, "key", "n", "inner").groupBy("seq").agg(F.max("n").alias("entity_count"))
    local = F.exists(src, lambda s: F.coalesce(s["source_region"] == "TW", F.lit(False)))
    said = F.concat(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).rlike("台灣|臺灣")
    out = events.join(widest, "seq", "left")
    return out.withColumns({"n_names": distinct("source_name"), "n_kinds": distinct("source_kind"), "entity_count": F.coalesce("entity_count", F.lit(0)), "taiwan": F.when(local, 1.0).when(said, 0.6).otherwise(0.0), "os_raw": text.opensource_raw("sources")})


def raw_metrics(df: DataFrame) -> DataFrame:
    """Columns m_<metric> from what the table has: importance, mention_count, date, and optionally the rest."""
    has = df.columns
    col = lambda c, d: F.col(c) if c in has else d
    ends = totals(df, {"_new": F.max("date"), "_old": F.min("date")})
    span = F.greatest(F.lit(1), F.datediff("_new", "_old"))
    out = ends.withColumns({
        "m_importance": F.coalesce(F.col("importance").cast("double"), F.lit(0.0)),
        "m_mention": F.log2(1 + F.coalesce(F.nullif(F.col("mention_count"), F.lit(0)), F.lit(1)).cast("double")),
        "m_diversity": col("n_names", F.lit(0)) + 0.5 * col("n_kinds", F.lit(0)),
        "m_recency": F.coalesce(F.greatest(F.lit(0.0), 1 - F.datediff("_new", "date") / span), F.lit(0.0)),
        "m_entity": col("entity_count", F.lit(0)).cast("double"),
        "m_taiwan": col("taiwan", F.lit(0.0)).cast("double"),
        "m_opensource": col("os_raw", F.lit(0.0)).cast("double"),
        "m_depth": F.least(F.lit(1.0), F.length(F.coalesce(col("full_content", F.lit("")), F.lit(""))) / 1200),
    })
    return out.drop("_new", "_old")


def score(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Each chosen metric over its maximum in the pool (p_<metric>), and their mean as ``total``."""
    chosen = metrics or ["importance", "mention"]
    raw = totals(raw_metrics(df), {f"_x_{m}": F.greatest(F.lit(0.0), F.max(f"m_{m}")) for m in chosen})
    parts = {f"p_{m}": F.when(F.col(f"_x_{m}") > 0, F.col(f"m_{m}") / F.col(f"_x_{m}")).otherwise(F.lit(0.0)) for m in chosen}
    out = raw.withColumns(parts).drop(*[f"_x_{m}" for m in chosen])
    return out.withColumn("total", sum((F.col(f"p_{m}") for m in chosen), F.lit(0.0)) / len(chosen))


def order_by_rank(*first: Column) -> list[Column]:
    return [*first, F.col("importance").desc(), F.col("mention_count").desc(), F.col("seq")]


def quota_top(df: DataFrame, n: int, quota: int | None = None, category: str = dicts.QUOTA_CATEGORY, order: list[Column] | None = None) -> DataFrame:
    """The first n in order, at most ``quota`` of one category; what overflows only fills up. ``pick`` counts from 1.

    Only the first n of either side can be picked, so two bounded top-n cuts come before the
    ranking window, which then sees 2n rows.
    """
    quota = max(1, (2 * n + 3) // 6) if quota is None else quota  # n/3, halves up
    order = order or order_by_rank()
    capped = df.where(F.col("category") == category).orderBy(*order).limit(n)
    free = df.where((F.col("category") != category) | F.col("category").isNull()).orderBy(*order).limit(n)
    own = capped.withColumn("_over", (F.row_number().over(Window.orderBy(*order)) > quota).cast("int"))
    both = own.unionByName(free.withColumn("_over", F.lit(0)))
    ranked = both.withColumn("pick", F.row_number().over(Window.orderBy("_over", *order)))
    return ranked.where(F.col("pick") <= n).drop("_over")


def top_per_category(df: DataFrame, n: int = 25, order: list[Column] | None = None) -> DataFrame:
    """The first n of each category, ``rn`` from 1. Spark cuts each task's rows to n before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(*(order or order_by_rank())))).where(F.col("rn") <= n)


def ranked_picks(df: DataFrame, n: int = 6, metrics: list[str] | None = None, category: str = dicts.QUOTA_CATEGORY) -> DataFrame:
    """Scored, ordered and quota-limited; rows without a score only if no row has one."""
    scored = totals(score(df, metrics), {"_best": F.max("total")})
    pool = scored.where((F.col("total") > 0) | (F.col("_best") <= 0)).drop("_best")
    return quota_top(pool, n, category=category, order=order_by_rank(F.col("total").desc()))


def promote_lead(picks: DataFrame, has_cover: Column) -> DataFrame:
    """The first pick with a cover moves to the front; ``pick`` is renumbered. Picks are few."""
    first = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = picks.withColumn("_c", has_cover).withColumn("_lead", F.min(F.when(F.col("_c"), F.col("pick"))).over(first))
    return marked.withColumn("pick", F.row_number().over(Window.orderBy(F.when(F.col("pick") == F.col("_lead"), 0).otherwise(1), "pick"))).drop("_c", "_lead")


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """One page of an ordered list, the number clamped to what exists."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def in_dictionary_order(df: DataFrame, categories: list[str]) -> DataFrame:
    """Ranked rows (rn) one category after another in the dictionary's order, unknown ones last; ``place`` counts from 1.

    The rows are those of a cut, at most some for each category.
    """
    at = F.array_position(F.array(*[F.lit(c) for c in categories]), F.coalesce("category", F.lit("")))
    order = F.when(at > 0, at).otherwise(len(categories) + 1)
    return df.withColumn("place", F.row_number().over(Window.orderBy(order, F.coalesce("category", F.lit("")), "rn")))


def pager(total: int, number: int, size: int, width: int = 5) -> dict:
    """Pages, the clamped page and the run of page numbers around it that the pager shows."""
    pages = max(1, -(-total // size))
    now = min(max(1, number), pages)
    first = max(1, min(now - width // 2, pages - width + 1))
    return {"pages": pages, "page": now, "shown": list(range(first, min(pages, first + width - 1) + 1))}


def kept_per_category(df: DataFrame, n: int = 20, top: int = 3) -> DataFrame:
    """The first n of each category by importance; ``is_top`` marks the first few of all that are kept."""
    kept = top_per_category(df, n, [F.col("importance").desc(), F.col("seq")])
    first = kept.orderBy(F.col("importance").desc(), "seq").limit(top).select("seq", F.lit(True).alias("_top"))
    return kept.join(F.broadcast(first), "seq", "left").withColumn("is_top", F.coalesce("_top", F.lit(False))).drop("_top")


def work_queue(df: DataFrame, per_day: int, most: int) -> DataFrame:
    """Jobs (date, seq, importance, mention_count): the first of each day, days in order, then the first ``most`` of all; 0 sets no bound."""
    order = [F.col("importance").desc(), F.col("mention_count").desc(), F.col("seq")]
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy("date").orderBy(*order)))
    ranked = ranked.where(F.col("rn") <= per_day) if per_day else ranked
    return ranked.orderBy("date", "rn").limit(most) if most else ranked


def affordable(quota: int = 10_000, kept_back: int = 6_000, price: int = 83) -> int:
    """How many jobs a quota pays for, a part of it kept back."""
    return max(0, (quota - kept_back) // price)
