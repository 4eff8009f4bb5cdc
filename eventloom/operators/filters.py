"""Row predicates of the daily run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import dicts, text


def _escape(word: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()\-])", r"\\\1", word)


def keyword_patterns(keywords: list[str]) -> tuple[str | None, str | None]:
    """(case-sensitive pattern of words up to three letters, case-free pattern of longer ones)."""
    short = [_escape(k) for k in keywords if len(k) <= 3]
    long = [_escape(k) for k in keywords if len(k) > 3]
    return f"(?<![A-Za-z])(?:{'|'.join(short)})(?![A-Za-z])" if short else None, f"(?iu)(?:{'|'.join(long)})" if long else None


def has_keyword(content: Column, keywords: list[str]) -> Column:
    tests = [content.rlike(p) for p in keyword_patterns(keywords) if p]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def has_noise(content: Column, noise: list[str] | None = None) -> Column:
    words = dicts.NOISE_WORDS if noise is None else noise
    return content.rlike("|".join(map(_escape, words))) if words else F.lit(False)


def prefilter_flag(items: DataFrame, ai: list[str], security: list[str], noise: list[str] | None = None) -> Column:
    """Whether an item passes: no noise, and a native source, a security topic or a keyword of the caller's lists."""
    content = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    col = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    native = F.coalesce(col("source_kind").isin(dicts.NATIVE_KINDS), F.lit(False)) | F.coalesce(col("source_name").isin(dicts.NATIVE_SOURCES), F.lit(False)) | F.coalesce(col("source_topic") == "security", F.lit(False))
    words = ai + security
    return ~has_noise(content, noise) & (native | has_keyword(content, words))


def prefilter(items: DataFrame, **lists) -> DataFrame:
    return items.where(prefilter_flag(items, **lists))


def prefilter_counts(items: DataFrame, **lists) -> DataFrame:
    """In, out and whole percent by source."""
    flag = prefilter_flag(items, **lists)
    out = items.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_in"), F.count_if(flag).alias("n_out"))
    return out.withColumn("pct", F.expr("n_out * 100 div n_in"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-empty key; partial minima before the shuffle, so a hot key costs one row a task."""
    kept = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    names = df.columns
    best = kept.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(order)).alias("_row"))
    return best.select("_row.*")


def limit_then_filter(items: DataFrame, limit: int, cutoff: Column | None, per_source: dict[str, int] | None = None, undated_ok: bool = True) -> DataFrame:
    """The first entries of each source come before any filter; then blank and stale ones go."""
    cap = F.lit(limit)
    for name, n in (per_source or {}).items():
        cap = F.when(F.col("source_name") == name, n).otherwise(cap)
    most = max([limit, *(per_source or {}).values()])
    # The literal bound cuts each task's rows before the shuffle; then the source's own cap decides.
    numbered = items.withColumn("_k", F.row_number().over(Window.partitionBy("source_name").orderBy("seq"))).where(F.col("_k") <= most)
    ranked = numbered.where(F.col("_k") <= cap).drop("_k")
    ranked = ranked.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    if cutoff is None:
        return ranked
    fresh = F.col("published") >= cutoff
    return ranked.where(F.coalesce(fresh, F.lit(undated_ok)))


def quality_reason(today: Column, days_back: int, least_importance: int = 4, least_summary: int = 40) -> Column:
    """Why an event is dropped, in the order of the checks; null if it stays."""
    when = text.fuzzy_date("when")
    return F.when(F.coalesce("importance", F.lit(0)) < least_importance, "importance").when(F.length(F.coalesce("summary", F.lit(""))) < least_summary, "summary").when(when < F.date_sub(today, days_back), "stale")


def interests(df: DataFrame, selected: list[str], known: list[str]) -> DataFrame:
    """Rows of the selected categories; unknown ones stay, no selection keeps all."""
    return df if not selected else df.where(F.col("category").isin(selected) | ~F.coalesce(F.col("category").isin(known), F.lit(False)))


def enrich_with_dek(items: DataFrame, deks: DataFrame) -> DataFrame:
    """Media items with their page's description before the summary, unless it is short or there already."""
    joined = items.join(deks.select(F.col("url").alias("_u"), F.col("dek").alias("_dek")), F.col("url") == F.col("_u"), "left")
    old = F.coalesce("summary", F.lit(""))
    use = (F.col("source_kind") == "media") & (F.length("_dek") >= 30) & ~F.contains(old, F.substring("_dek", 1, 60))
    return joined.withColumn("summary", F.when(F.coalesce(use, F.lit(False)), F.substring(F.concat_ws(" ", "_dek", old), 1, 1200)).otherwise(F.col("summary"))).drop("_u", "_dek")


def needs_tags(redo: bool = False) -> Column:
    by = F.coalesce(F.col("tags_by"), F.lit("none"))
    return (by != "extract") & (F.lit(redo) | ~by.startswith("backfill"))


def long_enough(least: int = 40) -> Column:
    """Whether the trimmed summary has ``least`` characters."""
    return F.length(F.trim(F.coalesce("summary", F.lit("")))) >= least


def has_opensource(sources: Column) -> Column:
    """Whether any source is of the open-source kind."""
    return F.coalesce(F.exists(sources, lambda s: F.coalesce(s["is_opensource"], F.lit(False))), F.lit(False))


def needs_text() -> Column:
    """Whether the long text must be written again."""
    return ~text.good_fulltext("full_content", "summary")


def needs_cover(force: bool = False, kinds: tuple[str, ...] = ("remote", "local")) -> Column:
    """Whether a cover is missing: not of ``kinds``, without an address, or forced."""
    have = F.coalesce(F.col("cover_image.kind").isin(*kinds) & (F.coalesce("cover_image.url", F.lit("")) != ""), F.lit(False))
    return F.lit(force) | ~have
