"""Report model and index pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.numbering import number_in_order


def category_order(categories: list[str]) -> Column:
    """Fixed places; unknown ones last."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.coalesce(F.col("category"), F.lit("")))
    return F.when(place > 0, place).otherwise(F.lit(len(categories) + 1)).cast("int")


def report_pages(events: DataFrame, categories: list[str], per_page: int = 6) -> DataFrame:
    """Each event's running number over all groups, its place in its group, and its index page; a group starts a new page."""
    rows = events.withColumn("cat_ord", category_order(categories))
    order = [F.col("cat_ord"), F.col("importance").desc(), F.col("mention_count").desc(), F.col("seq")]
    numbered = number_in_order(rows, order, "n", "report")
    groups = numbered.groupBy("cat_ord").agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("size"))
    pages = F.ceil(F.col("size") / per_page)
    before = Window.orderBy("cat_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row a category
    groups = groups.withColumn("first_page", F.coalesce(F.sum(pages).over(before), F.lit(0))).drop("size")
    out = numbered.join(F.broadcast(groups), "cat_ord")
    return out.withColumn("rn", (F.col("n") - F.col("first_n") + 1).cast("long")).withColumn("page", (F.col("first_page") + F.floor((F.col("rn") - 1) / per_page) + 1).cast("long")).drop("first_n", "first_page")


def facet_tabs(events: DataFrame, active: str) -> DataFrame:
    """Categories that have events, with counts; an empty active one falls back to all."""
    counts = events.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    every = events.agg(F.lit("all").alias("category"), F.count(F.lit(1)).alias("n"))
    tabs = every.unionByName(counts)
    known = F.max(F.col("category") == active).over(Window.partitionBy())
    return tabs.withColumn("active", F.when(known, F.col("category") == active).otherwise(F.col("category") == "all"))


SENTENCE_ENDS = "。！？；!?;"


def split_paragraph(text: Column | str, capacity: int) -> Column:
    """The parts of a text, of at most ``capacity`` characters each: cut after the last sentence's end in reach where
    that lies past 45 % of it, else at the capacity. Null and empty texts have no parts."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    least = int(0.45 * capacity) + 1  # no part but the last is shorter
    start = F.struct(F.array().cast("array<string>").alias("parts"), text.alias("rest"))

    def take(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        stop = F.length(F.regexp_extract(F.substring(rest, 1, capacity), f"(?s)^.*[{SENTENCE_ENDS}]", 0))
        cut = F.when(F.length(rest) <= capacity, F.length(rest)).when(stop > F.lit(0.45 * capacity), stop).otherwise(F.lit(capacity))
        parts = F.when(rest == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.substring(rest, F.lit(1), cut))))
        return F.struct(parts.alias("parts"), F.substring(rest, cut + 1, F.length(rest)).alias("rest"))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(text) / least).cast("int")), start, take, lambda acc: acc["parts"])
