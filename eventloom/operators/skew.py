"""Joins that a hot key cannot pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "left", parts: int = 1000, total: int | None = None) -> DataFrame:
    """``rows`` with one row of ``facts`` by ``key``; ``facts[count]`` is how many rows hold the key.

    Keys that hold more than one in ``parts`` of all counted rows, at most ``parts`` of them, are
    broadcast, so their rows stay where they are; the others are joined by a shuffle. ``rows``
    should be cheap to read twice; null keys match nothing. ``total`` spares the sum of the
    counts where it is known.
    """
    total = total if total is not None else facts.agg(F.sum(count).alias("n")).first()["n"] or 0
    least = max(total / parts, 1000)
    hot = F.broadcast(facts.where(F.col(count) > least))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(count) <= least), key, how)
    return rows.join(hot, key).unionByName(rest)
