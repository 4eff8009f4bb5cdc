"""Connected components by alternating stars, a bounded number of shuffles for each halving of depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.skew import join_facts
from eventloom.session import Scratch


def _normal(edges: DataFrame) -> DataFrame:
    """Edges as (a, b) with a > b, once each."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (two columns of one orderable type): the least id reachable.

    Large-star links every larger neighbour of a node to its least neighbour, small-star links
    the smaller ones; edges end as stars. Nodes of many edges are met by broadcast, a thousand
    at most, so that no hub piles up in a task. Each round is written to the shared folder, so that
    lineage stays short; the loop ends when a round changes nothing. Self-loops and repeated
    edges are harmless, nulls are ignored, and no edges give no rows. Nodes without a partner
    (self-loops only) are components of their own.
    """
    scratch = Scratch(edges.sparkSession, label)
    first, second = edges.columns[:2]
    both = edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    given = scratch.save(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
    now = scratch.save(given.where(F.col("a") != F.col("b")), "round0")
    before, edges_now = None, now.count()
    for k in range(1, max_rounds + 1):
        sides = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        met = join_facts(sides, least, "a", "n", "inner", total=2 * edges_now)
        large = _normal(met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = scratch.save(large, f"large{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_facts(large, low, "a", "n", "inner", total=edges_now).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _normal(small.union(low.select("a", F.col("m").alias("b"))))
        now = scratch.save(small, f"round{k}")
        scratch.drop(f"round{k - 1}", f"large{k}")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20))).alias("s")).first()
        if state == before:
            break
        before, edges_now = state, state["n"]
    else:
        raise RuntimeError("components did not settle")
    alone = given.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    heads = now.select(F.col("b").alias("id")).union(alone).distinct().select("id", F.col("id").alias("component"))
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(heads.join(found.select("id"), "id", "left_anti"))
