"""Gapless numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import Scratch


def rank_in_group(df: DataFrame, group: list[str], spread: Column, order: list[Column], out: str, rows_per_part: int = 200_000, counts: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without holding a group in one task.

    A group is cut into sub-groups by ``spread`` (a hash of a row's own values); sub-groups are
    counted, their first numbers come from a running sum over the few sub-group counts, and rows
    are numbered inside their sub-group. Numbers are any order between sub-groups, ``order``
    inside one. ``df`` must be cheap to read twice (a written table). ``counts`` may bring
    ``group`` columns and ``_parts``; else every group is cut into as many sub-groups as the
    whole table needs. Null group values form a group; empty input gives an empty result.
    """
    if counts is None:
        total = df.count()
        df = df.withColumn("_sub", F.pmod(spread, F.lit(max(8, -(-total // rows_per_part)))))
    else:
        df = df.join(F.broadcast(counts.select(*group, "_parts")), group, "left").withColumn("_sub", F.pmod(spread, F.coalesce("_parts", F.lit(1)).cast("long"))).drop("_parts")
    sub = df.groupBy(*group, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.withColumn("_base", F.coalesce(F.sum("_n").over(running), F.lit(0)).cast("long")).drop("_n")
    inner = Window.partitionBy(*group, "_sub").orderBy(*order)
    numbered = df.withColumn("_k", F.row_number().over(inner) - 1)
    right = sub.select(*[F.col(c).alias(f"_r_{c}") for c in [*group, "_sub"]], "_base")
    cond = None
    for c in [*group, "_sub"]:
        here = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = here if cond is None else cond & here
    joined = numbered.join(right, cond, "left")
    return joined.withColumn(out, (F.col("_base") + F.col("_k")).cast("long")).drop("_sub", "_k", "_base", *[f"_r_{c}" for c in [*group, "_sub"]])


def number_in_order(df: DataFrame, order: list[Column], out: str, label: str = "numbering") -> DataFrame:
    """Number all rows 1, 2, 3, ... in a total order without a single-task window.

    Rows are range-partitioned and written once; a running sum over the partitions' counts, a row
    a partition, gives each its base, and rows are numbered inside their own partition.
    """
    scratch = Scratch(df.sparkSession, label)
    rows = scratch.save(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "rows")
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy().orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_pid").orderBy(*order)
    return rows.withColumn(out, F.row_number().over(own)).join(F.broadcast(base), "_pid").withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_pid", "_base")


def number_within(df: DataFrame, group: str, order: list[Column], out: str, held: str, label: str = "numbering") -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in order; ``held`` is how many the group has.

    Rows are range-partitioned by group and order, equal ones spread by a number of their own, so
    a group of any size is cut over as many partitions as it fills. ``group`` must not be null;
    empty input gives an empty result.
    """
    scratch = Scratch(df.sparkSession, label)
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(group), *order, F.col("_tie")).withColumn("_pid", F.spark_partition_id())
    rows = scratch.save(dealt, "rows")
    counts = rows.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(group)).alias(held))
    own = Window.partitionBy(group, "_pid").orderBy(*order, "_tie")
    numbered = rows.withColumn(out, F.row_number().over(own)).join(base, [group, "_pid"])
    return numbered.withColumn(out, (F.col(out) + F.col("_base") - 1).cast("long")).drop("_pid", "_base", "_tie")
