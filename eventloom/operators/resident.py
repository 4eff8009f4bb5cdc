"""Wide tables that stay where they were read, while narrow ones are brought to them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import Scratch

MOST_HOMES = 50_000  # Spark allows 100,000 buckets; partitions beyond this share homes


@contextmanager
def _subset_of_keys(spark: SparkSession):
    """Lets a table that is bucketed by one of the join's keys stay in place."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Resident:
    """Rows written once to the shared folder, each task's to a bucket of its own, with ``row``, a number of their own, and ``home``.

    No row is shuffled to write the table, and a join by (home, row) shuffles only the other
    side, at any size. ``home`` is chosen so that Spark's hash of it names the bucket of the
    partition that the row was read in. An empty table gives an empty table.
    """

    def __init__(self, df: DataFrame, scratch: Scratch, name: str):
        self.spark = df.sparkSession
        self.homes = max(1, min(MOST_HOMES, df.rdd.getNumPartitions()))
        # The least number whose hash falls on each bucket; 40 tries a bucket leave out one in 2 * 10**17.
        numbers = self.spark.range(40 * self.homes + 64).select(F.col("id").alias("home"), F.pmod(F.hash("id"), F.lit(self.homes)).cast("long").alias("_slot"))
        self._map = scratch.save(numbers.groupBy("_slot").agg(F.min("home").alias("home")).coalesce(1), f"{name}-homes")
        self.name = f"resident_{uuid.uuid4().hex[:16]}"
        placed = self.at_home(df.withColumn("row", F.monotonically_increasing_id()))
        placed.write.bucketBy(self.homes, "home").format("parquet").option("compression", "zstd").option("path", f"{scratch.base}/{name}").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def at_home(self, rows: DataFrame, row: str = "row") -> DataFrame:
        """``rows`` with the home of each number; the map has a row a partition."""
        slot: Column = F.pmod(F.shiftright(F.col(row), 33), F.lit(self.homes).cast("long"))
        return rows.withColumn("_slot", slot).join(F.broadcast(self._map), "_slot", "left").drop("_slot").withColumn("home", F.coalesce("home", F.lit(0)))

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """The table with ``rows`` by ``row``, one of each number at most; give it to ``save``.

        ``rows`` should be a written table: one that is dealt by ``row`` already, as a grouping
        leaves it, would have this table follow its partitions.
        """
        return self.table().join(self.at_home(rows).hint("shuffle_hash"), ["home", "row"], how)

    def save(self, df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """What is made of a join, written in the joined table's partitions."""
        with _subset_of_keys(self.spark):
            return scratch.save(df, name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
