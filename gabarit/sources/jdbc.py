"""The restriction store in a database, read in partitions. A driver for the database must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_store(spark: SparkSession, url: str, name: str = "restrictions", partitions: int = 5, column: str | None = None, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """The table `name`; with a numeric column and its bounds by as many connections as partitions, else by one."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()
