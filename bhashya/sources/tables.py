"""Parquet tables of a folder, read so that a small one keeps all cores busy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Below this many bytes a table isn't worth dealing out.
LEAST = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals out a table that has fewer splits than the session has cores.

    A file of one row group is one task, whatever work its rows make. A large table has
    splits enough and is left alone: nothing is ever shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.rdd().getNumPartitions()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if splits < cores and size > LEAST else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
