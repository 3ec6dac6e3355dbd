"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.streaming.incremental import shared_folder


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: worked out once, and what is read twice is the same twice.

    Joins with the table shuffle: Spark takes the size of its files for that of its rows, but
    encoded columns are many times smaller than their rows, so a table of millions of rows
    would be gathered in the driver to be broadcast.
    """
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).hint("merge")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over all cores, evenly or by keys, for work that costs much a row: a small file of many rows is read by few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column more that is worked out once: filters on it are not moved before ``spread`` with a copy of it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
