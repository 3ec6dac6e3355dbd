"""Aggregations and windows over notices and launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.operators.staging import written

#: Confidence levels from best to worst.
LEVELS = ("HIGH", "MEDIUM", "LOW")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def at_least(level: Column, wanted: str = "MEDIUM") -> Column:
    """Whether a level is ``wanted`` or better; an unknown wish counts as MEDIUM."""
    return level_rank(level) <= (LEVELS.index(wanted) if wanted in LEVELS else 1) + 1


def group_summary(rows: DataFrame, group: str) -> DataFrame:
    """From (group, valid_from, valid_to, level, override, source): the window, the best level, whether any row is an override, sorted sources."""
    best = F.element_at(F.array(*map(F.lit, LEVELS)), F.min(level_rank(F.col("level"))).cast("int"))
    return rows.groupBy(group).agg(
        F.min("valid_from").alias("valid_from"),
        F.max("valid_to").alias("valid_to"),
        best.alias("level"),
        F.bool_or("override").alias("override"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.count("*").alias("n"),
    )


def common_or_all(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(group, values): what all members with any value have in common, or else all values; rows are (group, member, value)."""
    filled = rows.where(F.col(value).isNotNull())
    per_value = filled.groupBy(group, value).agg(F.countDistinct(member).alias("n"))
    members = filled.groupBy(group).agg(F.countDistinct(member).alias("m"))
    joined = per_value.join(members, group)
    in_all = F.sort_array(F.collect_set(F.when(F.col("n") == F.col("m"), F.col(value))))
    every = F.sort_array(F.collect_set(value))
    return joined.groupBy(group).agg(F.when(F.size(in_all) > 0, in_all).otherwise(every).alias("values"))


def one_or_mixed(rows: DataFrame, group: str, value: str, out: str = "shared") -> DataFrame:
    """Each row with its group's only value, '' without any; with several ``mixed`` is true and rows keep their own."""
    values = rows.groupBy(group).agg(F.min(F.nullif(F.col(value), F.lit(""))).alias("_lo"), F.max(F.nullif(F.col(value), F.lit(""))).alias("_hi"))
    own = F.coalesce(F.col(value), F.lit(""))
    mixed = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))
    return rows.join(values, group).withColumn(out, F.when(mixed, own).otherwise(F.coalesce("_lo", F.lit("")))).withColumn("mixed", mixed).drop("_lo", "_hi")


def run_statistics(rows: DataFrame) -> DataFrame:
    """One row of counts from (status, level, has_trigger, launch, override)."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("has_trigger")).alias("no_trigger"),
        F.count_if("has_trigger").alias("events"),
        F.count_if(F.col("status") == "OK").alias("ok"),
        F.count_if(F.col("status") == "REVIEW").alias("review"),
        F.count_if(F.col("level") == "HIGH").alias("high_confidence"),
        F.count_if("override").alias("confirmed"),
        F.countDistinct("launch").alias("launches"),
    )


def site_history(rows: DataFrame, vehicle: str, site: str) -> DataFrame:
    """(vehicle, site, n, rank): how often a vehicle flew from a site, most first, then by code."""
    counted = rows.groupBy(vehicle, site).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(vehicle).orderBy(F.desc("n"), site)))


def first_of_each(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """Rows that come first under ``order`` among those with equal keys; nulls are equal."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n")


def numbered_launches(groups: DataFrame, order: list[str], prefix: str = "START") -> DataFrame:
    """Groups with a running label PREFIX-NN.

    Numbers run over all groups, so ranges are written and counted first and each range is
    numbered from what stands before it: no task holds more than a range, and both reads
    see the same ranges.
    """
    ranged = written(groups.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    placed = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    label = F.format_string(f"{prefix}-%02d", F.col("_row") + F.col("_before"))
    return placed.join(before, "_part").withColumn("label", label).drop("_part", "_row", "_before")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of a report."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
