"""Helpers that several operators share: input tables, scratch folder, names."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.session import ship_package

#: Columns of ``documents``; pipeline stages return these and nothing else.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def _own_dir(application: str) -> str:
    """One temporary folder for each application; a running session takes no new value of the setting."""
    return tempfile.mkdtemp(prefix="noticelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, with its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/noticelake/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """A table of ids in an eighth of the shuffle's partitions, twelve at least: narrow rows make small files otherwise."""
    return df.coalesce(max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_key(row_id: Column, text: Column) -> Column:
    """Sixteen bytes that rows of equal id and text share, and no others but by a chance of 2^-128 a pair."""
    half = lambda i: F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(i), row_id, text)), 16, "0"))
    return F.concat(half(1), half(2))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))
