"""The incremental parts of the engine as Structured Streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="noticelake-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream with the schema that it has now."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a source of files takes a single file only as a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there: run to its end, written as Parquet and read back."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:  # whole results replace each other, so the last batch counts
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    query = writer.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def corpus_stream(notices: DataFrame, keys: list[str], time: str, delay: str = "14 days") -> DataFrame:
    """The first notice of each key; state is kept for ``delay`` after it."""
    return notices.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bundle_stream(notices: DataFrame, time: str, delay: str = "6 hours") -> DataFrame:
    """Notices a day of their start, late ones for ``delay``; a start before six also counts for the day before."""
    days = F.array_distinct(F.array(F.to_date(F.col(time) - F.expr("INTERVAL 6 HOURS")), F.to_date(time)))
    bundled = notices.withWatermark(time, delay).withColumn("day", F.explode(days))
    return bundled.groupBy("day").agg(F.count("*").alias("n"))


def cluster_stream(notices: DataFrame, part: str, time: str, order: str, gap: int = 1800, span: int = 5400) -> DataFrame:
    """(order, part, cluster): launches as sessions with a largest gap and a largest span; state is a cluster's first and last time.

    Batches come in the order of time, as a catalogue of days does; within one, rows are sorted.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "o"])
        clusters = []
        for t in rows["t"]:
            if n == 0 or t - last > gap or t - first > span:
                n, first = n + 1, t
            last = t
            clusters.append(n)
        state.update((int(first), int(last), int(n)))
        yield pd.DataFrame({order: rows["o"].to_numpy(), part: key[0], "cluster": clusters})

    slim = notices.select(F.col(part).cast("long").alias(part), F.col(time).cast("long").alias("t"), F.col(order).cast("long").alias("o"))
    return slim.groupBy(part).applyInPandasWithState(fold, f"{order} long, {part} long, cluster int", "first long, last long, n int", "append", GroupStateTimeout.NoTimeout)
