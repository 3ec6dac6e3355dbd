"""State: upserts with protected values, corpora, day bundles, fingerprints, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def archive_key(day: Column, ids: Column) -> Column:
    """``day|sorted upper-case ids``."""
    return F.concat_ws("|", day, F.array_join(F.array_sort(F.array_distinct(F.transform(ids, F.upper))), ","))


def upsert(
    old: DataFrame, new: DataFrame, key: str, keep_if_empty: tuple[str, ...] = (), marks: DataFrame | None = None, removed: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """``old`` with ``new`` merged in by key, columns in the order of ``old``.

    New values win, but an empty one of ``keep_if_empty`` and a column that ``marks`` (key,
    column) protects keep the old one. Keys of ``removed`` do not come back. ``order`` names a
    column of whole numbers that rows stand by: of equal keys the first counts in ``old`` and
    the last in ``new``, known rows keep their place and new ones follow, those of one key at
    its first. Without it the first by all columns counts in both.
    """
    columns = [c for c in old.columns if c not in (key, order)]
    struct = F.struct(*columns)

    def one(df: DataFrame, name: str, last: bool = False) -> DataFrame:
        if order is None:
            return df.groupBy(key).agg(F.min(struct).alias(name))
        pick = F.max_by if last else F.min_by
        return df.groupBy(key).agg(pick(struct, F.struct(order, struct)).alias(name), F.min(order).alias(f"{name}_at"))

    fresh = new if removed is None else new.join(removed.select(key).distinct(), key, "left_anti")
    merged = one(old, "o").join(one(fresh, "n", True), key, "full_outer")
    if marks is not None:
        merged = merged.join(marks.groupBy(key).agg(F.collect_set("column").alias("marked")), key, "left")
    guarded = lambda c: F.coalesce(F.array_contains("marked", c), F.lit(False)) if marks is not None else F.lit(False)

    def value(c: str) -> Column:
        empty = F.coalesce(F.col(f"n.{c}").cast("string"), F.lit("")) == ""
        keep = F.col("o").isNotNull() & ((empty if c in keep_if_empty else F.lit(False)) | guarded(c))
        return F.when(F.col("n").isNull() | keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    values = {c: value(c) for c in columns}
    if order is not None:
        merged = merged.crossJoin(F.broadcast(old.agg(F.coalesce(F.max(order), F.lit(0)).alias("top"))))  # one row
        values[order] = F.coalesce("o_at", F.col("top") + 1 + F.col("n_at")).cast(old.schema[order].dataType).alias(order)
    return merged.select(*(F.col(key) if c == key else values[c] for c in old.columns)) if order else merged.select(key, *values.values())


def merged_corpus(rows: DataFrame) -> DataFrame:
    """(key, text, sources) from (key, ord, text, source): the first text of each key and all its sources, sorted."""
    return rows.groupBy("key").agg(F.min(F.struct("ord", "text")).alias("first"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")).select("key", "first.text", "sources")


def day_bundles(rows: DataFrame, start: str, end: str, early_hour: int = 6, max_days: int = 14) -> DataFrame:
    """Rows once for each day of their window, at most ``max_days`` of them; a start before ``early_hour`` also counts for the day before."""
    first = F.when(F.hour(start) < early_hour, F.date_sub(F.to_date(start), 1)).otherwise(F.to_date(start))
    last = F.least(F.to_date(end), F.date_add(F.to_date(start), max_days - 1))
    return rows.withColumn("day", F.explode(F.sequence(first, F.greatest(last, first))))


def day_fingerprints(rows: DataFrame, day: str, key: str) -> DataFrame:
    """(day, fingerprint): sixteen hex digits of the day's sorted keys, through a digest of each bucket, so that no group holds a whole day."""
    bucketed = rows.select(day, F.pmod(F.xxhash64(key), F.lit(64)).alias("b"), F.col(key).cast("string").alias("k")).distinct()
    buckets = bucketed.groupBy(day, "b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("k")), "\n"), 256).alias("h"))
    return buckets.groupBy(day).agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256), 1, 16).alias("fingerprint"))


def to_evaluate(current: DataFrame, known: DataFrame, day: str) -> DataFrame:
    """Days whose fingerprint is new or has changed."""
    return current.join(known, [day, "fingerprint"], "left_anti")


def edited(rows: DataFrame, edits: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with hand-set values of one column, and the marks (key, column, original) that remember what stood there."""
    joined = rows.join(edits.select(key, F.col("value").alias("_value")), key, "left")
    changed = F.col("_value").isNotNull() & ~F.col("_value").eqNullSafe(F.col(column))
    marks = joined.where(changed).select(key, F.lit(column).alias("column"), F.col(column).alias("original"))
    return joined.withColumn(column, F.coalesce("_value", column)).select(*rows.columns), marks


def content_version(rows: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: count, sum and exclusive or of row hashes."""
    h = F.xxhash64(*rows.columns)
    found = rows.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first()
    return "-".join(str(x) for x in found)


def replace_if_unchanged(spark, path: str, rows: DataFrame, expected: str | None) -> str:
    """Writes ``rows`` as the next snapshot under ``path`` if the newest one still has the ``expected`` version; else raises.

    Snapshots are folders named by number; a reader takes the newest that is complete.
    """
    newest = newest_snapshot(spark, path)
    have = content_version(spark.read.parquet(newest)) if newest else None
    if have != expected:
        raise RuntimeError("the table has changed since it was read")
    number = int(newest.rsplit("=", 1)[1]) + 1 if newest else 1
    rows.write.parquet(f"{path}/snapshot={number:08d}")
    return content_version(rows)


def newest_snapshot(spark, path: str) -> str | None:
    """The newest complete snapshot under ``path``, looked up with Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return names[-1] if names else None
