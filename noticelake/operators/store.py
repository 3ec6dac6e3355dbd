"""A store of several tables that change together: numbered manifests over Parquet folders.

A manifest names a folder for each table. It is published whole and only if no other has its
number, so of two writers that start from one version one wins and the other learns of it,
and a reader of a manifest sees all tables of one version. Data are written before, under
names of their own; a writer that dies leaves data that no manifest names, and nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import merge
from noticelake.operators.staging import written


class Conflict(RuntimeError):
    """What was read has changed since; nothing was written."""


class Version(NamedTuple):
    """``number`` is 0 before the first one."""

    number: int
    tables: dict[str, DataFrame]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path, path.getFileSystem(self._conf)

    def _newest(self) -> int:
        path, fs = self._at("manifests")
        if not fs.exists(path):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, number: int) -> dict[str, str]:
        if not number:
            return {}
        path, fs = self._at("manifests", f"{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, number: int | None = None) -> Version:
        """The newest version, or that of a number, with all its tables."""
        number = self._newest() if number is None else number
        return Version(number, {name: self.spark.read.parquet(f"{self.path}/data/{folder}") for name, folder in self._manifest(number).items()})

    def _publish(self, number: int, manifest: dict[str, str]) -> None:
        draft, fs = self._at("manifests", f"draft-{uuid.uuid4().hex}")
        path, _ = self._at("manifests", f"{number:012d}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # a rename would replace; a link to a name that is taken fails
                files, none = self._jvm.java.nio.file, self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
                of = lambda p: files.Paths.get(fs.makeQualified(p).toUri().getPath(), none)
                files.Files.createLink(of(path), of(draft))
                fs.delete(draft, False)
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, path, options)
        except Exception as e:
            fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise Conflict("another writer was first") from e
            raise

    def replace(self, seen: int, tables: dict[str, DataFrame]) -> int:
        """Writes the tables as version ``seen`` + 1, the others as they were in ``seen``; raises ``Conflict`` if there is a newer one."""
        if self._newest() != seen:
            raise Conflict("the store has changed since it was read")
        manifest = self._manifest(seen)
        for name, rows in tables.items():
            manifest[name] = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/data/{manifest[name]}")
        self._publish(seen + 1, manifest)
        return seen + 1

    def update(self, change: Callable[[Version], dict[str, DataFrame]], tries: int = 2) -> int:
        """``change`` makes new tables from a version; after a conflict it is asked again with the newest. Nothing is written if it returns none."""
        for left in range(tries - 1, -1, -1):
            version = self.read()
            tables = change(version)
            if not tables:
                return version.number
            try:
                return self.replace(version.number, tables)
            except Conflict:
                if not left:
                    raise
        raise ValueError("at least one try")

    def export(self, path: str, names: tuple[str, ...] | None = None) -> Version:
        """Copies tables of one version as CSV with a header, a folder each."""
        version = self.read()
        for name in names or version.tables:
            version.tables[name].write.option("header", True).csv(f"{path}/{name}")
        return version


def three_way(before: DataFrame, after: DataFrame, now: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): ``now`` with what changed from ``before`` to ``after``, and the keys at which that cannot be done.

    The three have the same columns and at most one row a key. A key that is not changed stays
    as it is now. A changed one must now stand as it did before, or already as it does after;
    a key that is neither is a conflict, and then nothing should be written.
    """
    values = [c for c in now.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(F.lit(True).alias("there"), *values).alias(name))
    both = side(before, "b").join(side(after, "a"), keys, "full_outer").join(side(now, "n"), keys, "full_outer")
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    settled = F.col("n").eqNullSafe(F.col("a"))
    conflict = changed & ~settled & ~F.col("n").eqNullSafe(F.col("b"))
    result = F.when(changed, F.col("a")).otherwise(F.col("n"))
    rows = both.withColumn("r", result).where("r is not null").select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in now.columns))
    return rows, both.where(conflict).select(*keys)


def write_differences(store: Store, seen: Version, after: dict[str, DataFrame], keys: dict[str, list[str]]) -> int:
    """Writes what ``after`` changes in the tables of ``seen`` into the newest version, whatever else has changed there since.

    Raises ``Conflict``, with nothing written, if a key that was changed has been changed by another.
    """

    def change(version: Version) -> dict[str, DataFrame]:
        out = {}
        for name, rows in after.items():
            empty = rows.limit(0)
            merged, conflicts = three_way(seen.tables.get(name, empty), rows, version.tables.get(name, empty), keys[name])
            if not conflicts.isEmpty():
                raise Conflict(f"rows of {name} have been changed by another")
            out[name] = merged
        return out

    return store.update(change, tries=5)


def update_archive(store: Store, rows: DataFrame, key: str = "key", keep_if_empty: tuple[str, ...] = ("Payload", "Trägersystem"), table: str = "archive", marks: str = "marks", removed: DataFrame | None = None) -> int:
    """Merges launches' rows into the archive of a store; the version's number, the same as before where nothing changes.

    Rows that are known are brought up to date in their place, new ones follow in the order of
    their ``position``; values set by hand (table ``marks``: key, column) stay, and so do
    payload and vehicle where the new row has none.
    """

    def change(version: Version) -> dict[str, DataFrame]:
        old = version.tables.get(table, rows.limit(0))
        new = written(merge.upsert(old, rows, key, keep_if_empty, version.tables.get(marks), removed, order="position"))
        return {} if table in version.tables and merge.content_version(new) == merge.content_version(old.select(*new.columns)) else {table: new}

    return store.update(change)
