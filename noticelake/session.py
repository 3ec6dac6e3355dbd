"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application. It is not needed where it is installed on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="noticelake-package-")
    archive = shutil.make_archive(os.path.join(folder, "noticelake_package"), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
