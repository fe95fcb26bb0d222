"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context.

    Arrow batches of Spark's default size get smaller ones: rows here are whole texts, and Python workers should stay small.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    if context in _shipped:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="vqspark-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context)
