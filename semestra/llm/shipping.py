"""Hand the package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import semestra

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once per
    application: Spark serves them to every executor."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(semestra.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="semestra-src-")) / "semestra_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
