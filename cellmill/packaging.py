"""Sends this package to the executors, which need not see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_cellmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="cellmill-")) / "cellmill.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(to))
    context._cellmill_shipped = True
