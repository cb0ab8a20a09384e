"""Gives the executors' Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application; nothing to do where PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="spark-cairnwork-")) / "cairnwork.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "cairnwork").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
