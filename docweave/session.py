"""Makes the package importable in Python workers that don't share the driver's import path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_docweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docweave-")) / "docweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"docweave/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._docweave_shipped = True
