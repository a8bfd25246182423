"""The package's code on the executors, which run parts of it in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def _found_by_workers(spark: SparkSession) -> bool:
    """Whether workers of a local master find the package by themselves: by their path or the folder they run in."""
    root = PACKAGE.parent
    places = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    return spark.sparkContext.master.startswith("local") and any(Path(p).resolve() == root for p in places)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, unless their workers find it by themselves."""
    sc = spark.sparkContext
    name = f"{PACKAGE.name}-code.zip"
    if _found_by_workers(spark) or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="code-")) / name
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
