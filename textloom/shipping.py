"""Makes this package importable by Python workers wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_textloom_shipped", False):
        return
    folder = tempfile.mkdtemp()  # of the driver; Spark serves the file from there until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "textloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    sc._textloom_shipped = True
