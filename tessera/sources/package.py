"""Makes the package importable in Python workers that do not share the driver's folders."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package once per application, unless PYTHONPATH or the working folder already lead to it."""
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if ROOT in known or Path.cwd().resolve() == ROOT or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="tessera-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", ROOT, "tessera"))
    _SHIPPED.add(app)
