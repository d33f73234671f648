"""Brings this package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_DONE: set[str] = set()


def provide(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless PYTHONPATH already leads workers to it."""
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or context.applicationId in _DONE:
        return
    path = Path(tempfile.mkdtemp(prefix="vicinal-")) / "vicinal_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((ROOT / "vicinal").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
    _DONE.add(context.applicationId)
