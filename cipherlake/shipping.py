"""Makes the package importable on executors that don't have it installed."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of this package's modules to the session's Python files, once per application.

    Functions that run on executors refer to the package's modules by name. The zip is some 100 KB and goes through
    Spark's own file distribution.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_ROOT):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("cipherlake", os.path.relpath(path, _ROOT)))
    # Executors fetch it when they first run a task, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="cipherlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "cipherlake.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
