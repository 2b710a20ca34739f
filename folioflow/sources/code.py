"""Ship this package to executors, so that Arrow functions can import it there."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the session's context, once.

    The driver serves the file itself; executors need no shared folder for it.
    """
    context = spark.sparkContext
    if getattr(context, "_folioflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="folioflow-"), "folioflow.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    context.addPyFile(path)
    context._folioflow_shipped = True
