"""What a cluster needs to run this package's Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a Spark application.

    Executors share no folder with the driver; Spark serves the archive to them. Where the
    package is itself imported from an archive, that has been sent already.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sluice-"), "sluice.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("sluice", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
