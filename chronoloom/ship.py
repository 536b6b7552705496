"""Sends this package to the executors, so that tasks can import it on every machine."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: Spark's file server hands the package's sources to each executor, also to ones that start later.

    Nothing is compiled or written beside the sources: an installed package may be read-only.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "chronoloom.zip")
        home = os.path.dirname(os.path.abspath(__file__))
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(home):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
