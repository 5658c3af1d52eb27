"""A session with the settings the operators are written for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, so that they can import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="weftline-code-")  # the driver serves it from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "weftline-package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(at, f)
                        z.write(full, os.path.join("weftline", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark

#: Settings that change results or plans; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """Get or make a session; ``settings`` use ``__`` for the dots of Spark's names."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
