"""Where lineage is cut.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``: it is shared, so the loss of an
executor costs nothing.  Only a session without that setting (a test, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the table; what follows reads it instead of recomputing."""
    spark = df.sparkSession
    path = written(spark, f"{folder(spark)}/weftline/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def written(spark: SparkSession, path: str) -> str:
    """Note a path of this process for ``clear``."""
    _written.append((spark, path))
    return path


def clear() -> None:
    """Delete every table that ``cut`` wrote in this process; results that still read them must be stored before."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; its folder is the owner's to remove
            pass


atexit.register(clear)
