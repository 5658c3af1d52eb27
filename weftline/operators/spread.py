"""Work for every core, also where the input comes in a few pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a step that costs much more than moving its rows: repartitioned if it has fewer partitions than there
    are cores, which only small inputs have; a large scan stays as it is.

    For scans and what is narrow above them: to count the partitions behind a shuffle would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` in at most ``per_core`` partitions a core, merged without a shuffle: for steps of which every task hands on a
    summary whose size does not depend on its rows.  For scans and what is narrow above them."""
    most = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df
