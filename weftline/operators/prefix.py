"""Running sums over an order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.scratch import cut


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str = "start", by: list[str] | None = None) -> DataFrame:
    """(*by, *order, value, name): what ``value`` adds up to before each row, within ``by``.

    Two phases: rows are range-partitioned by (by, order), each partition's total gives the next its start, and only inside
    a partition rows are summed in order.  ``order`` must be unique within ``by``, and ``by`` and ``order`` not null; a null
    value counts 0.
    """
    by = by or []
    keys = [*by, *order]
    held = cut(df.select(*keys, F.coalesce(value, F.lit(0)).cast("long").alias(value)).repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = held.groupBy(*by, "_p").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("_l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, [*by, "_p"]).select(*keys, value, (F.col("_s") + F.col("_l")).alias(name))


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """(*by, *order, name): the number of each row within ``by``, from 0."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), order, "_one", name, by).drop("_one")
