"""Rows of a source on their way in: sharding, resuming, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.prefix import ordinals, prefix_sum
from weftline.scratch import cut


def shard(numbered: DataFrame, ordinal: str, parts: int, index: int, skip: int = 0) -> DataFrame:
    """Rows whose number modulo ``parts`` is ``index``, the first ``skip`` of them left out; sharding comes first."""
    if not 0 <= index < parts:
        raise ValueError("index must be in [0, parts)")
    own = F.col(ordinal)
    return numbered.where((F.pmod(own, F.lit(parts)) == index) & (F.floor(own / parts) >= skip))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with ordinal: each row's number within ``by``, from 0."""
    keys = [*(by or []), *order]
    return df.join(ordinals(df, order, "ordinal", by), keys)


def within_budget(df: DataFrame, order: list[str], estimate: Column, budget: Column, by: list[str]) -> DataFrame:
    """Rows of each ``by`` while what came before is under the budget: the row that crosses it is the last kept.

    ``budget`` may use the columns of ``df``; null is no limit; the first row that is over its budget ends its group.  Only
    keys and estimates are summed: where each group ends, one row a group, is then joined to ``df``, which stays where it is
    if Spark finds those rows few.
    """
    keys = [*by, *order]
    narrow = cut(df.select(*keys, estimate.cast("long").alias("_estimate"), budget.cast("double").alias("_most")), "estimates")
    before = prefix_sum(narrow.select(*keys, "_estimate"), order, "_estimate", "_before", by).drop("_estimate")
    over = narrow.where("_most is not null").join(before, keys).where(F.col("_before") >= F.col("_most"))
    ends = cut(over.groupBy(*by).agg(F.min(F.struct(*order)).alias("_end")), "ends")
    return df.join(ends, by, "left").where(F.col("_end").isNull() | (F.struct(*order) < F.col("_end"))).select(*df.columns)
