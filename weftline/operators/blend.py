"""Plans over a few sources: token budgets by weight, download tasks, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _all() -> WindowSpec:
    return Window.partitionBy(F.lit(0))


def allocate(sources: DataFrame, total: int, id: str = "id", weight: str = "weight") -> DataFrame:
    """Adds target_tokens: the total shared out by weight, the remainder one each to the largest fractions, ids descending.

    The plan is a manifest of few rows; one window holds it.  A negative weight or a weight sum of 0 fails.
    """
    if total <= 0:
        raise ValueError("total must be positive")
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("weights must be nonnegative"))).otherwise(F.col(weight))
    whole = F.sum(w).over(_all())
    share = F.when(whole > 0, F.lit(float(total)) * (w / whole)).otherwise(F.raise_error(F.lit("at least one weight must be positive")).cast("double"))
    rows = sources.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_floor").over(_all()))
    nth = F.row_number().over(_all().orderBy(F.desc(F.col("_share") - F.col("_floor")), F.desc(id)))
    return rows.withColumn("target_tokens", F.col("_floor") + F.when(nth <= F.col("_left"), 1).otherwise(0)).drop("_share", "_floor", "_left")


def plan(manifest: DataFrame, total: int) -> DataFrame:
    """Enabled sources with their budgets; split and text field have defaults, a missing flag means enabled."""
    enabled = manifest.where(F.coalesce("enabled", F.lit(True)))
    return allocate(enabled, total).withColumn("split", F.coalesce("split", F.lit("train"))).withColumn("text_field", F.coalesce("text_field", F.lit("text")))


def part_of(limit: Column, index: Column, parts: Column) -> Column:
    """Share ``index`` of an integer limit split evenly; the first shares get the remainder; null stays null."""
    return F.floor(limit / parts) + F.when(index < F.pmod(limit, parts), 1).otherwise(0)


def download_budget(target: Column, ratio: float) -> Column:
    """Tokens to fetch, at least 1; no budget for a ratio of 0 or less."""
    return F.lit(None).cast("long") if ratio <= 0 else F.greatest(F.lit(1).cast("long"), F.floor(target.cast("double") * ratio))


def tasks(planned: DataFrame, parts: int, ratio: float = 1.0) -> DataFrame:
    """One row for each source and part: download_id, part, max_docs, max_tokens; a part without tokens takes no documents."""
    rows = planned.withColumn("budget", download_budget(F.col("target_tokens"), ratio)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    name = F.col("id") if parts == 1 else F.format_string("%s.part%03d", F.col("id"), F.col("part"))
    rows = rows.withColumn("tokens", part_of(F.col("budget"), F.col("part"), F.lit(parts)))
    return rows.select("id", name.alias("download_id"), "part", F.when(F.col("tokens") <= 0, 0).alias("max_docs"), F.when(F.col("tokens") > 0, F.col("tokens")).alias("max_tokens"))


def token_budget(requested: int, available: int, sequence_length: int) -> int:
    """Tokens usable for whole sequences; one is kept back for the last label."""
    if min(requested, sequence_length) <= 0:
        raise ValueError("requested and sequence_length must be positive")
    usable = min(requested, available - 1) // sequence_length * sequence_length
    if usable <= 0:
        raise ValueError(f"{available} tokens hold no sequence of {sequence_length}")
    return usable


def evaluations(steps: Column, requested: int) -> Column:
    """The largest divisor of the steps up to the number requested; the number itself if there are fewer steps."""
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(requested), steps.cast("int")))), lambda d: F.pmod(steps, d) == 0)
    return F.when(F.lit(requested) > steps, F.lit(requested)).otherwise(F.array_max(divisors))
