"""Assertions over tables and documents: unknown keys, missing fields, agreement of two sides, rules, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a side that may be sent to every task.
MOST_SENT = 8 << 20


def unknown_keys(keys: Column, allowed: list[str]) -> Column:
    """Keys of an array that are not allowed, sorted; empty for null."""
    return F.coalesce(F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed)))), F.array().cast("array<string>"))


def missing_keys(keys: Column, required: list[str]) -> Column:
    """Required keys that an array lacks, in the order given."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and number."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as kept. A validation in one column."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def whole_number(text: Column, least: int = 0) -> Column:
    """The number a text holds, or null unless it is a whole number of at least ``least``; true and 1.0 are none."""
    parsed = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    return F.when(parsed >= least, parsed)


def agreement(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, side, differing): rows of a full outer join with the fields that differ, null being equal to null, and the side a
    row stands on alone."""
    a = left.select(*key, F.struct(*fields).alias("_a"))
    b = right.select(*key, F.struct(*fields).alias("_b"))
    joined = a.join(b, key, "full_outer")
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    return joined.select(*key, side.alias("side"), F.when(side == "both", differ).otherwise(F.array().cast("array<string>")).alias("differing"))


def holding_secrets(rows: DataFrame, secrets: list[str], text: str = "text") -> DataFrame:
    """Rows whose text holds one of the secrets. The list goes to every task and is bounded; blank secrets are ignored."""
    wanted = sorted({s for s in secrets if s.strip()})
    if sum(map(len, wanted)) > MOST_SENT:
        raise ValueError("too many secrets to send to every task")
    if not wanted:
        return rows.where("false")
    hit = F.contains(F.col(text), F.lit(wanted[0]))
    for s in wanted[1:]:
        hit = hit | F.contains(F.col(text), F.lit(s))
    return rows.where(hit)


def required(rows: DataFrame, broken: Column, message: Column) -> DataFrame:
    """``rows``, failing with ``message`` when a row that breaks the rule is reached."""
    return rows.where(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))


def parameter_count(layers: Column, hidden: Column, intermediate: Column, vocabulary: Column) -> Column:
    """Parameters of a decoder, exact beyond 64 bits: layers of attention, feed-forward and two norms, a last norm, embeddings."""
    wide = lambda c: c.cast("decimal(12,0)")
    layer = wide(hidden) * wide(hidden) * 4 + wide(hidden) * wide(intermediate) * 2 + wide(hidden) * 2
    return (wide(layers) * layer.cast("decimal(24,0)") + wide(hidden) + wide(vocabulary) * wide(hidden)).cast("decimal(38,0)")
