"""From raw records to processed ones: clean, filter by length, drop exact duplicates keeping the first, split by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import clean_text, document_hash, is_hex_digest, split_of
from weftline.operators.spread import spread


def with_cleaned(raw: DataFrame) -> DataFrame:
    """Adds cleaned, digest and trusted; a record that says it is cleaned and has a hash is believed.

    Needs text, document_hash, text_preprocessed.  Null text gives nulls and is not trusted.
    """
    trusted = F.coalesce(F.col("text_preprocessed"), F.lit(False)) & is_hex_digest(F.col("document_hash")) & F.col("text").isNotNull()
    cleaned = F.when(F.col("trusted"), F.col("text")).otherwise(F.col("_clean"))
    known = spread(raw).withColumn("trusted", trusted)
    # null text never enters the cleaner: believed rows cost nothing
    known = known.withColumn("_clean", clean_text(F.when(~F.col("trusted"), F.col("text")))).withColumn("cleaned", cleaned)
    return known.withColumn("digest", F.when(F.col("trusted"), F.col("document_hash")).otherwise(document_hash(F.col("cleaned")))).drop("_clean")


def length_reason(cleaned: Column, min_chars: int, max_chars: int | None) -> Column:
    """``short``, ``long`` or null."""
    short = cleaned.isNull() | (F.char_length(cleaned) < min_chars)
    reason = F.when(short, "short")
    return reason if max_chars is None else reason.when(F.char_length(cleaned) > max_chars, "long")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``.

    An aggregate, not a window: tasks combine before the shuffle, so a key with a third of all rows sends one row a task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    least = F.min(F.struct(*order, *rest)) if not rest else F.min_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*key).agg(least.alias("_first")).select(*key, "_first.*").select(*df.columns)


def reasons(raw: DataFrame, order: list[str], min_chars: int = 200, max_chars: int | None = None, validation_rate: float = 0.001) -> DataFrame:
    """Narrow rows (*order, source_id, digest, trusted, outcome): why each record was dropped, or its split.

    The first rule that holds counts: short (null text included), long, duplicate.  Only records that pass the length rules
    can make another one a duplicate.
    """
    rows = with_cleaned(raw).select(*order, "source_id", "digest", "trusted", length_reason(F.col("cleaned"), min_chars, max_chars).alias("drop"))
    passed = rows.where("drop is null")
    first = passed.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))
    judged = passed.join(first, "digest").withColumn("outcome", F.when(F.struct(*order) == F.col("first"), split_of(F.col("digest"), validation_rate)).otherwise("duplicate"))
    columns = [*order, "source_id", "digest", "trusted", "outcome"]
    return judged.select(*columns).unionByName(rows.where("drop is not null").withColumn("outcome", F.col("drop")).select(*columns))


def processed(raw: DataFrame, order: list[str], min_chars: int = 200, max_chars: int | None = None, validation_rate: float = 0.001, keep: tuple[str, ...] = ()) -> DataFrame:
    """Processed records (*order, *keep, text, source_id, document_hash, split); the text moves in one shuffle."""
    rows = with_cleaned(raw).where(length_reason(F.col("cleaned"), min_chars, max_chars).isNull())
    rows = rows.select(*order, *keep, F.col("cleaned").alias("text"), "source_id", F.col("digest").alias("document_hash"))
    return keep_first(rows, ["document_hash"], order).select(*order, *keep, "text", "source_id", "document_hash", split_of(F.col("document_hash"), validation_rate).alias("split"))


def statistics(judged: DataFrame) -> DataFrame:
    """One row of the seven counters of ``reasons``."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return judged.agg(
        F.count("*").alias("input_documents"),
        count("train").alias("kept_train_documents"),
        count("validation").alias("kept_validation_documents"),
        count("short").alias("dropped_short_documents"),
        count("long").alias("dropped_long_documents"),
        count("duplicate").alias("dropped_duplicate_documents"),
        F.count_if("trusted").alias("trusted_preprocessed_documents"),
    )
