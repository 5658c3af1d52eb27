"""One copy of each message that was delivered at least once.

Identifiers of the form *prefix, digits* are a producer's sequence numbers.  For them the operator keeps, per producer
and block of numbers, the disjoint ranges already seen: a number outside every range is accepted once and the ranges
around it merge, so a long gap-free history costs two integers.  Every other identifier is resolved by an exact keyed
lookup.

Plan: each task first drops what its own rows already show to be a repeat, so at most one row of a number leaves a task
however hot the number is; the rest is hashed by (producer, block), sorted, and streamed through the range sets.
Nothing is collected: a task holds the ranges of one block at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.spread import spread
from weftline.scratch import cut

#: Sequence numbers that share one range set; bounds the state of a task and spreads a hot producer.
BLOCK = 1 << 16


class Ranges:
    """Disjoint closed ranges of integers in order."""

    def __init__(self, pairs: list[tuple[int, int]] | None = None) -> None:
        self.starts = [a for a, _ in pairs or []]
        self.ends = [b for _, b in pairs or []]

    def add(self, n: int) -> bool:
        """Take ``n`` in; False if it was covered."""
        k = bisect_right(self.starts, n)
        if k and n <= self.ends[k - 1]:
            return False
        left, right = k and self.ends[k - 1] == n - 1, k < len(self.starts) and self.starts[k] == n + 1
        if left and right:
            self.ends[k - 1] = self.ends.pop(k)
            self.starts.pop(k)
        elif left:
            self.ends[k - 1] = n
        elif right:
            self.starts[k] = n
        else:
            self.starts.insert(k, n)
            self.ends.insert(k, n)
        return True

    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))


def run_of(df: DataFrame) -> Column:
    """The run a delivery belongs to: final_run_id unless null or blank, else experiment_id."""
    return F.when(F.trim(F.col("final_run_id")) != "", F.col("final_run_id")).otherwise(F.col("experiment_id"))


def instant(text: Column) -> Column:
    """Microseconds of an ISO-8601 text; one without an offset is taken as UTC; null if it is no timestamp."""
    zoned = F.when(text.rlike(r"(Z|z|[+-]\d\d:?\d\d)\s*$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(F.trim(zoned)))


def keyed(df: DataFrame) -> DataFrame:
    """delivery_id with the parts of its identity: producer and number for sequence identifiers, else an exact key.

    An identifier counts as a sequence number if it ends in 1 to 18 digits; its run, prefix and number of digits together
    name the producer, so "7" and "07" stay different, as their texts are.
    """
    event = F.regexp_replace(F.coalesce("event_id", F.lit("")), r"^\s+|\s+$", "")
    digits = F.regexp_extract(event, r"(?<![0-9])([0-9]{1,18})$", 1)
    base = df.select(F.col("delivery_id").cast("long").alias("delivery_id"), run_of(df).alias("run"), event.alias("event"), digits.alias("digits"), "type", "timestamp")
    sequence = F.col("digits") != ""
    spoken = F.to_json(F.struct("run", F.expr("left(event, length(event) - length(digits))").alias("prefix"), F.length("digits").alias("width")))
    by_event = F.struct(F.lit("e").alias("k"), F.col("run").alias("a"), F.col("event").alias("b"), F.lit("").alias("c"))
    when = F.coalesce(instant(F.col("timestamp")).cast("string"), F.concat(F.lit("?"), F.trim(F.col("timestamp"))), F.lit("!"))
    by_time = F.struct(F.lit("t").alias("k"), F.col("run").alias("a"), F.coalesce("type", F.lit("")).alias("b"), when.alias("c"))
    return base.select(
        "delivery_id",
        F.when(F.trim("run") == "", None).otherwise(F.col("run")).alias("run"),
        F.when(sequence, spoken).alias("producer"),
        F.when(sequence, F.col("digits").cast("long")).alias("number"),
        F.when(~sequence, F.to_json(F.when(F.col("event") != "", by_event).otherwise(by_time))).alias("key"),
    )


_SEEN = "delivery_id long, producer string, block long, number long, again boolean"


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mark repeats within a task; rows come by delivery_id, so the first of a number is the earliest here."""
    seen: dict[tuple[str, int], Ranges] = {}
    held = 0
    for pdf in batches:
        again = []
        for producer, number in zip(pdf["producer"], pdf["number"]):
            at = (producer, number // BLOCK)
            ranges = seen.get(at)
            if ranges is None:
                if held >= 200_000:  # forgetting only sends more rows on
                    seen.clear()
                    held = 0
                ranges = seen[at] = Ranges()
                held += 1
            again.append(not ranges.add(number))
        yield pdf.assign(block=pdf["number"] // BLOCK, again=again)[["delivery_id", "producer", "block", "number", "again"]]


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by producer, block, delivery_id: one range set at a time."""
    at, ranges = None, Ranges()
    for pdf in batches:
        again = []
        for producer, block, number in zip(pdf["producer"], pdf["block"], pdf["number"]):
            if (producer, block) != at:
                at, ranges = (producer, block), Ranges()
            again.append(not ranges.add(number))
        yield pdf.assign(again=again)[["delivery_id", "again"]]


def repeats(deliveries: DataFrame) -> DataFrame:
    """delivery_id of every delivery of a message that a smaller delivery_id brought.

    Takes delivery_id, event_id, experiment_id, final_run_id, type, timestamp; further columns are ignored.  Two rows are
    the same message if run and event_id (outer blanks aside) agree, or, where event_id is null or blank in both, run,
    type (null as empty) and instant; timestamps that cannot be read are compared as text, null ones are equal.  A row
    without a run or delivery_id has no identity and is never a repeat.  Rows sent twice with one delivery_id are not told apart.
    An empty table gives an empty result.
    """
    rows = cut(keyed(spread(deliveries.where("delivery_id is not null"))).where("run is not null"), "messages")
    local = rows.where("producer is not null").select("delivery_id", "producer", "number").sortWithinPartitions("delivery_id").mapInPandas(_local, _SEEN)
    first = local.where("not again").select("delivery_id", "producer", "block", "number")
    across = first.repartition("producer", "block").sortWithinPartitions("producer", "block", "delivery_id").mapInPandas(_across, "delivery_id long, again boolean")
    odd = rows.where("producer is null").select("delivery_id", "key")
    # by key the aggregate combines before its shuffle; the lookup is by delivery_id, so a key of a million rows is no single task
    first = odd.groupBy("key").agg(F.min("delivery_id").alias("delivery_id")).select("delivery_id")
    by_key = odd.select("delivery_id").join(first, "delivery_id", "left_anti")
    return local.where("again").select("delivery_id").unionByName(across.where("again").select("delivery_id")).unionByName(by_key.select("delivery_id"))


def exactly_once(deliveries: DataFrame) -> DataFrame:
    """The deliveries without repeats, all columns kept."""
    return deliveries.join(repeats(deliveries).withColumnRenamed("delivery_id", "_repeat"), F.col("delivery_id") == F.col("_repeat"), "left_anti")


def merge_ranges(pairs: DataFrame) -> DataFrame:
    """Disjoint maximal ranges (producer, first, last) of (producer, first, last) rows: the state to carry to the next batch."""
    rows = pairs.select("producer", "first", "last")
    return rows.repartition("producer").sortWithinPartitions("producer", "first").mapInPandas(_merged, "producer string, first long, last long")


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, low, high, done = None, 0, 0, []
    for pdf in batches:
        for producer, first, last in zip(pdf["producer"], pdf["first"], pdf["last"]):
            if producer == at and first <= high + 1:
                high = max(high, last)
                continue
            if at is not None:
                done.append((at, low, high))
            at, low, high = producer, first, last
        yield pd.DataFrame(done, columns=["producer", "first", "last"])
        done = []
    if at is not None:
        yield pd.DataFrame([(at, low, high)], columns=["producer", "first", "last"])


def seen_ranges(deliveries: DataFrame) -> DataFrame:
    """Ranges of sequence numbers delivered so far, per producer."""
    one = keyed(deliveries).where("run is not null and producer is not null").select("producer", F.col("number").alias("first"), F.col("number").alias("last"))
    return merge_ranges(one.dropDuplicates())
