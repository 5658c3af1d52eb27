"""Run ledgers: idempotent events, folds in arrival order, queues, budgets, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.prefix import ordinals
from weftline.scratch import cut


def event_identity(df: DataFrame) -> Column:
    """(kind, run, event_id), trimmed; null for a row that names no event or no run. The final run goes first."""
    final, experiment, event = (F.nullif(F.trim(c), F.lit("")) for c in ("final_run_id", "experiment_id", "event_id"))
    run = F.when(final.isNotNull(), F.struct(F.lit("final_run_id").alias("kind"), final.alias("run"))).otherwise(F.struct(F.lit("experiment_id").alias("kind"), experiment.alias("run")))
    return F.when(event.isNotNull() & run["run"].isNotNull(), F.struct(run["kind"].alias("kind"), run["run"].alias("run"), event.alias("event_id")))


def idempotent(events: DataFrame, order: str) -> DataFrame:
    """Events with ``repeat``: whether an earlier event has the same identity. Events without identity never repeat.

    First arrivals come from an aggregate that combines before the shuffle; then an event repeats if it is not one of them.
    That join is on ``order``, which is unique, so an identity sent a million times is no single task.
    """
    rows = events.withColumn("_identity", event_identity(events))
    first = rows.where("_identity is not null").groupBy("_identity").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("_is_first"))
    joined = rows.join(first, order, "left")
    return joined.select(*events.columns, (F.col("_identity").isNotNull() & F.col("_is_first").isNull()).alias("repeat"))


def selected(experiments: DataFrame, student: str | None = None, status: str | None = None) -> DataFrame:
    """Experiments of a student, of a status, of both or all."""
    for column, value in (("student_id", student), ("status", status)):
        if value is not None:
            experiments = experiments.where(F.col(column) == value)
    return experiments


def of_experiments(events: DataFrame, experiment: str | None = None) -> DataFrame:
    """Events of experiments, or of one, among all worker events."""
    rows = events.where(F.trim("experiment_id") != "")
    return rows if experiment is None else rows.where(F.col("experiment_id") == experiment)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an upsert log folded. Ties are broken by nothing else, so order must be total."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, "_last.*").select(*df.columns)


def first_per(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, first, n): the first of each key and how many there are."""
    return df.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def before_terminal(events: DataFrame, run: list[str], order: str, terminal: Column) -> DataFrame:
    """Events with ``late``: whether they come after the first terminal event of their run.

    Runs are found by an aggregate and written down, so that the join can split a run with most of the events.
    """
    ends = cut(events.where(terminal).groupBy(*run).agg(F.min(order).alias("_end")), "ends")
    return events.join(ends, run, "left").withColumn("late", F.coalesce(F.col(order) > F.col("_end"), F.lit(False))).drop("_end")


def values_in_order(df: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    """(key, name): the non-null values of each key as an array in order."""
    held = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_v"))
    return held.select(*key, F.transform("_v", lambda x: x[value]).alias(name))


def loss_summary(losses: Column) -> list[Column]:
    """evaluations, first, last and lowest of an array; null where it is empty."""
    return [
        F.coalesce(F.size(losses), F.lit(0)).alias("evaluations"),
        F.try_element_at(losses, F.lit(1)).alias("first_loss"),
        F.try_element_at(losses, F.lit(-1)).alias("last_loss"),
        F.array_min(losses).alias("lowest_loss"),
    ]


def loss_totals(df: DataFrame, key: list[str], order: str, loss: str) -> DataFrame:
    """``loss_summary`` of the non-null values of each key, by aggregates alone: no list is held, however long a run is."""
    rows = df.where(F.col(loss).isNotNull()).groupBy(*key)
    return rows.agg(F.count("*").cast("int").alias("evaluations"), F.min_by(loss, order).alias("first_loss"), F.max_by(loss, order).alias("last_loss"), F.min(loss).alias("lowest_loss"))


def fair_share(queue: DataFrame, owner: str, position: str) -> DataFrame:
    """Adds round and rank: everybody's first item, then everybody's second; within a round by first appearance.

    Positions are unique.  Rounds and ranks come from two-phase prefix sums, so neither the queue nor an owner with most of
    it is one task.
    """
    mine = ordinals(queue.select(owner, position), [position], "_round", [owner])
    first = queue.groupBy(owner).agg(F.min(position).alias("_first"))
    rows = queue.join(mine, [owner, position]).join(first, owner).withColumn("round", F.col("_round") + 1)
    ranked = ordinals(rows.select("round", "_first"), ["round", "_first"], "_rank")
    return rows.join(ranked, ["round", "_first"]).withColumn("rank", F.col("_rank") + 1).drop("_first", "_round", "_rank")


def queue_positions(items: DataFrame, order: str) -> DataFrame:
    """Adds position, from 1, by the unique column ``order``."""
    return items.join(ordinals(items.select(order), [order], "_at"), order).withColumn("position", F.col("_at") + 1).drop("_at")


def remaining(total: Column, reserved: Column, charged: Column) -> Column:
    return total - reserved - charged


def balances(entries: DataFrame, owner: str, kind: str = "kind", amount: str = "seconds") -> DataFrame:
    """(owner, total, reserved, charged, remaining) of a ledger of grant, reserve, release, charge, refund and adjust entries.

    Amounts are not negative but for adjustments; a release takes back a reservation, a refund a charge.  Unknown kinds fail.
    """
    of = lambda *signs: sum((F.when(F.col(kind) == k, s * F.col(amount)).otherwise(0) for k, s in signs), F.lit(0))
    known = F.col(kind).isin("grant", "adjust", "reserve", "release", "charge", "refund")
    rows = entries.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null")))).cast("boolean")))
    sums = rows.groupBy(owner).agg(F.sum(of(("grant", 1), ("adjust", 1))).alias("total"), F.sum(of(("reserve", 1), ("release", -1))).alias("reserved"), F.sum(of(("charge", 1), ("refund", -1))).alias("charged"))
    return sums.withColumn("remaining", remaining(F.col("total"), F.col("reserved"), F.col("charged")))


def clipped(actual: Column, reserved: Column, least: int = 1) -> Column:
    """A charge between ``least`` and what is reserved; null counts as all of it."""
    return F.greatest(F.lit(least).cast("long"), F.least(F.coalesce(actual, reserved), reserved))


def prediction_scores(predicted: Column, lower: Column, upper: Column, actual: Column, miss_weight: float = 10.0) -> dict[str, Column]:
    """Point and interval scores of a prediction.

    Without a finite prediction and outcome all are null; without an ordered finite interval only the point error is given.
    """
    point = F.abs(predicted - actual)
    whole = lower.isNotNull() & upper.isNotNull() & (lower <= upper) & point.isNotNull()
    width = F.when(whole, upper - lower)
    miss = F.when(whole, F.greatest(F.lit(0.0), lower - actual) + F.greatest(F.lit(0.0), actual - upper))
    score = width + miss_weight * miss
    return {
        "absolute_error": point,
        "covered": F.when(whole, (lower <= actual) & (actual <= upper)),
        "width": width,
        "miss": miss,
        "score": score,
        "penalty": 0.5 * point + 0.5 * score,
    }


def missing(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows that the other side lacks."""
    return required.join(present.select(*key), key, "left_anti")


def coalesced(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join on ``key`` with the first side's values where it has the row, and ``origin``."""
    values = [c for c in first.columns if c not in key]
    a = first.select(*key, F.struct(*values).alias("_a"))
    b = second.select(*key, F.struct(*values).alias("_b"))
    joined = a.join(b, key, "full_outer")
    return joined.select(*key, F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("origin"), F.coalesce("_a", "_b").alias("_v")).select(*key, "origin", "_v.*")
