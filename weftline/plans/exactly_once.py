"""Queries on messages delivered more than once, with the SQL they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.exactly_once import exactly_once, repeats
from weftline.scratch import folder
from weftline.streaming import events


def found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{d}/experiment_events.parquet"))


def kept_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Messages left per type, after exactly one copy of each stayed."""
    kept = exactly_once(spark.read.parquet(f"{d}/experiment_events.parquet"))
    return kept.groupBy("type").agg(F.count("*").alias("messages"), F.min("delivery_id").alias("first_delivery"), F.max("delivery_id").alias("last_delivery"))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the deliveries taken as a stream: what is there now, state per producer, results of this run read back."""
    path = f"{d}/experiment_events.parquet"
    spark.conf.set(*events.STATE_STORE)
    incoming = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    at = f"{folder(spark)}/weftline/stream-{uuid.uuid4().hex}"
    events.available_now(events.exactly_once(incoming), f"{at}/rows", f"{at}/checkpoint").start().awaitTermination()
    return spark.read.schema("delivery_id long, again boolean").parquet(f"{at}/rows").where("again").select("delivery_id")


QUERIES = {"p3_found": found, "p3_kept_by_type": kept_by_type, "p3_streamed": streamed}

_FIRST = """
with k as (
  select delivery_id, type,
         case when trim(coalesce(final_run_id, '')) <> '' then final_run_id else experiment_id end as run,
         regexp_replace(coalesce(event_id, ''), '^\\s+|\\s+$', '', 'g') as event,
         epoch_us(cast(timestamp as timestamptz)) as us
  from experiment_events
), r as (
  select delivery_id, type, run,
         row_number() over (partition by run, event, case when event = '' then coalesce(type, '') end, case when event = '' then us end order by delivery_id) as nth
  from k
)
"""

SQL = {
    "p3_found": _FIRST + "select delivery_id from r where nth > 1 and trim(coalesce(run, '')) <> ''",
    "p3_streamed": _FIRST + "select delivery_id from r where nth > 1 and trim(coalesce(run, '')) <> ''",
    "p3_kept_by_type": _FIRST + "select type, count(*) as messages, min(delivery_id) as first_delivery, max(delivery_id) as last_delivery from r where nth = 1 or trim(coalesce(run, '')) = '' group by type",
}
