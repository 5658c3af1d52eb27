"""Worker events as a stream: exactly-once intake, per-run state, resumable ingest."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from weftline.operators.exactly_once import BLOCK, Ranges, keyed

SCHEMA = "delivery_id long, event_id string, experiment_id string, final_run_id string, student_id string, type string, timestamp string, loss double"
#: Event types after which a run takes no more. Fixed values.
TERMINAL = ("worker_completed", "worker_failed")


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events of JSON-lines files as they appear in a shared folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


class _Once(StatefulProcessor):
    """Seen ranges of one block of a producer's numbers, or the mark that an odd identifier came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getMapState("ranges", "first long", "last long")
        self.seen = handle.getValueState("seen", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values=None) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("delivery_id")
        if batch["number"].isna().all():
            again = [self.seen.exists() or k > 0 for k in range(len(batch))]
            self.seen.update((1,))
        else:
            before = sorted((k[0], v[0]) for k, v in self.ranges.iterator())
            held = Ranges(before)
            again = [not held.add(int(n)) for n in batch["number"]]
            after = held.pairs()
            for first, _ in set(before) - set(after):
                self.ranges.removeKey((first,))
            for first, last in set(after) - set(before):
                self.ranges.updateValue((first,), (last,))
        yield pd.DataFrame({"delivery_id": batch["delivery_id"].to_numpy(), "again": again})

    def close(self) -> None:
        pass


def _by_value() -> None:
    """Processors are also unpickled by a helper process of the driver that knows no shipped packages."""
    for module in (sys.modules[__name__], sys.modules[Ranges.__module__]):
        cloudpickle.register_pickle_by_value(module)


def exactly_once(events: DataFrame) -> DataFrame:
    """(delivery_id, again): whether an earlier delivery, in this batch or any before, brought the message.

    State is a few ranges for each block of a producer's numbers, in RocksDB; order of arrival decides, and within a batch
    delivery_id.  Rows without a run are never repeats.
    """
    _by_value()
    rows = keyed(events)
    known = rows.where("run is not null").select("delivery_id", F.coalesce("producer", "key").alias("who"), F.coalesce(F.floor(F.col("number") / BLOCK), F.lit(-1).cast("long")).alias("block"), "number")
    return known.groupBy("who", "block").transformWithStateInPandas(_Once(), "delivery_id long, again boolean", "append", "none")


class _Run(StatefulProcessor):
    """The fold of one run: accepted events and losses until the first terminal event; later ones are late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "accepted long, losses long, last_loss double, last_type string, ended boolean, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values=None) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (0, 0, None, None, False, 0)
        batch = pd.concat(list(rows)).sort_values("delivery_id")  # a run may come in several pieces
        for kind, loss in zip(batch["type"], batch["loss"]):
            state = step(state, kind, None if pd.isna(loss) else float(loss))
        self.state.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["run_id", "accepted", "losses", "last_loss", "last_type", "ended", "late"])

    def close(self) -> None:
        pass


def step(state: tuple, kind: str | None, loss: float | None) -> tuple:
    """One event: the transition that batch and stream share."""
    accepted, losses, last, last_type, ended, late = state
    if ended:
        return (accepted, losses, last, last_type, True, late + 1)
    if kind == "validation" and loss is not None:
        losses, last = losses + 1, loss
    return (accepted + 1, losses, last, kind, kind in TERMINAL, late)


def run_states(events: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """The state of each run that had events in the batch; with ``known`` an event of another type fails the query."""
    _by_value()
    if known is not None:
        wrong = F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce("type", F.lit("null"))))
        events = events.withColumn("type", F.when(F.col("type").isin(*known), F.col("type")).otherwise(wrong.cast("string")))
    run = F.when(F.trim("final_run_id") != "", F.col("final_run_id")).otherwise(F.col("experiment_id"))
    rows = events.select(run.alias("run_id"), "delivery_id", "type", "loss").where("run_id is not null")
    return rows.groupBy("run_id").transformWithStateInPandas(_Run(), "run_id string, accepted long, losses long, last_loss double, last_type string, ended boolean, late long", "update", "none")


def available_now(df: DataFrame, sink: str, checkpoint: str) -> DataStreamWriter:
    """Resumable append-only ingest: what is there now goes to parquet, each input file once, however often it is started."""
    return df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


#: transformWithState keeps its state in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
