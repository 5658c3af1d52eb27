"""Ingest of a source that goes on where it was stopped.

Rows are numbered; they are written in batches of numbers, each a folder of its own, and a batch counts once the state file
names it: the file is replaced atomically after the batch is written, so the cursor never runs ahead of the data and a batch
that was torn is written again over itself.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ingest import within_budget
from weftline.sources.tables import load_json, write_json

QUEUED, IN_PROGRESS, INTERRUPTED, COMPLETED = "queued", "in_progress", "interrupted", "completed"


def state_of(folder: str, request: dict) -> dict:
    """The state of a request: as recorded if it is of the same request, else queued from the beginning."""
    try:
        state = load_json(f"{folder}/state.json")
    except FileNotFoundError:
        state = {}
    fresh = {"request": request, "status": QUEUED, "batches": 0, "scanned_documents": 0, "written_documents": 0, "estimated_tokens": 0, "stop_reason": None}
    return state if state.get("request") == request else fresh


def ingest(rows: DataFrame, folder: str, request: dict, estimate: Column, batch: int = 1_000_000, ordinal: str = "ordinal", max_documents: int | None = None, max_tokens: int | None = None, most_batches: int | None = None) -> dict:
    """Write ``rows`` (ordinal from 0, columns to keep) below ``folder`` and give the final state.

    ``request`` is what the result depends on besides (location, text field): with another one, or other limits, the folder
    is begun anew; with the same one a completed ingest is not repeated and a stopped one goes on after its last whole batch.
    Documents are taken until one of the limits is reached; the document that crosses the token limit is the last.  After
    ``most_batches`` batches of this call the ingest is left interrupted.
    """
    request = request | {"max_documents": max_documents, "max_tokens": max_tokens}
    state = state_of(folder, request)
    if state["status"] == COMPLETED:
        return state
    if not state["batches"] and os.path.isdir(f"{folder}/batches"):
        shutil.rmtree(f"{folder}/batches")
    keep = [c for c in rows.columns if c != ordinal]
    begun = state["batches"]
    try:
        while state["status"] != COMPLETED:
            if most_batches is not None and state["batches"] - begun >= most_batches:
                state["status"] = INTERRUPTED
                write_json(f"{folder}/state.json", state)
                break
            state["status"] = IN_PROGRESS
            write_json(f"{folder}/state.json", state)
            first = state["scanned_documents"]
            last = first + batch if max_documents is None else min(first + batch, max_documents)
            own = rows.where((F.col(ordinal) >= first) & (F.col(ordinal) < last)).withColumn("_tokens", estimate.cast("long"))
            if max_tokens is not None:
                own = within_budget(own.withColumn("_all", F.lit(0)), [ordinal], F.col("_tokens"), F.lit(max_tokens - state["estimated_tokens"]), ["_all"]).drop("_all")
            at = f"{folder}/batches/batch-{state['batches']:06d}"
            own.select(ordinal, "_tokens", *keep).write.mode("overwrite").parquet(at)
            n, tokens = rows.sparkSession.read.parquet(at).agg(F.count("*"), F.coalesce(F.sum("_tokens"), F.lit(0))).first()
            state |= {"batches": state["batches"] + 1, "scanned_documents": first + n, "written_documents": state["written_documents"] + n, "estimated_tokens": state["estimated_tokens"] + tokens}
            if max_tokens is not None and state["estimated_tokens"] >= max_tokens:
                state |= {"status": COMPLETED, "stop_reason": "max_tokens"}
            elif max_documents is not None and state["scanned_documents"] >= max_documents:
                state |= {"status": COMPLETED, "stop_reason": "max_documents"}
            elif n < last - first:
                state |= {"status": COMPLETED, "stop_reason": "source_exhausted"}
            write_json(f"{folder}/state.json", state)
    except BaseException:
        state["status"] = INTERRUPTED
        write_json(f"{folder}/state.json", state)
        raise
    return state


def ingested(rows_of: DataFrame, folder: str) -> DataFrame:
    """What whole batches hold, with the columns of the ingest."""
    state = load_json(f"{folder}/state.json")
    paths = [f"{folder}/batches/batch-{k:06d}" for k in range(state["batches"])]
    return rows_of.sparkSession.read.parquet(*paths).drop("_tokens") if paths else rows_of.where("false")


def repair(path: str) -> int:
    """Cut a log of lines after its last whole line; gives the number of whole lines."""
    end, lines = 0, 0
    with open(path, "rb+") as f:
        while chunk := f.read(1 << 20):
            lines += chunk.count(b"\n")
            if b"\n" in chunk:
                end = f.tell() - len(chunk) + chunk.rindex(b"\n") + 1
        f.truncate(end)
    return lines


def finalize(log: str, out: str) -> int:
    """Compress a log of JSON lines to ``out`` (.jsonl.gz), which appears whole, and remove the log; gives its lines."""
    import gzip

    lines = repair(log)
    with open(log, "rb") as source, gzip.GzipFile(f"{out}.part", "wb", mtime=0) as target:
        shutil.copyfileobj(source, target, 1 << 20)
    os.replace(f"{out}.part", out)
    os.remove(log)
    return lines
