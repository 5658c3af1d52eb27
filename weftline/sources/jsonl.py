"""JSON lines: scans that number lines, keep the type of values, and fail on what the format forbids."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = (".jsonl", ".jsonl.gz", ".jsonl.zst")


def input_files(folder: str) -> list[str]:
    """Paths of JSON-lines files under a folder, sorted; other files are ignored."""
    found = [os.path.join(at, f) for at, _, files in os.walk(folder) for f in files if f.endswith(SUFFIXES)]
    return sorted(found)


_LINE = ["file_idx", "line_no", "line", "path"]


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of files, streamed: a file is never held whole."""
    import gzip

    for pdf in batches:
        for index, path in zip(pdf["file_idx"], pdf["path"]):
            with open(path, "rb") as raw:
                if path.endswith(".gz"):
                    stream = gzip.open(raw)
                elif path.endswith(".zst"):
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                else:
                    stream = raw
                held: list[tuple] = []
                for k, line in enumerate(io.TextIOWrapper(stream, "utf-8", newline="\n")):
                    held.append((index, k, line.rstrip("\r\n"), path))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=_LINE)
                        held = []
                yield pd.DataFrame(held, columns=_LINE)


def split_file(folder: str, split: str) -> str:
    """The file of a split in a folder of processed records, whatever its codec; none and more than one fail."""
    found = [p for p in (os.path.join(folder, split + s) for s in SUFFIXES) if os.path.exists(p)]
    if not found:
        raise FileNotFoundError(f"{folder} has no file of split {split}")
    if len(found) > 1:
        raise ValueError(f"split {split} has several files: {', '.join(map(os.path.basename, found))}")
    return found[0]


def split_records(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """(split, line_no, value): the processed records of the splits named, each once, in the order named."""
    paths = [(k, s, split_file(folder, s)) for k, s in enumerate(dict.fromkeys(splits))]
    files = spark.createDataFrame([(k, p) for k, _, p in paths], "file_idx int, path string").repartition(len(paths), "file_idx")
    rows = files.mapInPandas(_lines, "file_idx int, line_no long, line string, path string")
    names = F.element_at(F.array(*[F.lit(s) for _, s, _ in paths]), F.col("file_idx") + 1)
    return _parsed(rows).select(names.alias("split"), "line_no", "value")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_idx, line_no, line, path) of every JSON-lines file of a shared folder, plain, gzip or zstandard, files in path order.

    A file is one task: shards are meant to be of moderate size, and the compressed ones cannot be split anyway.
    """
    paths = input_files(folder)
    if not paths:
        return spark.createDataFrame([], "file_idx int, line_no long, line string, path string")
    files = spark.createDataFrame(list(enumerate(paths)), "file_idx int, path string").repartition(len(paths), "file_idx")
    return files.mapInPandas(_lines, "file_idx int, line_no long, line string, path string")


def lines_of_uri(spark: SparkSession, uri: str) -> DataFrame:
    """``lines`` through Spark's file systems, for folders that are not mounted: plain and gzip files, each read whole, so
    shards must fit a task's memory.  Files keep their order; empty ones take no number."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl{,.gz}").text(uri, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    paths = files.select("path").distinct()
    numbered = paths.withColumn("file_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1).cast("int"))
    parts = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    text = files.where("value <> ''").select("path", F.posexplode(parts).alias("line_no", "line"))
    return text.join(numbered, "path").select("file_idx", F.col("line_no").cast("long").alias("line_no"), "line", "path")


def records(spark: SparkSession, folder: str, named: bool = False) -> DataFrame:
    """(file_idx, line_no, value): each line of a folder, or of a URI, as a variant. A blank or malformed line fails with its place.

    With ``named`` also stem, the file's name without its last suffix; then a folder without any file fails.
    """
    if "://" in folder:
        rows = lines_of_uri(spark, folder)
        if named and rows.select("path").isEmpty():
            raise FileNotFoundError(f"{folder} holds no JSON lines")
    else:
        rows = lines(spark, folder)
        if named and not input_files(folder):
            raise FileNotFoundError(f"{folder} holds no JSON lines")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\z", 1), r"(?<=.)\.[^.]*\z", "").alias("stem")
    return _parsed(rows, *([stem] if named else []))


def _parsed(rows: DataFrame, *more: Column) -> DataFrame:
    value = F.try_parse_json("line")
    place = F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(" of file "), F.col("file_idx").cast("string"), F.lit(" is no JSON object"))
    good = value.isNotNull() & F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return rows.select("file_idx", "line_no", F.when(good, value).otherwise(F.raise_error(place).cast("variant")).alias("value"), *more)


def text_of(value, field: str, required: bool = False):
    """A variant's text field: null unless it is a string. With ``required`` an absent field fails."""
    path = f"$.{field}"
    tag = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.when(tag == "STRING", F.try_variant_get(value, path, "string"))
    if not required:
        return text
    absent = F.concat(F.lit(f"field {field} is missing; the record has "), F.schema_of_variant(value))
    return F.when(tag.isNull(), F.raise_error(absent).cast("string")).otherwise(text)


def raw_records(spark: SparkSession, folder: str, field: str = "text") -> DataFrame:
    """Raw records of a folder or URI, which must hold some file: order, text (null where it is no string), source_id (the file's stem by default), hash and flag."""
    rows = records(spark, folder, named=True)
    value = F.col("value")
    flag = F.schema_of_variant(F.try_variant_get(value, "$.text_preprocessed", "variant")) == "BOOLEAN"
    return rows.select(
        "file_idx",
        "line_no",
        text_of(value, field).alias("text"),
        F.coalesce(text_of(value, "source_id"), F.col("stem")).alias("source_id"),
        text_of(value, "document_hash").alias("document_hash"),
        F.when(flag, F.try_variant_get(value, "$.text_preprocessed", "boolean")).alias("text_preprocessed"),
    )


def write(df: DataFrame, path: str, codec: str | None = "gzip", split: str | None = None) -> None:
    """Write rows as JSON lines, null fields kept; with ``split`` one folder a value."""
    writer = df.write.option("ignoreNullFields", "false")
    if codec:
        writer = writer.option("compression", codec)
    if split:
        writer = writer.partitionBy(split)
    writer.json(path)


def write_sorted(df: DataFrame, path: str) -> None:
    """Write rows as compact JSON lines with keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def worker_events(spark: SparkSession, folder: str) -> DataFrame:
    """Worker events of a folder of JSON lines; blank lines are ignored, others must be events."""
    rows = lines(spark, folder).where("trim(line) <> ''")
    value = F.try_parse_json("line")
    place = F.concat(F.lit("line "), (F.col("line_no") + 1).cast("string"), F.lit(" of file "), F.col("file_idx").cast("string"), F.lit(" is no event"))
    parsed = rows.select("file_idx", "line_no", F.when(value.isNotNull(), value).otherwise(F.raise_error(place).cast("variant")).alias("value"))
    names = ("event_id", "experiment_id", "final_run_id", "student_id", "type", "timestamp")
    return parsed.select("file_idx", "line_no", *[text_of(F.col("value"), n).alias(n) for n in names], F.to_json(F.try_variant_get("value", "$.payload", "variant")).alias("payload"))
