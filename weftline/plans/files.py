"""Round trips through files, as queries: what is read back must equal what SQL says was written."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import token_estimate
from weftline.operators import tokens
from weftline.operators.prefix import ordinals, prefix_sum
from weftline.plans import corpus, pipeline
from weftline.plans.corpus import SHARD, table
from weftline.plans.sqltext import collapsed
from weftline.scratch import folder
from weftline.sources import export, jsonl, resume, shards, tables


#: Tokens that the resumed ingest takes.
INGEST = 200_000


def _place(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared file system, as a path."""
    return shards.local_path(f"{folder(spark)}/weftline/{name}-{uuid.uuid4().hex}")


def _written(spark: SparkSession, d: str) -> str:
    """Raw records as gzip JSON lines in order of arrival."""
    at = _place(spark, "jsonl")
    rows = table(spark, d, "raw_records").repartitionByRange(4, "file_idx", "line_no").sortWithinPartitions("file_idx", "line_no")
    named = rows.withColumn("source_id", corpus.source("source_id"))
    jsonl.write(named.withColumnRenamed("text", "body").drop("file_idx", "line_no"), f"file://{at}")
    for f in sorted(os.listdir(at)):
        if f.endswith(".json.gz"):
            os.rename(f"{at}/{f}", f"{at}/{f.removesuffix('.json.gz')}.jsonl.gz")
    return at


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Raw records written as JSON lines and scanned again, null texts kept, numbered in order of arrival."""
    at = _written(spark, d)
    value = F.col("value")
    rows = jsonl.records(spark, at).select(F.variant_get(value, "$.record_id", "long").alias("record_id"), jsonl.text_of(value, "body", required=True).alias("text"), "file_idx", "line_no")
    return rows.join(ordinals(rows, ["file_idx", "line_no"]), ["file_idx", "line_no"]).select("record_id", "text", "ordinal")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed_records").where("text is not null")
    return rows.select(corpus.split_of().alias("split"), corpus.source("source_id").alias("source_id"), "record_id", tokens.word_length_tokens(F.col("text")).alias("tokens"))


def _by_split(spark: SparkSession, d: str, through: Callable[[DataFrame], str]) -> DataFrame:
    """(split, position, token) of each split's tokens, written and read back by ``through``, which gives the index to read.

    A corpus has a few splits, each with an index of its own; a text has at least its end token.
    """
    rows = _tokens(spark, d)
    out = spark.createDataFrame([], "split string, position long, token long")
    for (split,) in sorted(rows.select("split").distinct().collect()):
        uri = through(rows.where(F.col("split") == split).drop("split"))
        shards.load_index(uri, full=True)
        out = out.unionByName(shards.read_range(spark, uri, block=1500).select(F.lit(split).alias("split"), "position", "token"))
    return out


def shard_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each split written as binary shards of its own, audited, and all read back by address."""

    def through(rows: DataFrame) -> str:
        at = _place(spark, "shards")
        shards.write_shards(rows, ["record_id"], at, SHARD)
        return f"file://{at}/index.json"

    return _by_split(spark, d, through)


def token_positions(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last token of every record, read from the shards of its split by their addresses."""
    out, rows = spark.createDataFrame([], "split string, position long, token long"), _tokens(spark, d)
    for (split,) in sorted(rows.select("split").distinct().collect()):
        own, at = rows.where(F.col("split") == split), _place(spark, "shards")
        shards.write_shards(own.drop("split"), ["record_id"], at, SHARD)
        ends = prefix_sum(own.select("record_id", F.size("tokens").cast("long").alias("n")), ["record_id"], "n")
        asked = ends.select(F.explode(F.array_distinct(F.array("start", F.col("start") + F.col("n") - 1))).alias("position"))
        out = out.unionByName(shards.read_positions(spark, f"file://{at}/index.json", asked).select(F.lit(split).alias("split"), "position", "token"))
    return out


def index_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Shards, tokens and sources by the index of each split's shards."""
    rows, indexes = _tokens(spark, d), {}
    for (split,) in sorted(rows.select("split").distinct().collect()):
        at = _place(spark, "shards")
        shards.write_shards(rows.where(F.col("split") == split).drop("split"), ["record_id"], at, SHARD)
        indexes[split] = f"{at}/index.json"
    return shards.index_summary(spark, indexes)


def corpus_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The shards of each split rewritten in the stride order of their chunks, and every token read back by its new address."""

    def through(rows: DataFrame) -> str:
        a, b = _place(spark, "shards"), _place(spark, "shuffled")
        shards.write_shards(rows, ["record_id"], a, SHARD)
        shards.shuffle_corpus(spark, f"file://{a}/index.json", b, corpus.CHUNK, corpus.SEED)
        return f"file://{b}/index.json"

    return _by_split(spark, d, through)


def ledger_export(spark: SparkSession, d: str) -> DataFrame:
    """The whole export set written; of its CSV of experiments every field as text, nothing null."""
    at = _place(spark, "export")
    given = {n: table(spark, d, n) for n in ("experiments", "experiment_events", "budget_snapshots")}
    back = spark.read.option("nullValue", "\\N").option("emptyValue", "").csv(f"file://{export.course_export(spark, given, f'file://{at}')['experiments_csv'].removeprefix('file://')}", header=True)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns if c != "final_validation_loss"], (F.coalesce("final_validation_loss", F.lit("")) != "").cast("string").alias("has_loss"))


def export_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each file of the export set."""
    at = _place(spark, "export")
    given = {n: table(spark, d, n) for n in ("experiments", "experiment_events", "budget_snapshots")}
    out = spark.createDataFrame([], "name string, rows long")
    for name, path in export.course_export(spark, given, f"file://{at}").items():
        held = spark.read.csv(path, header=True) if name.endswith("_csv") else spark.read.text(path)
        out = out.unionByName(held.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return out


def resumed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents ingested in batches up to a number of tokens, stopped after the first batch and gone on with."""
    at = _place(spark, "ingest")
    rows = table(spark, d, "documents").select("doc_id", "text")
    numbered = rows.join(ordinals(rows.select("doc_id"), ["doc_id"]), "doc_id")
    for most in (1, None):
        resume.ingest(numbered, at, {"location": d}, token_estimate(F.col("text")), batch=400, max_tokens=INGEST, most_batches=most)
    return resume.ingested(numbered, at).select("doc_id", F.char_length("text").alias("chars"))


def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ledger tables saved as one snapshot and restored: every row of each, its columns as one text."""
    at = _place(spark, "snapshot")
    tables.save_tables({n: table(spark, d, n) for n in _TEXTS}, at)
    back = tables.load_tables(spark, at, set(_TEXTS))
    out = spark.createDataFrame([], "name string, key string, content string")
    for name, (key, columns) in _TEXTS.items():
        content = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        out = out.unionByName(back[name].select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key"), content.alias("content")))
    return out


def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole build from JSON lines to shards: tokens per split and source, under the word-length tokenizer."""
    out = _place(spark, "corpus")
    got = pipeline.prepare(spark, _written(spark, d), out, tokens.word_lengths, 0, text_field="body", min_chars=corpus.MIN_CHARS, max_chars=corpus.MAX_CHARS, validation_rate=corpus.RATE, buckets=corpus.BUCKETS, shard_tokens=SHARD)
    rows = [(split, s, n) for split, x in got["splits"].items() for s, n in x["source_token_counts"].items()]
    return spark.createDataFrame(rows, "split string, source string, tokens long")


QUERIES = {f.__name__: f for f in (jsonl_round_trip, shard_round_trip, token_positions, index_summaries, corpus_shuffle, ledger_export, export_counts, resumed_ingest, snapshot_round_trip, corpus_build)}

#: Columns of the CSV of experiments that the table has, and where.
_EXPORTED = [(c, {"provider_logs_uri": "provider_artifacts.logs_uri", "provider_detail_uri": "provider_artifacts.detail_uri", "parameter_count_estimate": "resolved_config.parameter_count_estimate", "total_optimizer_steps": "resolved_config.total_optimizer_steps"}.get(c, c)) for c in export.COLUMNS["experiments"] if c not in ("final_validation_loss", "staff_failure_detail")]
_HELD = {n: f"(select count(*) from {n})" for n in ("experiments", "experiment_events", "budget_snapshots")} | {"worker_events": "(select count(*) from experiment_events)"}
_COUNTS = [(f"{n}_jsonl", _HELD.get(n, "0")) for n in export.TABLES] + [(f"{n}_csv", _HELD.get(n, "0")) for n in export.COLUMNS]

_COUNTED = f"len(list_filter(string_split({collapsed('cleaned')}, ' '), lambda w: w <> '')) + 1"

#: Chunks of each split's shards in the stride order, joined with the tokens they hold.
_REORDERED = f"""
with r as (select coalesce(split, 'train') as split, record_id, {corpus._REC} as source, {corpus._TOKENS} as t from processed_records where text is not null),
s as (select *, coalesce(sum(len(t)) over (partition by split order by record_id rows between unbounded preceding and 1 preceding), 0) as start from r),
p as (select split, source, cast(start + i as bigint) as position, t[i + 1] as token from (select *, unnest(range(len(t))) as i from s)),
q as (select split, position // {SHARD} as shard, source, count(*) as tokens from p group by 1, 2, 3),
f as (select *, min(shard) over (partition by split, source) as first from q),
g as (select *, cast(coalesce(sum(tokens) over (partition by split, shard order by first, source rows between unbounded preceding and 1 preceding), 0) as bigint) as start from f),
k as (select *, unnest(range((tokens - 1) // {corpus.CHUNK} + 1)) as chunk from g),
u as (select split, shard, source, start + chunk * {corpus.CHUNK} as off, least({corpus.CHUNK}, tokens - chunk * {corpus.CHUNK}) as n from k),
h as (select *, sha256(concat_ws(chr(0), '{corpus.SEED}', source, cast(shard as varchar), cast(off as varchar))) as h from u),
b as (select *, coalesce(sum(n) over (partition by split, source order by h rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by split, source) as whole from h),
w as (select split, shard * {SHARD} + off as old, n, cast(coalesce(sum(n) over (partition by split order by cast(2 * before + n as double) / cast(2 * whole as double), h rows between unbounded preceding and 1 preceding), 0) as bigint) as new from b)
select p.split, new + position - old as position, token from p join w on p.split = w.split and position >= old and position < old + n"""

#: The columns of a snapshot's tables as one text, null as nothing.
_TEXTS = {
    "budget_snapshots": ("student_id", ["total_seconds", "reserved_seconds", "charged_seconds", "remaining_seconds"]),
    "experiments": ("experiment_id", ["student_id", "status", "failure_reason", "used_runtime_seconds", "completed_at", "failed_at", "config_hash", "provider_job_id", "resolved_config.total_optimizer_steps"]),
    "resume_snapshots": ("snapshot_id", ["download_id", "logical_source_id", "status", "scanned_documents", "written_documents", "estimated_tokens", "stop_reason"]),
}

SQL = {
    "jsonl_round_trip": "select record_id, text, row_number() over (order by file_idx, line_no) - 1 as ordinal from raw_records",
    "shard_round_trip": corpus._STREAMS + " select split, position, token from l",
    "corpus_shuffle": _REORDERED,
    "token_positions": corpus._STREAMS.replace("from processed_records)", "from processed_records where text is not null)")
    + ", e as (select distinct split, unnest([cast(start as bigint), cast(start + len(t) - 1 as bigint)]) as position from s) select split, position, token from e join l using (split, position)",
    "index_summaries": corpus._STREAMS.replace("from processed_records)", "from processed_records where text is not null)")
    + f""", n as (select split, count(*) as tokens from l group by 1), c as (select coalesce(split, 'train') as split, count(distinct {corpus._REC}) as sources from processed_records where text is not null group by 1)
select split, (tokens + {SHARD - 1}) // {SHARD} as shards, tokens, sources, least(tokens, {SHARD}) as largest_shard from n join c using (split)""",
    "ledger_export": "select "
    + ", ".join(f"coalesce(cast({c} as varchar), '') as {n}" for n, c in _EXPORTED)
    + ", '' as staff_failure_detail, cast(final_validation_loss is not null as varchar) as has_loss from experiments",
    "export_counts": " union all ".join(f"select '{n}' as name, {c} as rows" for n, c in _COUNTS),
    "resumed_ingest": f"""
with e as (select doc_id, length(text) as chars, coalesce(sum({corpus._EST}) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
select doc_id, chars from e where before < {INGEST}""",
    "snapshot_round_trip": " union all ".join(f"select '{n}' as name, cast({k} as varchar) as key, concat_ws('|', {', '.join(f"coalesce(cast({c} as varchar), '')" for c in cs)}) as content from {n}" for n, (k, cs) in _TEXTS.items()),
    "corpus_build": corpus._JUDGED + f" select outcome as split, {corpus._REC} as source, cast(sum({_COUNTED}) as bigint) as tokens from j where outcome in ('train', 'validation') group by 1, 2",
}
