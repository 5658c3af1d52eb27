"""The corpus build end to end: raw JSON lines to audited token shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import normal_source
from weftline.operators import postprocess, shuffle, tokens
from weftline.operators.prefix import ordinals
from weftline.scratch import cut
from weftline.sources import jsonl, shards, tables

SPLITS = ("train", "validation")


def prepare(
    spark: SparkSession,
    raw: str,
    out: str,
    load: Callable[[], Callable[[list[str]], list[list[int]]]],
    eos: int,
    *,
    text_field: str = "text",
    min_chars: int = 200,
    max_chars: int | None = None,
    validation_rate: float = 0.001,
    seed: int = 20260724,
    buckets: int = shuffle.BUCKETS,
    shard_tokens: int = 100_000_000,
    limits: dict[str, int] | None = None,
    tokenizer: str = "",
) -> dict:
    """Clean, deduplicate, split, shuffle, tokenize, cap and write shards; gives the manifest, also written to ``out``.

    A run whose inputs, settings and ``tokenizer`` (the name by which ``load`` is told from others; by default that of the
    function) equal those of the manifest found there is not repeated, if every shard it wrote is still there and whole.
    """
    named = tokenizer or f"{getattr(load, '__module__', '')}:{getattr(load, '__qualname__', repr(load))}"
    settings = {"text_field": text_field, "min_chars": min_chars, "max_chars": max_chars, "validation_rate": validation_rate, "seed": seed, "buckets": buckets, "shard_tokens": shard_tokens, "limits": limits, "eos": eos, "tokenizer": named}
    print_ = tables.fingerprint(spark, raw, **settings)
    try:
        before = tables.load_json(f"{out}/manifest.json")
        if before.get("fingerprint") == print_ and all(shards.load_index(f"{out}/{s}/index.json")["total_tokens"] == before["splits"][s]["total_tokens"] for s in SPLITS):
            return before
    except (FileNotFoundError, KeyError, shards.IndexError_):
        pass
    records = jsonl.raw_records(spark, raw, text_field)
    order = ["file_idx", "line_no"]
    counters = postprocess.statistics(postprocess.reasons(records, order, min_chars, max_chars, validation_rate)).first().asDict()
    kept = cut(postprocess.processed(records, order, min_chars, max_chars, validation_rate), "processed")
    return _written(spark, kept, order, out, load, eos, seed, buckets, shard_tokens, limits, {"fingerprint": print_, "settings": settings, "statistics": counters, "splits": {}})


def rebuild(
    spark: SparkSession,
    processed: str,
    out: str,
    load: Callable[[], Callable[[list[str]], list[list[int]]]],
    eos: int,
    *,
    seed: int = 20260724,
    buckets: int = shuffle.BUCKETS,
    shard_tokens: int = 100_000_000,
    limits: dict[str, int] | None = None,
) -> dict:
    """The stages after cleaning, from a folder of processed records (train and validation files of JSON lines); always anew.

    Records keep their order within a split, their source and, where they have one, their hash.
    """
    value = F.col("value")
    kept = cut(jsonl.split_records(spark, processed, list(SPLITS)).select("split", "line_no", *[jsonl.text_of(value, c).alias(c) for c in ("text", "source_id", "document_hash")]), "processed")
    return _written(spark, kept, ["line_no"], out, load, eos, seed, buckets, shard_tokens, limits, {"settings": {"processed": processed, "seed": seed, "buckets": buckets, "shard_tokens": shard_tokens, "limits": limits, "eos": eos}, "splits": {}})


def _written(spark: SparkSession, kept: DataFrame, order: list[str], out: str, load: Callable, eos: int, seed: int, buckets: int, shard_tokens: int, limits: dict[str, int] | None, manifest: dict) -> dict:
    """Shuffle, tokenize, cap and write the splits of processed records, then the manifest."""
    numbered = kept.join(ordinals(kept.select("split", *order), order, "ordinal", ["split"]), ["split", *order])
    keyed = shuffle.keyed(numbered, seed, buckets)
    encoded = tokens.encode(keyed.select("split", "bucket_key", "key", normal_source(F.col("source_id"), "unknown").alias("source_id"), "text"), load, eos)
    encoded = cut(encoded, "tokens")
    place = ["bucket_key", "key"]
    for split in SPLITS:
        rows = encoded.where(F.col("split") == split)
        if split == "train" and limits:
            caps = spark.createDataFrame(list(limits.items()), "source string, most long")
            taken = tokens.capped(rows.withColumn("n", F.size("tokens").cast("long")), caps, place)
            rows = rows.join(taken.select(*place), place, "left_semi")
        index = shards.write_shards(rows.select("source_id", *place, "tokens"), place, f"{out}/{split}", shard_tokens)
        shards.load_index(f"{out}/{split}/index.json")
        manifest["splits"][split] = {"index": f"{split}/index.json", "total_tokens": index["total_tokens"], "source_token_counts": index["source_token_counts"], "shards": len(index["shards"])}
    tables.write_json(f"{out}/manifest.json", manifest)
    return manifest
