"""Queries on training data by name, with the SQL they must equal where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import budget, formatting, leakage, mixture, neardup, overlap, prose, spans, sqltext

#: Where the public tokenizers' files lie.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every source but code that are for the most part list, table or junk."""
    documents = _table(spark, d, "documents").where("lower(trim(coalesce(source, ''))) <> 'code'")
    return prose.not_prose(documents, _table(spark, d, "common_words")).select("doc_id")


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each document, shares rounded (a little is added, so that both sides round ties alike)."""
    found = prose.statistics(_table(spark, d, "documents"), _table(spark, d, "common_words"))
    shares = ("mean_word_length", "symbol_ratio", "ending_lines", "common_words")
    return found.select("doc_id", "chars", "words", "lines", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in shares])


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prose, list, table and junk in each document."""
    return prose.statistics(_table(spark, d, "documents"), _table(spark, d, "common_words")).select("doc_id", *prose.KINDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that are versions of one text."""
    found = neardup.classes(_table(spark, d, "documents"), n=3, similarity=0.5)
    return neardup.pairs(found).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class of equal sets of five-word runs, its group of near-duplicates and its class's links."""
    found = neardup.groups(neardup.classes(_table(spark, d, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("group").alias("group_id"), "links")


def _held_out(spark: SparkSession, d: str) -> tuple[DataFrame, overlap.Overlaps]:
    records = _table(spark, d, "processed_records")
    found = overlap.overlaps(records, overlap.bound(0.5), n=3)
    return records, overlap.Overlaps(found.members, found.links.where("jaccard >= 0.5"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """A training record and a held-out record, equal or nearly so."""
    met = overlap.pairs(_held_out(spark, d)[1])
    return met.select(F.least("a", "b").alias("record_id_a"), F.greatest("a", "b").alias("record_id_b"))


def p4_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Held-out records per split and source, and how many of them the training split has."""
    return overlap.by_split_and_source(*_held_out(spark, d))


def p4_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of equal vectors of counted word pairs, and how many classes of the other side have a cosine of 0.8 or more with it."""
    found = overlap.linked(overlap.overlaps(_table(spark, d, "processed_records"), 0.8, n=2, weights="tf"))
    return found.select(F.col("id").alias("record_id"), F.col("class").alias("class_id"), "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every member but the smallest of each group of same records."""
    same = formatting.grouped(_table(spark, d, "raw_records"))
    return same.where("copies > 1 and id <> first").select(F.col("first").alias("first_record_id"), F.col("id").alias("record_id"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group with its number of copies."""
    return formatting.collapsed(_table(spark, d, "raw_records")).select(F.col("id").alias("record_id"), "copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Downloads whose latest snapshot is off."""
    return budget.off_snapshots(_table(spark, d, "documents"), _table(spark, d, "resume_snapshots")).select("download_id")


def p6_slices(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens by source, language and domain."""
    return budget.by_slice(_table(spark, d, "documents"), budget.Estimate())


def p6_byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by source, language and domain under a byte-level BPE vocabulary."""
    return budget.by_slice(_table(spark, d, "documents"), budget.BytePairs(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", budget.BYTE_PATTERN))


def p6_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, and those whose byte-level tokens in pieces of 512 characters do not add up to those of the whole text."""
    documents = _table(spark, d, "documents").withColumn("slice", budget.source_of(F.col("source")))
    tokenizer = budget.BytePairs(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", budget.BYTE_PATTERN)
    whole = budget.counted(documents, tokenizer, keep=("slice",), most_chars=1 << 30)
    pieces = budget.counted(documents, tokenizer, most_chars=512).withColumnRenamed("tokens", "summed")
    return whole.join(pieces, "doc_id").groupBy(F.col("slice").alias("source")).agg(F.count("*").alias("documents"), F.count_if(F.col("tokens") != F.col("summed")).alias("differing"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with twelve successive words of an item, verbatim."""
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")).where("exact_runs > 0").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked verbatim, and into how many documents."""
    met = leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")).where("exact_runs > 0")
    return met.groupBy("item_id").agg(F.count("*").alias("documents"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item only with other numbers, names or units."""
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")).where("exact_runs = 0 and other_runs > 0").select("doc_id", "item_id", "other_runs")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that run out: all their documents used as often as allowed, the target still missed."""
    return mixture.report(*mixture.mixture(_table(spark, d, "documents"), _table(spark, d, "general_100b_mix"))).where("short").select("id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each source with the share it reached."""
    return mixture.report(*mixture.mixture(_table(spark, d, "documents"), _table(spark, d, "general_100b_mix")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with 500 characters or more in common."""
    found, again = spans.spans(_table(spark, d, "documents"))
    return spans.pairs(found, again).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in others."""
    return spans.coverage(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_statistics, p1_labels, p2_found, p2_groups, p4_found, p4_by_split, p4_weighted, p5_found, p5_copies, p6_found, p6_slices, p6_byte_pairs, p6_cuts, p7_found, p7_items, p7_reparameterised, p8_found, p8_shares, p9_found, p9_shared)}

_TOKENS = "greatest(1, length(text) // 4)"

SQL = {
    "p1_statistics": sqltext.P1,
    "p2_found": sqltext.P2,
    "p2_groups": sqltext.P2_GROUPS,
    "p4_found": sqltext.P4,
    "p4_by_split": sqltext.P4_COUNTS,
    "p4_weighted": sqltext.P4_WEIGHTED,
    "p5_found": sqltext.P5,
    "p5_copies": sqltext.P5_COPIES,
    "p7_found": sqltext.P7,
    "p7_items": sqltext.P7_ITEMS,
    "p9_found": sqltext.P9,
    "p9_shared": sqltext.P9_SHARED,
    "p6_found": f"""
with t as (select download_id, sum({_TOKENS}) as tokens from documents group by 1),
l as (select download_id, arg_max(estimated_tokens, updated_at) as recorded from resume_snapshots group by 1)
select l.download_id from l left join t using (download_id) where recorded is null or abs(recorded - coalesce(tokens, 0)) > 0.02 * coalesce(tokens, 0)""",
    "p6_cuts": "select nullif(lower(trim(source)), '') as source, count(*) as documents, 0 as differing from documents group by 1",
    "p6_slices": f"""
select nullif(lower(trim(source)), '') as source,
       nullif(split_part(split_part(lower(trim(lang)), '-', 1), '_', 1), '') as language,
       nullif(regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z]+://', ''), '^www\\.|/.*$', '', 'g'), '') as domain,
       count(*) as documents, cast(sum({_TOKENS}) as bigint) as tokens
from documents group by 1, 2, 3""",
    "p8_found": f"""
with t as (select lower(trim(source)) as source, sum({_TOKENS}) as tokens from documents group by 1),
w as (select g.id, weight, max_repeats, coalesce(tokens, 0) as tokens from general_100b_mix g left join t on t.source = lower(trim(g.id)) where split = 'train' and enabled)
select id from w where weight * (select sum(tokens) from w) > max_repeats * tokens""",
}
