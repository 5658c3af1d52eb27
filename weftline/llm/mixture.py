"""A mixture in which each source takes its share of the tokens.

Every document of a source expects the same number of copies: the source's target over its tokens, capped at the most
repeats allowed.  Systematic sampling makes whole copies of that: expected copies are summed along a hashed order of the
source's documents, one random offset is added, and a document is emitted once for each whole number its step crosses.
So every document gets the floor or the ceiling of its expectation, and a source's count is exact to one document.

The prefix sum is two-phase: documents fall into hashed buckets, the buckets' counts give each bucket its start, and only
inside a bucket rows are numbered.  A source with most of the corpus is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.budget import Estimate, Tokenizer, counted, source_of
from weftline.scratch import cut

BUCKETS = 4096


def _offset(seed: int):
    """The one random offset of a source, in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source"), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def mixture(documents: DataFrame, plan: DataFrame, seed: int = 17, total: int | None = None, tokenizer: Tokenizer | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(draws, plan): draws has (doc_id, source, tokens, copies) of documents that appear at least once; the plan has each
    enabled train row with its source's tokens, target and expected copies.

    ``plan`` needs id, weight, max_repeats, split, enabled.  ``total`` is the size aimed at, by default all tokens of the
    planned sources.  Weights are taken as they are; a null weight is 0, a null max_repeats no limit, a null enabled true.
    Sources are compared trimmed and lower-cased; documents of other sources are left out.  Null texts count one token; rows without doc_id are left out.
    """
    rows = counted(documents.where("doc_id is not null").select("doc_id", "text", source_of(F.col("source")).alias("source")), tokenizer or Estimate(), keep=("source",))
    sized = cut(rows.where("source is not null").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int")), "sized")
    wanted = plan.where("split = 'train' and coalesce(enabled, true)").select(source_of(F.col("id")).alias("source"), "id", F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), "max_repeats")
    counts = sized.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    held = counts.groupBy("source").agg(F.sum("t").alias("source_tokens"), F.sum("n").alias("source_documents"))
    planned = wanted.join(held, "source", "left").fillna(0, ["source_tokens", "source_documents"])
    planned = planned.withColumn("total", F.lit(total) if total is not None else F.sum("source_tokens").over(Window.partitionBy(F.lit(1))))
    planned = planned.withColumn("target", F.col("weight") * F.col("total"))
    expected = F.when(F.col("source_tokens") > 0, F.least(F.col("target") / F.col("source_tokens"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))).otherwise(0.0)
    planned = planned.withColumn("expected", expected)
    starts = counts.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("start"))
    steps = starts.join(planned.select("source", "expected"), "source")
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id"))
    numbered = sized.select("doc_id", "source", "tokens", "bucket", nth.alias("nth")).join(steps, ["source", "bucket"])
    upto = F.col("start") + F.col("nth")
    crossed = F.floor(_offset(seed) + F.col("expected") * upto) - F.floor(_offset(seed) + F.col("expected") * (upto - 1))
    most = F.ceil("expected")
    draws = numbered.select("doc_id", "source", "tokens", F.least(crossed, most).alias("copies")).where("copies > 0")
    return draws, planned


def report(draws: DataFrame, planned: DataFrame) -> DataFrame:
    """Each planned source with what it got: documents, copies, tokens, the share aimed at and reached, and whether every
    document was used as often as allowed and the target is still missed."""
    got = draws.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    rows = planned.join(got, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    used_up = (F.col("tokens") == F.col("source_tokens") * F.coalesce("max_repeats", F.lit(0))) & F.col("max_repeats").isNotNull()
    return rows.select("id", "weight", "max_repeats", "source_documents", "source_tokens", "target", "documents", "copies", "tokens", share.alias("share"), (used_up & (F.col("tokens") < F.col("target"))).alias("short"))
