"""Tokens of documents: encoding, caps, addresses in shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import collapse_space
from weftline.operators.prefix import prefix_sum
from weftline.scratch import cut


def word_length_tokens(text: Column, eos: int = 0) -> Column:
    """The test tokenizer in built-in expressions: the length of each word, and the end token."""
    words = F.filter(F.split(collapse_space(text), " "), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.char_length(w).cast("long")), F.array(F.lit(eos).cast("long")))


def word_lengths() -> Callable[[list[str]], list[list[int]]]:
    """The test tokenizer as a loader for ``encode``."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def encode(documents: DataFrame, load: Callable[[], Callable[[list[str]], list[list[int]]]], eos: int, text: str = "text") -> DataFrame:
    """``documents`` with tokens (array of longs, the end token last) in place of text; null and empty texts are skipped.

    ``load`` is called once a task and gives a function from texts to their ids; it sees whole batches.
    """
    from pyspark.sql import types as T

    kept = [f for f in documents.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = load()
        for pdf in batches:
            out = pdf.drop(columns=text)
            out["tokens"] = [np.array([*ids, eos], np.int64) for ids in tokenize(pdf[text].tolist())] if len(pdf) else []
            yield out

    schema = T.StructType([*kept, T.StructField("tokens", T.ArrayType(T.LongType()))])
    return documents.where(F.col(text) != "").mapInPandas(run, schema)


def capped(documents: DataFrame, limits: DataFrame, order: list[str], source: str = "source_id", tokens: str = "n") -> DataFrame:
    """Rows (source, *order, tokens) that greedy caps accept: in order, a document is taken if it still fits under its source's
    limit, else skipped, and later, smaller ones are tried.  Sources without a limit are taken whole.

    Everything before a source's first document that does not fit is taken by a parallel prefix sum.  After it each decision
    depends on all before it; only the documents no larger than what is left then go on, as narrow rows sorted with spill and
    folded in constant memory.  ``limits`` has (source, most); ``order`` is unique within a source.
    """
    rows = cut(documents.select(source, *order, tokens), "counted")  # sizing a document costs more than reading its size again
    named = limits.select(F.col("source").alias(source), "most")
    joined = rows.join(named, source, "left")
    free = joined.where("most is null").select(source, *order, tokens)
    summed = prefix_sum(joined.where("most is not null"), order, tokens, "_before", [source]).join(named, source)
    over = summed.where(F.col("_before") + F.col(tokens) > F.col("most"))
    first = over.groupBy(source).agg(F.min(F.struct(*order)).alias("_first"), F.min_by("_before", F.struct(*order)).alias("_used"))
    judged = summed.join(first, source, "left")
    taken = judged.where(F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).select(source, *order, tokens)
    later = judged.where((F.struct(*order) > F.col("_first")) & (F.col(tokens) <= F.col("most") - F.col("_used"))).select(source, *order, tokens, (F.col("most") - F.col("_used")).alias("most"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0
        for pdf in batches:
            take = []
            for name, n, most in zip(pdf[source], pdf[tokens], pdf["most"]):
                if name != at:
                    at, used = name, 0
                fits = used + n <= most
                used += n if fits else 0
                take.append(fits)
            yield pdf[np.array(take, bool)].drop(columns="most")

    held = later.repartition(source).sortWithinPartitions(source, *order)
    return free.unionByName(taken).unionByName(held.mapInPandas(fold, taken.schema))


def shard_pieces(addressed: DataFrame, size: int, start: str = "start", tokens: str = "n") -> DataFrame:
    """One row for each shard a document touches: shard, from (offset in the document), taken, and the place in the shard.

    Shards are ``size`` tokens long, so the overlap with them is arithmetic, not a join.  Documents without tokens vanish.
    """
    s, n = F.col(start), F.col(tokens)
    rows = addressed.where(n > 0).withColumn("shard", F.explode(F.sequence(F.floor(s / size), F.floor((s + n - 1) / size))))
    low = F.greatest(s, F.col("shard") * size)
    high = F.least(s + n, (F.col("shard") + 1) * size)
    return rows.withColumn("from", low - s).withColumn("taken", high - low).withColumn("place", low - F.col("shard") * size)


def locate(positions: DataFrame, shards: DataFrame, position: str = "position", width: int | None = None) -> DataFrame:
    """Range join: each position with the shard (path, offset, tokens) that holds it and its place there.

    Positions and shards meet on blocks of ``width`` positions, an equi-join that spreads both sides, whatever their size;
    a shard appears in every block it touches.  Positions outside all shards are dropped.
    """
    width = width or int(shards.agg(F.max("tokens")).first()[0] or 1)
    spread = shards.withColumn("_block", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("tokens") - 1) / width))))
    met = positions.withColumn("_block", F.floor(F.col(position) / width)).join(spread, "_block")
    inside = (F.col(position) >= F.col("offset")) & (F.col(position) < F.col("offset") + F.col("tokens"))
    return met.where(inside).withColumn("place", F.col(position) - F.col("offset")).drop("_block")
