"""Training sequences over the token address space.

Documents stay arrays of tokens with a start address; sequences are cut from them by arithmetic, as shards are.  Only where a
document or a sequence ends is the next one's first token needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_next(documents: DataFrame, by: list[str] | None = None, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """``documents`` that hold tokens, with next: the first token after the document within ``by``, null after the last one.

    A document's end is the start of the next one that holds tokens, so the neighbour comes from an equi-join of addresses
    with one token a row, not from a window over the stream.
    """
    by = by or []
    held = documents.where(F.size(tokens) > 0).withColumn("_at", F.col(start) + F.size(tokens))
    firsts = held.select(*by, F.col(start).alias("_at"), F.element_at(tokens, 1).alias("next"))
    return held.join(firsts, [*by, "_at"], "left").drop("_at")


def labelled(documents: DataFrame, by: list[str] | None = None, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """(*by, position, token, label): every token of documents with their start addresses; the label is the next token within
    ``by``, null after the last one."""
    by = by or []
    rows = with_next(documents, by, tokens, start)
    ahead = F.concat(F.slice(tokens, F.lit(2), F.size(tokens)), F.array("next"))
    pairs = rows.select(*by, F.col(start).alias("_s"), F.posexplode(F.arrays_zip(F.col(tokens).alias("token"), ahead.alias("label"))).alias("_k", "_t"))
    return pairs.select(*by, (F.col("_s") + F.col("_k")).alias("position"), F.col("_t")["token"].alias("token"), F.col("_t")["label"].alias("label"))


def packed(documents: DataFrame, length: int, first: int = 0, last: int | None = None, by: list[str] | None = None, tokens: str = "tokens", start: str = "start") -> DataFrame:
    """(*by, sequence, input_ids, labels): whole sequences of ``length`` tokens of [first, last) within ``by``, each with the
    token after every one of its tokens; what is left is left out.

    A sequence is made of slices: ``length`` tokens and one more, which the sequence after it begins with.
    """
    by = by or []
    s, n, at = F.col(start) - first, F.size(tokens).cast("long"), F.col("sequence") * length
    most = F.floor((s + n - 1) / length)
    if last is not None:
        most = F.least(most, F.lit((last - first) // length - 1))
    least = F.greatest(F.lit(0).cast("long"), F.floor((s - 1) / length))
    rows = documents.where((n > 0) & (most >= least)).withColumn("sequence", F.explode(F.sequence(least, most)))
    low, high = F.greatest(s, at), F.least(s + n, at + length + 1)
    slices = rows.where(high > low).select(*by, "sequence", F.struct(low.alias("low"), F.slice(tokens, (low - s + 1).cast("int"), (high - low).cast("int")).alias("part")).alias("piece"))
    held = slices.groupBy(*by, "sequence").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["part"])).alias("_t"))
    return held.where(F.size("_t") == length + 1).select(*by, "sequence", F.slice("_t", 1, length).alias("input_ids"), F.slice("_t", 2, length).alias("labels"))


def permutation(sequences: int, seed: int, chunk: int) -> list[int]:
    """The order in which a chunk's sequences are fed: numpy's generator seeded with the sum."""
    return np.random.default_rng(seed + chunk).permutation(np.arange(sequences, dtype=np.int64)).tolist()


def largest_token(documents: DataFrame, by: list[str] | None = None, tokens: Column | str = "tokens") -> DataFrame:
    """The largest id among tokens and labels, which are tokens too: one row, or one for each ``by``."""
    return documents.groupBy(*(by or [])).agg(F.max(F.array_max(tokens)).alias("largest"))
