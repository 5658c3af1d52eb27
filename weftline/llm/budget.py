"""Tokens of documents under an existing tokenizer, summed by slice.

Only documents above ``most_chars`` are cut, and only where the tokenizer provably starts anew, so the counts of the
pieces add up exactly to the count of the whole; pieces are spread over all tasks by a salt.  Documents of ordinary size
are counted where they are read and never move.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.scratch import cut

MOST_CHARS = 1 << 16


class Tokenizer:
    """Counts tokens of a piece, and knows where a text may be cut.

    ``cuts(text, size)`` gives positions at which pieces end, each piece about ``size`` characters; where no proven
    boundary follows, the piece grows until one does.  ``total`` makes a document's count of the sum of its pieces.
    """

    #: Matches where a cut may be made: at the end of the match's first character.
    boundary: re.Pattern | None = None

    def count(self, texts: list[str]) -> list[int]:
        raise NotImplementedError

    def column(self, text: Column) -> Column:
        """The sum for an uncut text."""
        tokenizer = self

        @F.pandas_udf("long")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(tokenizer.count(["" if t is None else t for t in s]), dtype="int64")

        return counted(text)

    def total(self, summed: Column) -> Column:
        return summed

    def cuts(self, text: str, size: int) -> list[int]:
        ends, at = [], size
        while at < len(text):
            m = self.boundary.search(text, at - 1)
            if not m:
                break
            ends.append(m.start() + 1)
            at = ends[-1] + size
        return ends


class Estimate(Tokenizer):
    """max(1, floor(characters / 4)): additive at every multiple of four characters; the floor of one is a whole document's."""

    def __init__(self, chars: int = 4) -> None:
        self.chars = chars

    def count(self, texts: list[str]) -> list[int]:
        return [len(t) // self.chars for t in texts]

    def column(self, text: Column) -> Column:
        return F.floor(F.char_length(text) / F.lit(self.chars))

    def total(self, summed: Column) -> Column:
        return F.greatest(summed, F.lit(1).cast("long"))

    def cuts(self, text: str, size: int) -> list[int]:
        step = max(self.chars, size - size % self.chars)
        return list(range(step, len(text), step))


class Whitespace(Tokenizer):
    """One token a word of the text split at white space, and one more a document: additive between a word and the white space after it."""

    boundary = re.compile(r"\S(?=\s)")

    def count(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]

    def total(self, summed: Column) -> Column:
        return summed + 1


#: White space as tokenizers have it: Python's without U+001C to U+001F.
_BLANK = r"[^\S\x1c-\x1f]"


class BytePairs(Tokenizer):
    """Byte-level BPE from a rank file.

    The pattern that splits text before the merges has no match that holds a non-space followed by white space, looks
    ahead only inside white space and never back; so a text may be cut after any character that is followed by white space.  A letter followed by a mark of punctuation (an apostrophe aside) ends a
    match too; both kinds are used, the second for scripts without blanks.
    """

    boundary = re.compile(rf"\S(?={_BLANK})|[^\W\d_](?=[.,!?;:。，！？；：、])")

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    def count(self, texts: list[str]) -> list[int]:
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(self._encoding.encode_ordinary(t)) for t in texts]


#: The split pattern of the byte-level rank files. Fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordPairs(Tokenizer):
    """A tokenizers file that drops white space and never joins words across it."""

    boundary = re.compile(rf"\S(?={_BLANK})")

    def __init__(self, path: str) -> None:
        self.path, self._tokenizer = path, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tokenizer": None}

    def count(self, texts: list[str]) -> list[int]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer as Files

            self._tokenizer = Files.from_file(self.path)
            self._tokenizer.encode_special_tokens = True
        return [len(e.ids) for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]


def counted(documents: DataFrame, tokenizer: Tokenizer, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), most_chars: int = MOST_CHARS, salts: int = 1024) -> DataFrame:
    """(id, *keep, tokens): each document with its exact number of tokens.

    A null text counts as an empty one.  A row repeated with its id is counted again if it is not cut, and its pieces are
    added up if it is; ids are expected to be unique.  An empty table gives an empty result.

    Documents are read once: that pass counts the ordinary ones and cuts the oversized, and what it writes, the counts and
    the pieces, is read by the two branches after it.
    """
    head = F.struct(F.col(id).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = documents.select(head.alias("head"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.char_length("text")

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            ends = [*tokenizer.cuts(t, most_chars), len(t)]
            out.append([t[a:b] for a, b in zip([0, *ends], ends)])
        return pd.Series(out, dtype=object)

    ordinary = F.when(size <= most_chars, F.col("text"))  # nulls cost the tokenizer nothing
    seen = cut(rows.select("head", F.when(size <= most_chars, tokenizer.column(ordinary)).alias("n"), cut_up(F.when(size > most_chars, F.col("text"))).alias("pieces")), "counted")
    whole = seen.where("n is not null").select("head", "n")
    pieces = seen.where("n is null").select("head", F.posexplode("pieces").alias("part", "text"))
    spread = pieces.withColumn("salt", F.pmod(F.xxhash64("head", "part"), F.lit(salts))).repartition("salt")
    summed = spread.select("head", tokenizer.column(F.col("text")).alias("n")).groupBy("head").agg(F.sum("n").alias("n"))
    both = whole.unionByName(summed)
    return both.select(F.col("head.id").alias(id), *[F.col(f"head.k{i}").alias(c) for i, c in enumerate(keep)], tokenizer.total(F.col("n")).alias("tokens"))


def source_of(source: Column) -> Column:
    """Trimmed and lower-cased; blank is no source."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def language_of(lang: Column) -> Column:
    """Lower-cased, without region; blank is none."""
    return F.nullif(F.substring_index(F.substring_index(F.lower(F.trim(lang)), "-", 1), "_", 1), F.lit(""))


def domain_of(domain: Column) -> Column:
    """Lower-cased host, without scheme, www. and path; blank is none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z]+://", ""), r"^www\.|/.*$", ""), F.lit(""))


def by_slice(documents: DataFrame, tokenizer: Tokenizer, **options: int) -> DataFrame:
    """(source, language, domain, documents, tokens): what each slice holds; missing parts of a slice's name are null."""
    named = documents.select("doc_id", "text", source_of(F.col("source")).alias("source"), language_of(F.col("lang")).alias("language"), domain_of(F.col("domain")).alias("domain"))
    return counted(named, tokenizer, keep=("source", "language", "domain"), **options).groupBy("source", "language", "domain").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def off_snapshots(documents: DataFrame, snapshots: DataFrame, share: float = 0.02, tokenizer: Callable[[], Tokenizer] = Estimate) -> DataFrame:
    """(download_id, recorded, tokens) of downloads whose latest snapshot is more than ``share`` of the true total off.

    The latest has the greatest updated_at; of copies of it the greatest snapshot_id counts.  A download without documents
    has a true total of 0; a null estimate counts as off; snapshots without download_id or updated_at are left out.
    """
    true = counted(documents.select("doc_id", "text", "download_id"), tokenizer(), keep=("download_id",)).groupBy("download_id").agg(F.sum("tokens").alias("tokens"))
    latest = snapshots.where("download_id is not null and updated_at is not null").groupBy("download_id").agg(F.max_by("estimated_tokens", F.struct("updated_at", "snapshot_id")).alias("recorded"))
    joined = latest.join(true, "download_id", "left").select("download_id", "recorded", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))
    return joined.where(F.col("recorded").isNull() | (F.abs(F.col("recorded") - F.col("tokens")) > F.lit(share) * F.col("tokens")))
