"""Text: cleaning, hashing, splitting, words.

The pure functions take and give Python values and are the one definition of the semantics; the column functions apply
them through Arrow, except where built-in expressions say exactly the same.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")
#: Han characters: the script's blocks that hold letters, ideographic zero and iteration mark included.
HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎\U00020000-\U000323af"
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_ALNUM = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    """HTML entities resolved, NFKC, NUL as a blank, white space collapsed and stripped."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _SPACE.sub(" ", text.replace("\0", " ")).strip()


#: Lower-cases letters and digits of ASCII and turns all else into blanks.
_ASCII = str.maketrans({c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})


def words(text: str) -> list[str]:
    """Words of the cleaned, lower-cased text: runs of letters and digits; each Han character alone.

    White space need not be collapsed for that: any of it ends a word.
    """
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.translate(_ASCII).split()
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def alnum(text: str) -> str:
    """Letters and digits of the text as it stands, lower-cased, all else dropped."""
    return "".join(_ALNUM.findall(text.lower()))


class WordHashes:
    """64-bit hashes of words, with a cache of bounded size: a vocabulary has no end, memory has."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in set(found):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive items, in order; empty if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = mix(total + hashes[i : i + count] + np.uint64(i + 1))
    return total


@F.pandas_udf(T.StringType())
def _clean_udf(texts: pd.Series) -> pd.Series:
    return texts.map(clean, na_action="ignore")


#: White space as Python's ``\s`` has it.
SPACE_CLASS = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def clean_text(text: Column) -> Column:
    """Cleaned text; null stays null."""
    return _clean_udf(text)


def collapse_space(text: Column) -> Column:
    """The part of cleaning that built-in expressions can say: white space only, for text known to hold no entity and only NFKC forms."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\x00", " "), SPACE_CLASS, " "))


def document_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def hash_fraction(digest: Column) -> Column:
    """The first 64 bits of a hex digest as a fraction of the largest 64-bit number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551615.0)


def split_of(digest: Column, validation_rate: float) -> Column:
    """``train`` or ``validation`` by hash; a rate of 0 or 1 decides alone."""
    if not 0 <= validation_rate <= 1:
        raise ValueError("validation_rate must be in [0, 1]")
    if validation_rate in (0, 1):
        return F.lit("validation" if validation_rate else "train")
    return F.when(hash_fraction(digest) < validation_rate, "validation").otherwise("train")


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    """max(1, whole tokens by length)."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(text) / F.lit(float(chars_per_token))))


def normal_source(source: Column, blank: str | None = None) -> Column:
    """Trimmed; null and blank become ``blank``."""
    trimmed = F.nullif(F.trim(source), F.lit(""))
    return trimmed if blank is None else F.coalesce(trimmed, F.lit(blank))


def normal_split(split: Column, known: tuple[str, ...] = ("train", "validation", "test")) -> Column:
    """Trimmed and lower-cased; anything but a known split becomes train."""
    found = F.lower(F.trim(split))
    return F.when(found.isin(*known), found).otherwise("train")


def is_hex_digest(digest: Column) -> Column:
    """Exactly 64 hex digits, any case."""
    return F.coalesce(digest.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where it was cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


#: What must not leave in a failure text, in order, with what stands for it. Fixed values.
REDACTIONS = [
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted-api-key]"),
    (r"(?i)\b(token|secret|password|cookie)=([^\s;]+)", "$1=[redacted]"),
    (r"/(?:secure|mnt/course-data|course-data|private)(?:/[^\s'\"<>)]*)?", "[private-path]"),
    (r"\b(?:api|backend)\.internal\b", "[internal-host]"),
    (r"\b(?:provider-)?job-[0-9a-fA-F-]{8,}\b", "[provider-job]"),
]


def redact(text: Column, most: int = 4000) -> Column:
    """Secrets, private paths, hosts and job ids replaced; lines stripped at their end, blank ones dropped; cut at ``most``."""
    text = F.coalesce(F.regexp_replace(text, "\\x00", ""), F.lit(""))
    for pattern, instead in REDACTIONS:
        text = F.regexp_replace(text, pattern, instead)
    lines = F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda line: F.regexp_replace(line, SPACE_CLASS + "$", ""))
    text = F.regexp_replace(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), "^" + SPACE_CLASS, "")
    return F.when(F.char_length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 3), SPACE_CLASS + "$", ""), F.lit("..."))).otherwise(text)


#: What the tail of a failed worker's log holds, in any letter case: one of two texts anywhere, or a line with an exception's name and a colon. Fixed values.
TRACEBACK_TEXTS = ("traceback (most recent call last):", "worker failed for ")
TRACEBACK_NAME = r"(?i)\b[a-z_][a-z0-9_.]*(error|exception):"


def looks_like_traceback(text: Column) -> Column:
    """Whether a log's tail shows a failure of the worker's own code; null shows none."""
    low = F.lower(text)
    found = text.rlike(TRACEBACK_NAME)
    for known in TRACEBACK_TEXTS:
        found = found | F.contains(low, F.lit(known))
    return F.coalesce(found, F.lit(False))


@F.pandas_udf(T.StringType())
def _canonical_hash(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: None if d is None else hashlib.sha256(json.dumps(json.loads(d), sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def canonical_hash(document: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and without blanks; the order of its keys does not count."""
    return _canonical_hash(document)


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def number_in(text: Column) -> Column:
    """The first run of digits as a number; null without one."""
    return F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("long")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))


def safe_id(text: Column) -> Column:
    """Whether a run id or relative path names nothing outside its folder."""
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._/-]*\z") & ~text.rlike(r"(^|/)\.\.?(/|$)"), F.lit(False))


def finite(x: Column) -> Column:
    """The number, or null where it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
