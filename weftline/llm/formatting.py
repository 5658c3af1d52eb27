"""Records that differ only in white space, letter case, punctuation or order of fields.

Each record gets a 128-bit hash of its canonical form.  Tasks build Bloom filters of hashes seen once and seen again;
merged, they tell which records may be repeats.  Only those are shuffled for exact grouping; all others are singletons
where they stand.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.functions.text import alnum
from weftline.operators.spread import spread
from weftline.scratch import cut

#: A line that is a name, ``:`` or ``=``, and a value.
_LINE = re.compile(r"\s*([^\s:=][^:=]*?)\s*[:=]\s*(\S.*)$")


class _Object(list):
    """A JSON object as its pairs: names that come twice stay."""


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"null": None, "true": True, "false": False, "NaN": "NaN", "Infinity": "Infinity", "-Infinity": "-Infinity"}


def _deep(text: str) -> object:
    """What ``_load`` gives, with a stack of its own: for values nested deeper than the json module follows."""

    def skip(at: int) -> int:
        return _BLANK.match(text, at).end()

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError(f"no name at {at}")
        found, at = scanstring(text, at + 1, False)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError(f"no colon at {at}")
        return found, skip(at + 1)

    def scalar(at: int) -> tuple[object, int]:
        if text[at : at + 1] == '"':
            return scanstring(text, at + 1, False)
        for word, value in _WORDS.items():
            if text.startswith(word, at):
                return value, at + len(word)
        if m := _NUMBER.match(text, at):
            return m[0], m.end()
        raise ValueError(f"no value at {at}")

    boxes: list[list] = []
    names: list[str] = []
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            boxes.append(_Object() if c == "{" else [])
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    found, at = name(at)
                    names.append(found)
                continue
            value, at = boxes.pop(), at + 1
        else:
            value, at = scalar(at)
        while boxes:
            box, fields = boxes[-1], isinstance(boxes[-1], _Object)
            box.append((names.pop(), value) if fields else value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if fields:
                    found, at = name(at)
                    names.append(found)
                break
            if c != ("}" if fields else "]"):
                raise ValueError(f"no end at {at}")
            value, at = boxes.pop(), at + 1
        else:
            if skip(at) != len(text):
                raise ValueError(f"more at {at}")
            return value


def _load(text: str) -> object:
    """JSON with objects as pairs and numbers as written."""
    try:
        return json.loads(text, object_pairs_hook=_Object, parse_int=str, parse_float=str, parse_constant=str, strict=False)
    except RecursionError:
        return _deep(text)


def _fields(top: list) -> object:
    """Sorted fields of an object; objects and lists inside stand as hashes of their own form, innermost first, so depth has no limit."""
    order = [top]
    for box in order:
        order += [v for v in ((v for _, v in box) if isinstance(box, _Object) else box) if isinstance(v, list)]
    forms: dict[int, object] = {}

    def form(v: object) -> object:
        if isinstance(v, list):
            return forms.pop(id(v))
        return json.dumps(v) if v is None or isinstance(v, bool) else alnum(str(v))

    for box in reversed(order):
        if isinstance(box, _Object):
            kind, found = "object", sorted(([alnum(k), form(v)] for k, v in box), key=repr)
        else:
            kind, found = "list", [form(v) for v in box]
        if box is top:
            return found
        forms[id(box)] = {kind: hashlib.blake2b(repr(found).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()}


def canonical(text: str | None) -> str | None:
    """What same records have in common; None for texts without a letter or digit.

    A text of fields (one JSON object, or three or more lines of name, ``:`` or ``=``, value) becomes its sorted fields,
    with the order of members ignored at every depth and numbers taken as written; any other text its letters and digits.
    """
    if text is None:
        return None
    plain = alnum(text)
    if not plain:
        return None
    fields = None
    if text.lstrip()[:1] == "{":
        try:
            fields = _fields(_load(text))
        except ValueError:
            fields = None
    if fields is None:
        lines = [line for line in text.splitlines() if line.strip()]
        if len(lines) >= 3:
            found = []
            for line in lines:
                m = _LINE.match(line)
                if not m:
                    break
                found.append([alnum(m[1]), alnum(m[2])])
            else:
                fields = sorted(found, key=repr)
    return "t" + plain if fields is None else "f" + repr(fields)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        high, low = [], []
        for text in pdf["text"]:
            form = canonical(text)
            if form is None:
                high.append(None)
                low.append(None)
            else:
                d = hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                high.append(int.from_bytes(d[:8], "little", signed=True))
                low.append(int.from_bytes(d[8:], "little", signed=True))
        yield pd.DataFrame({"id": pdf["id"], "high": pd.array(high, "Int64"), "low": pd.array(low, "Int64")})


def _marked(records: DataFrame, id: str, text: str, pass_bits: int) -> DataFrame:
    """(id, high, low, maybe): each record's hash, and whether it may be a repeat; files are sorted by the hash, for the passes
    of a filter larger than one task is sent at once."""
    rows = spread(records.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")))
    hashed = cut(rows.mapInPandas(_digests, "id long, high long, low long").sortWithinPartitions("high"), "formatting")
    return bloom.marked_repeats(hashed, "high", hashed.count(), pass_bits=pass_bits)


def grouped(records: DataFrame, id: str = "record_id", text: str = "text", pass_bits: int = bloom.PASS_BITS) -> DataFrame:
    """(id, first, copies): each record with the smallest id of its group and the group's size.

    Null texts and texts without a letter or digit are groups of their own.  Ids must be longs and unique, rows without one are left out; a row repeated
    with its id counts as a copy.  Other columns are not read.  An empty table gives an empty result.

    Groups are written down before members are joined to them, so that a group of a tenth of all records can be split.
    """
    marked = _marked(records, id, text, pass_bits)
    repeats = marked.where("maybe").drop("maybe")
    groups = cut(repeats.groupBy("high", "low").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "formatting-groups")
    shared = repeats.join(groups, ["high", "low"]).select("id", "first", "copies")
    alone = marked.where("not maybe").select("id", F.col("id").alias("first"), F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(shared)


def collapsed(records: DataFrame, id: str = "record_id", text: str = "text", pass_bits: int = bloom.PASS_BITS) -> DataFrame:
    """One row (id, copies) for each group of same records, as in ``grouped``: one aggregate of the possible repeats, which
    combines before it shuffles."""
    marked = _marked(records, id, text, pass_bits)
    shared = marked.where("maybe").groupBy("high", "low").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")
    return marked.where("not maybe").select("id", F.lit(1).cast("long").alias("copies")).unionByName(shared)
