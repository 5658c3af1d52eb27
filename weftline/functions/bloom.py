"""Bloom filters that tasks build alone and that are merged by parts.

A value is a uniformly hashed long.  Its leading bits name the part of the filter that holds it, 32 further bits its places
there.  A task sends for each part either those 32 bits of its values or, where that is shorter, a bitmap; so what is sent
is never more than four bytes a row nor more than the filter a task, and tasks are first coalesced to a few for each core.

``repeated`` answers "which hashes may occur more than once": merging adds what two senders both saw once to what was seen
again, so a hash that does occur twice always has all its bits in the result.  ``members`` is the plain filter of a set.

A filter has 16 bits a row however many rows there are.  What is sent to every task at once is bounded by ``PASS_BITS``
(32 MB): a larger filter is probed in passes over ranges of the hash, each with its own slice.  ``marked_repeats`` does
that over a written table whose files are sorted by the hash, so a pass reads its own range of each file only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import mix
from weftline.operators.spread import few
from weftline.scratch import folder, written

#: Bits of a filter that are sent to a task at once, at most.
PASS_BITS = 1 << 28
#: Bits of one part, of filters of up to a thousand parts; parts are merged apart from each other.
PART_BITS = 1 << 20
PARTS = 1 << 10
HASHES = 3
#: Values that a task holds before it hands them on.
HELD = 1 << 23
#: Ids that are sent to every task as they are, at most: 8 MB.
LISTED = 1 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_SIGN = np.uint64(1 << 63)


def bits_for(rows: int) -> int:
    """A power of two of at least 16 bits for a row."""
    return max(1 << 16, 1 << (16 * max(1, rows) - 1).bit_length())


class Shape:
    """How a filter of ``bits`` bits is laid out."""

    def __init__(self, bits: int, pass_bits: int = PASS_BITS) -> None:
        self.bits = bits
        self.part_bits = min(pass_bits, max(min(bits, PART_BITS), bits // PARTS))
        self.parts = bits // self.part_bits
        self.passes = max(1, bits // pass_bits)
        self._shift = np.uint64(65 - self.parts.bit_length())  # 64 with one part
        self._width = np.uint64(65 - self.part_bits.bit_length())

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Part and 32 bits of each value, in one number."""
        u = h.view(np.uint64)
        part = np.zeros(len(u), np.uint64) if self.parts == 1 else (u ^ _SIGN) >> self._shift
        return part << np.uint64(32) | mix(u) & np.uint64(0xFFFFFFFF)

    def places(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each hash function the byte and the bit, within the part, of values given by their 32 bits."""
        x = x.astype(np.uint64) + np.uint64(1)
        places = [x * np.uint64(f) >> self._width for f in _FACTORS[:HASHES]]
        return [((p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)) for p in places]

    def range(self, k: int) -> tuple[int, int]:
        """The least and the largest value of a pass."""
        width = (1 << 64) // self.passes
        return k * width - (1 << 63), (k + 1) * width - 1 - (1 << 63)


def _has(table: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray | int = 0) -> np.ndarray:
    return np.logical_and.reduce([(table[base + at] & bit) != 0 for at, bit in places])


def _set(table: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]], which: np.ndarray | slice = slice(None)) -> None:
    for at, bit in places:
        np.bitwise_or.at(table, at[which], bit[which])


def _first_column(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.iloc[:, 0].to_numpy(np.int64)


def _builder(shape: Shape, values: Callable[[pd.DataFrame], np.ndarray] = _first_column) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    size = shape.part_bits // 8

    def packed(x: np.ndarray) -> tuple[bool, bytes]:
        if 4 * len(x) <= size:
            return False, zlib.compress(x.astype("<u4").tobytes(), 1)
        table = np.zeros(size, np.uint8)
        _set(table, shape.places(x))
        return True, zlib.compress(table.tobytes(), 1)

    def sent(held: list[np.ndarray]) -> pd.DataFrame:
        own, n = np.unique(np.concatenate(held), return_counts=True)
        part, x = (own >> np.uint64(32)).astype(np.int64), own & np.uint64(0xFFFFFFFF)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for a, b in zip(starts, [*starts[1:], len(own)]):
            many = n[a:b] > 1
            rows.append((int(part[a]), *packed(x[a:b][~many]), *packed(x[a:b][many])))
        return pd.DataFrame(rows, columns=["part", "once_bits", "once", "again_bits", "again"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            h = values(pdf)
            if len(h):
                held.append(shape.codes(h))
                rows += len(h)
            if rows >= HELD:
                yield sent(held)
                held, rows = [], 0
        if held:
            yield sent(held)

    return build


def _merger(shape: Shape, again_too: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    size = shape.part_bits // 8

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, once, again = None, np.zeros(size, np.uint8), np.zeros(size, np.uint8)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"part": [at], "bits": [zlib.compress((again if again_too else once).tobytes(), 1)]})

        def add(whole: bool, pack: bytes, twice: bool) -> None:
            data = zlib.decompress(pack)
            if whole:
                table = np.frombuffer(data, np.uint8)
                np.bitwise_or(again, table if twice else table & once, out=again)
                np.bitwise_or(once, table, out=once)
            elif data:
                places = shape.places(np.frombuffer(data, "<u4"))
                _set(again, places, slice(None) if twice else _has(once, places))
                _set(once, places)

        for pdf in batches:
            for part, once_bits, o, again_bits, a in zip(pdf["part"], pdf["once_bits"], pdf["once"], pdf["again_bits"], pdf["again"]):
                if part != at:
                    if at is not None:
                        yield done()
                    at, once, again = part, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                add(once_bits, o, False)
                add(again_bits, a, True)
        if at is not None:
            yield done()

    return merge


_SENT = "part long, once_bits boolean, once binary, again_bits boolean, again binary"


def _merged(sent: DataFrame, shape: Shape, again_too: bool) -> DataFrame:
    """(part, bits) of what tasks sent."""
    tasks = min(shape.parts, 4 * sent.sparkSession.sparkContext.defaultParallelism)
    return sent.repartition(tasks, "part").sortWithinPartitions("part").mapInPandas(_merger(shape, again_too), "part long, bits binary")


def _parts(hashes: DataFrame, shape: Shape, again_too: bool) -> DataFrame:
    """(part, bits) of the filter of the one column of ``hashes``."""
    sent = few(hashes.where(F.col(hashes.columns[0]).isNotNull())).mapInPandas(_builder(shape), _SENT)
    return _merged(sent, shape, again_too)


class Tester:
    """The test of a filter's pass on arrays of values, to be called in tasks: false only for values the filter does not hold."""

    def __init__(self, spark, rows: list, shape: Shape, first: int = 0) -> None:
        self.held = spark.sparkContext.broadcast({r["part"] - first: bytes(r["bits"]) for r in rows})
        self.shape, self.first, self._table = shape, first, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def __call__(self, h: np.ndarray) -> np.ndarray:
        size, parts = self.shape.part_bits // 8, self.shape.parts // self.shape.passes
        if self._table is None:
            self._table = np.zeros(size * parts, np.uint8)
            for k, packed in self.held.value.items():
                self._table[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        codes = self.shape.codes(h)
        part = np.clip((codes >> np.uint64(32)).astype(np.int64) - self.first, 0, parts - 1)
        return _has(self._table, self.shape.places(codes & np.uint64(0xFFFFFFFF)), part * size)


def tester(rows: DataFrame, values: Callable[[pd.DataFrame], np.ndarray], bits: int) -> Tester:
    """A test on arrays of 64-bit values that ``values`` finds in pieces of ``rows``; at most PASS_BITS."""
    shape = Shape(bits)
    if shape.passes > 1:
        raise ValueError(f"a filter of {bits} bits takes several passes")
    return Tester(rows.sparkSession, _merged(few(rows).mapInPandas(_builder(shape, values), _SENT), shape, False).collect(), shape)


def _probe(spark, rows: list, shape: Shape, first: int = 0) -> tuple[Callable[[Column], Column], Tester]:
    """The test of one pass, whose parts begin at ``first``, on a column."""
    test = Tester(spark, rows, shape, first)

    @F.pandas_udf("boolean")
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(test(s.to_numpy(np.int64)))

    return (lambda column: column.isNotNull() & probe(F.coalesce(column, F.lit(0).cast("long")))), test  # nulls would turn longs into doubles


def _filter(hashes: DataFrame, bits: int, again_too: bool) -> Callable[[Column], Column]:
    shape = Shape(bits)
    if shape.passes > 1:
        raise ValueError(f"a filter of {bits} bits takes several passes")
    return _probe(hashes.sparkSession, _parts(hashes, shape, again_too).collect(), shape)[0]


def repeated(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test on a long column: false only for values that occur at most once in the one column of ``hashes``; null is false.

    For filters of one pass, at most PASS_BITS; ``marked_repeats`` takes any number of rows.
    """
    return _filter(hashes, bits, True)


def members(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test on a long column: false only for values that ``hashes`` does not hold; null is false.  At most PASS_BITS."""
    return _filter(hashes, bits, False)


def marked_repeats(table: DataFrame, column: str, rows: int, name: str = "maybe", pass_bits: int = PASS_BITS) -> DataFrame:
    """``table`` with ``name``: false only where the value of ``column`` occurs at most once; null is false.

    ``table`` is read once for each pass, so it should be a written one, sorted within its files by ``column``: then the range
    of a pass prunes what is read.  With one pass nothing runs but the filter; with more each pass is written before the next
    begins, and neither the driver nor a task ever holds more than one slice of the filter.
    """
    spark, shape = table.sparkSession, Shape(bits_for(rows), pass_bits)
    parts = _parts(table.select(column), shape, True)
    if shape.passes == 1:
        return table.withColumn(name, _probe(spark, parts.collect(), shape)[0](F.col(column)))
    path = f"{folder(spark)}/weftline/bloom-{uuid.uuid4().hex}"
    parts.write.parquet(written(spark, f"{path}-parts"))
    parts, per = spark.read.parquet(f"{path}-parts"), shape.parts // shape.passes
    for k in range(shape.passes):
        low, high = shape.range(k)
        test, held = _probe(spark, parts.where(F.col("part").between(k * per, (k + 1) * per - 1)).collect(), shape, k * per)
        table.where(F.col(column).between(low, high)).withColumn(name, test(F.col(column))).write.mode("append").parquet(path)
        held.held.destroy()
    table.where(F.col(column).isNull()).withColumn(name, F.lit(False)).write.mode("append").parquet(written(spark, path))
    return spark.read.parquet(path)


def _listed(ids: DataFrame) -> Callable[[Column], Column]:
    """An exact test for at most LISTED ids, which are sent to every task as one sorted array."""
    own = F.col(ids.columns[0]).cast("long")
    held = ids.where(own.isNotNull()).select(own.alias("id")).distinct().toPandas()["id"].to_numpy(np.int64)
    sent = ids.sparkSession.sparkContext.broadcast(np.sort(held))

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        for s in batches:
            h = s.to_numpy(np.int64)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            yield pd.Series(known[at] == h if len(known) else np.zeros(len(h), bool))

    return lambda column: column.isNotNull() & test(F.coalesce(column.cast("long"), F.lit(0).cast("long")))


def meeting(rows: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id the one column of ``ids`` holds, and perhaps a few others: what a join with ``ids`` needs to see.

    Few ids are sent as they are, more as a filter; with so many that their filter would take several passes, most rows move
    anyway, and an exact semi-join is made.
    """
    n = ids.count()
    bits, own = bits_for(n), ids.columns[0]
    if n <= LISTED:
        return rows.where(_listed(ids)(F.col(id)))
    if bits > PASS_BITS:
        return rows.join(ids.select(F.col(own).alias("_listed")).distinct(), F.col(id) == F.col("_listed"), "left_semi")
    return rows.where(members(ids.select(F.xxhash64(F.col(own).cast("long")).alias("h")), bits)(F.xxhash64(F.col(id).cast("long"))))


def without(rows: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` whose id the one column of ``ids`` does not hold.

    Few ids are sent to every task.  With more, rows that a filter of them clears stay where they are, and only the others meet ``ids`` in a
    shuffle.  Rows with a null id stay.
    """
    n = ids.count()
    listed, bits = ids.select(F.col(ids.columns[0]).alias("_listed")), bits_for(n)
    if n <= LISTED:
        return rows.where(~_listed(ids)(F.col(id)))
    if bits > PASS_BITS:
        return rows.join(listed, F.col(id) == F.col("_listed"), "left_anti")
    maybe = members(listed.select(F.xxhash64(F.col("_listed").cast("long")).alias("h")), bits)
    marked = rows.withColumn("_maybe", F.col(id).isNotNull() & maybe(F.xxhash64(F.col(id).cast("long"))))
    checked = marked.where("_maybe").join(listed, F.col(id) == F.col("_listed"), "left_anti")
    return marked.where("not _maybe").unionByName(checked).drop("_maybe")
