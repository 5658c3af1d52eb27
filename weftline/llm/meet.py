"""Pairs of rows with one key, whatever the number of rows that share it.

Rows are shuffled once by key, sorted, and streamed: a task holds one block of equal keys at a time and pairs it in arrays.  A
block of more than LIMIT rows is not paired there but handed on; its rows are dealt into parts of about LIMIT, and every two
parts meet in a task of their own, so that no task pairs more than a square of that size and every pair meets exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.scratch import cut

#: Rows of one key that a task pairs, at most.
LIMIT = 4096
#: Rows that are looked at together, about.
ROWS = 1 << 16

Columns = dict[str, np.ndarray]


def _paired(c: Columns, key: np.ndarray, keep: Callable, out: Callable) -> Iterator[pd.DataFrame]:
    """Pairs of rows of sorted keys that ``keep`` lets through."""
    if not len(key):
        return
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1  # rows of the block after this one
    i, found, held = np.flatnonzero(left > 0), [], 0
    for distance in range(1, int(sizes.max())):
        i = i[left[i] >= distance]
        j = i + distance
        good = keep(c, i, j)
        if good.any():
            found.append((i[good], j[good]))
            held += len(found[-1][0])
        if held >= ROWS:
            yield out(c, *map(np.concatenate, zip(*found)))
            found, held = [], 0
    if found:
        yield out(c, *map(np.concatenate, zip(*found)))


def _buffered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _first_round(columns: list[str], key: str, keep: Callable, out: Callable, names: list[str], limit: int):
    """Rows (kind, n, *out, *columns): pairs (0), rows of large blocks (1), and the keys of those with their number of rows (2)."""
    empty = {c: 0 for c in ("kind", "n", *names, *(f"r_{c}" for c in columns))}

    def shaped(kind: int, df: pd.DataFrame) -> pd.DataFrame:
        return df.assign(**{c: v for c, v in empty.items() if c not in df.columns} | {"kind": kind})[list(empty)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, large, n = None, None, 0

        def rows_of(df: pd.DataFrame) -> pd.DataFrame:
            return shaped(1, df.rename(columns={c: f"r_{c}" for c in columns}))

        def ended(k: int, n: int) -> pd.DataFrame:
            return shaped(2, pd.DataFrame({f"r_{key}": [k], "n": [n]}))

        def paired(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            k = df[key].to_numpy()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            for at in np.flatnonzero(sizes > limit):
                yield rows_of(df.iloc[starts[at] : starts[at] + sizes[at]])
                yield ended(k[starts[at]], int(sizes[at]))
            some = np.repeat((sizes > 1) & (sizes <= limit), sizes)
            own = {c: df[c].to_numpy()[some] for c in columns}
            for found in _paired(own, own[key], keep, lambda *x: pd.DataFrame(out(*x))):
                yield shaped(0, found)

        for df in _buffered(batches):
            if large is not None:
                same = int((df[key].to_numpy() == large).sum())  # they come first
                if same:
                    yield rows_of(df.iloc[:same])
                    n += same
                if same == len(df):
                    continue
                yield ended(large, n)
                large, df = None, df.iloc[same:]
            if carry is not None:
                df, carry = pd.concat([carry, df], ignore_index=True), None
            k = df[key].to_numpy()
            tail = int(np.searchsorted(k, k[-1]))
            if len(k) - tail > limit:
                large, n = k[-1], len(k) - tail
                yield rows_of(df.iloc[tail:])
            else:
                carry = df.iloc[tail:]
            if tail:
                yield from paired(df.iloc[:tail])
        if large is not None:
            yield ended(large, n)
        if carry is not None:
            yield from paired(carry)

    return run


def pairs(rows: DataFrame, key: str, id: str, keep: Callable[[Columns, np.ndarray, np.ndarray], np.ndarray], out: Callable[[Columns, np.ndarray, np.ndarray], Columns], schema: str, name: str, limit: int = LIMIT) -> DataFrame:
    """Every two rows with one ``key`` for which ``keep`` is true, as ``out`` shapes them; in no order.

    ``keep`` and ``out`` get the columns as arrays and the numbers of the first and of the second rows of pairs; they treat
    both alike.  All columns are whole numbers or booleans without nulls; ``id`` deals the rows of a large block into parts.
    The result is written once, as ``name``.
    """
    columns, names = rows.columns, [c.split()[0] for c in schema.split(", ")]
    own = ", ".join(f"r_{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    first = rows.repartition(key).sortWithinPartitions(key).mapInPandas(_first_round(columns, key, keep, out, names, limit), f"kind int, n long, {schema}, {own}")
    seen = cut(first, name)
    found, large = seen.where("kind = 0").select(*names), seen.where("kind = 1").select(*[F.col(f"r_{c}").alias(c) for c in columns])
    if large.isEmpty():
        return found
    parts = cut(seen.where("kind = 2").select(F.col(f"r_{key}").alias(key), F.ceil(F.col("n") / limit).cast("int").alias("_parts")), f"{name}-parts")
    dealt = large.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(id), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("_low", F.least("_part", "_other")).withColumn("_same", F.col("_part") == F.col("_other")).withColumn("_cell", F.xxhash64(key, "_low", F.greatest("_part", "_other")))

    def met(c: Columns, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (c[key][i] == c[key][j]) & (c["_same"][i] | (c["_part"][i] != c["_part"][j])) & keep(c, i, j)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for df in _buffered(batches):
            df = df if carry is None else pd.concat([carry, df], ignore_index=True)
            k = df["_cell"].to_numpy()
            tail = int(np.searchsorted(k, k[-1]))
            carry = df.iloc[tail:]
            yield from joined(df.iloc[:tail])
        if carry is not None:
            yield from joined(carry)

    def joined(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        c = {x: df[x].to_numpy() for x in df.columns}
        yield from _paired(c, c["_cell"], met, lambda *x: pd.DataFrame(out(*x))[names])

    again = dealt.repartition("_cell").sortWithinPartitions("_cell").mapInPandas(second, schema)
    return found.unionByName(cut(again, f"{name}-large"))
