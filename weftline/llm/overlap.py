"""Records of held-out splits that also stand in the training split, exactly or nearly.

A weighted cosine join between the two sides.  A record is a vector over its runs of ``n`` words, of length one; it is made
once, and everything after works on stored vectors.  Terms that only one side has add nothing to any product and are left
out, by the statistics below or, where those get crowded, by Bloom filters.  The terms left are ordered from rare to frequent; a vector enters the inverted lists only with the
terms up to where the rest can reach no more than the bound less SLACK, by the rest's norm or by the rest's weights times
the largest weight of each term on the other side; a vector that can't reach the bound with all its terms is left out.  The
lists' products are summed for each pair; if the sum and the larger rest reach the bound, the pair gets its exact product.

How often terms come and their largest weights stand in CELLS cells that terms share by hash: counts decide an order only,
and the largest weight of a cell bounds that of each of its terms, so sharing cells costs pairs to verify but never a pair.
A term whose two lists would give more than PAIRS pairs is split: the training list into parts, the other list to each.

Equal vectors of one side are one class; copies are expanded only where a caller asks for pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.functions.text import WordHashes, mix
from weftline.llm.shingles import blobs, pieces, run_sets
from weftline.operators.spread import few, spread
from weftline.scratch import cut

EPSILON = 1e-6
#: How far below the bound the part that is not indexed must lie: indexing more leaves fewer pairs to verify.
SLACK = 0.04
#: Cells of term statistics, at most; four bytes each are sent to every task.
CELLS = 1 << 22
#: Cells that are merged together.
PART = 1 << 16
#: Pairs that one term's lists may give in one task, about (a power of two), and the parts a list is split into at most.
PAIRS = 22
PARTS = 10
#: Rows that a task hands on at once, about.
ROWS = 200_000


def bound(jaccard: float) -> float:
    """The cosine of even weights that every pair of that Jaccard similarity reaches."""
    return 2 * jaccard / (1 + jaccard)


def _vectors(n: int, weights: str):
    """(id, train, a, b, size, terms, times) of texts of ``n`` words or more: terms in order as bytes, how often each comes
    (null for even weights), and a 128-bit hash of both."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in pieces(texts):
                ends, terms, times = run_sets(texts[first:last], n, hashes)
                if not len(terms):
                    continue
                own = pdf.iloc[first:last]
                sizes = np.diff(np.r_[0, ends])
                some = sizes > 0
                starts = (ends - sizes)[some]
                content = mix(terms if weights == "even" else terms + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                a, b = np.add.reduceat(content, starts), np.bitwise_xor.reduceat(mix(content + np.uint64(1)), starts)
                out = own.loc[some, ["id", "train"]].assign(a=a.view(np.int64), b=b.view(np.int64), size=sizes[some].astype(np.int32))
                out["terms"] = blobs(terms, ends[some])
                out["times"] = None if weights == "even" else blobs(times.astype("<u4"), ends[some])
                yield out

    return make


_VECTOR = "id long, train boolean, a long, b long, size int, terms binary, times binary"


def _flat(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["terms"]), np.uint64)


def _weights(pdf: pd.DataFrame, sizes: np.ndarray) -> np.ndarray:
    """Weights of all terms of a piece, each vector of norm 1."""
    if pdf["times"].isna().all():
        return np.repeat(1 / np.sqrt(sizes), sizes)
    times = np.frombuffer(b"".join(pdf["times"]), "<u4").astype(float)
    return times / np.repeat(np.sqrt(np.add.reduceat(times * times, np.cumsum(sizes) - sizes)), sizes)


class Cells(NamedTuple):
    """Of each cell the logarithm of the rows of either side, and a bound on the logarithm of the largest weight."""

    shift: int
    rows: tuple[np.ndarray, np.ndarray]
    most: tuple[np.ndarray, np.ndarray]

    def of(self, terms: np.ndarray) -> np.ndarray:
        return (terms >> np.uint64(self.shift)).astype(np.int64)

    def frequency(self, at: np.ndarray) -> np.ndarray:
        """Eight times the binary logarithm of the pairs that a cell's terms would give, about."""
        return self.rows[0][at].astype(np.int32) + self.rows[1][at]

    def largest(self, at: np.ndarray, side: int) -> np.ndarray:
        """No weight of the cell on that side is larger; 0 where there is none."""
        return _BOUNDS[self.most[side][at]]


#: What a byte of ``Cells.most`` stands for.
_BOUNDS = np.r_[0.0, 2.0 ** ((np.arange(1, 256) - 255) / 16)]


def _cells(vectors: DataFrame, cells: int) -> Cells:
    """Statistics of all terms, in arrays of fixed size that tasks fill alone and that are merged by parts."""
    shift, part = 64 - (cells.bit_length() - 1), min(cells, PART)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, most, some = np.zeros((2, cells), np.uint32), np.zeros((2, cells), np.float32), False
        for pdf in batches:
            if not len(pdf):
                continue
            some = True
            sizes = pdf["size"].to_numpy(np.int64)
            at, w = (_flat(pdf) >> np.uint64(shift)).astype(np.int64), _weights(pdf, sizes).astype(np.float32)
            train = np.repeat(pdf["train"].to_numpy(bool), sizes)
            for side, own in enumerate((train, ~train)):
                np.add.at(rows[side], at[own], 1)
                np.maximum.at(most[side], at[own], w[own])
        if some:
            packs = [(k, *(zlib.compress(x[:, k * part : (k + 1) * part].tobytes(), 1) for x in (rows, most))) for k in range(cells // part)]
            yield pd.DataFrame(packs, columns=["part", "rows", "most"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, most = None, None, None
        for pdf in batches:
            for k, r, m in zip(pdf["part"], pdf["rows"], pdf["most"]):
                r, m = np.frombuffer(zlib.decompress(r), np.uint32).astype(np.uint64), np.frombuffer(zlib.decompress(m), np.float32)
                if k == at:
                    rows, most = rows + r, np.maximum(most, m)
                    continue
                if at is not None:
                    yield done(at, rows, most)
                at, rows, most = k, r, m
        if at is not None:
            yield done(at, rows, most)

    def done(k: int, rows: np.ndarray, most: np.ndarray) -> pd.DataFrame:
        low = np.where(rows > 0, np.log2(rows + 1.0) * 8, 0).astype(np.uint8)
        with np.errstate(divide="ignore"):
            high = np.where(most > 0, np.clip(255 - np.floor(-np.log2(most * (1 + 1e-6)) * 16), 1, 255), 0).astype(np.uint8)
        return pd.DataFrame({"part": [k], "rows": [zlib.compress(low.tobytes(), 1)], "most": [zlib.compress(high.tobytes(), 1)]})

    sent = few(vectors.select("train", "size", "terms", "times")).mapInPandas(count, "part int, rows binary, most binary")
    merged = sent.repartition(min(cells // part, 4 * vectors.sparkSession.sparkContext.defaultParallelism), "part").sortWithinPartitions("part").mapInPandas(add, "part int, rows binary, most binary").collect()
    out = np.zeros((2, 2, cells), np.uint8)  # rows or most, side
    for r in merged:
        for k, x in enumerate((r["rows"], r["most"])):
            out[k, :, r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(zlib.decompress(x), np.uint8).reshape(2, -1)
    return Cells(shift, (out[0, 0], out[0, 1]), (out[1, 0], out[1, 1]))


def _lists(sent, on_held: bloom.Tester | None, on_train: bloom.Tester | None, least: float, slack: float, split: int):
    """Rows of the inverted lists: (key, id, train, w, rest)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: Cells = sent.value
        for whole in batches:
            ends = whole["size"].cumsum() // ROWS
            for _, pdf in whole.groupby(ends):
                yield rows_of(pdf, cells)

    def rows_of(pdf: pd.DataFrame, cells: Cells) -> pd.DataFrame:
        sizes = pdf["size"].to_numpy(np.int64)
        terms, w, of = _flat(pdf), _weights(pdf, sizes), np.repeat(np.arange(len(pdf)), sizes)
        train = np.repeat(pdf["train"].to_numpy(bool), sizes)
        at = cells.of(terms)
        most = np.where(train, cells.largest(at, 1), cells.largest(at, 0))
        keep = most > 0
        for test, own in ((on_held, train), (on_train, ~train)):
            if test is not None:
                asked = np.flatnonzero(keep & own)
                keep[asked] = test(terms[asked])
        terms, w, of, train, at, most = (x[keep] for x in (terms, w, of, train, at, most))
        often = cells.frequency(at)
        order = np.argsort(of * 1024 + often, kind="stable")  # terms of one frequency stay in order
        terms, w, of, train, often, most = (x[order] for x in (terms, w, of, train, often, most))
        n = np.bincount(of, minlength=len(pdf))
        start = np.cumsum(n) - n

        def rest(x: np.ndarray) -> np.ndarray:
            """What x adds up to from each term to the end of its record."""
            up = np.r_[0.0, np.cumsum(x)]
            return up[(start + n)[of]] - up[:-1]

        reach = np.minimum(np.sqrt(np.maximum(rest(w * w), 0)), rest(w * most))
        listed = reach >= least - slack
        some = n > 0
        total = np.zeros(len(pdf))
        total[some] = reach[start[some]]
        many = np.bincount(of[listed], minlength=len(pdf))  # reach falls along a record
        left = np.zeros(len(pdf))
        cut_off = many < n
        left[cut_off] = reach[(start + many)[cut_off]]
        listed &= (total >= least - EPSILON)[of]
        terms, w, of, train, often = (x[listed] for x in (terms, w, of, train, often))
        ids = pdf["id"].to_numpy(np.int64)[of]
        parts = 1 << np.clip(often // 8 - split, 0, PARTS)
        own = (mix(ids.view(np.uint64)) & (parts - 1).astype(np.uint64)).astype(np.int64)
        times = np.where(train, 1, parts)
        if (parts > 1).any():
            terms, w, of, train, ids, own = (np.repeat(x, times) for x in (terms, w, of, train, ids, own))
            nth = np.arange(len(terms)) - np.repeat(np.cumsum(times) - times, times)
            own = np.where(train, own, nth)
        key = np.where(own > 0, mix(terms + own.astype(np.uint64)), terms)
        return pd.DataFrame({"key": key.view(np.int64), "id": ids, "train": train, "w": w.astype(np.float32), "rest": left[of].astype(np.float32)})

    return make


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for a, b, x, y, tx, ty in zip(pdf["a"], pdf["b"], pdf["xa"], pdf["xb"], pdf["ta"], pdf["tb"]):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
            if tx is None:
                cosine = len(common) / float(np.sqrt(float(len(s)) * len(t)))
            else:
                u, v = np.frombuffer(tx, "<u4").astype(float), np.frombuffer(ty, "<u4").astype(float)
                cosine = float((u[i] * v[j]).sum() / np.sqrt((u * u).sum() * (v * v).sum()))
            out.append((a, b, cosine, len(common) / (len(s) + len(t) - len(common))))
        yield pd.DataFrame(out, columns=["a", "b", "cosine", "jaccard"])


class Overlaps(NamedTuple):
    """``members`` (id, train, class): each record with the smallest id of its side with an equal vector; ``links`` (a, b,
    cosine, jaccard): a class of the training side and one of the other side."""

    members: DataFrame
    links: DataFrame


def overlaps(records: DataFrame, least_cosine: float, n: int = 5, weights: str = "even", id: str = "record_id", text: str = "text", slack: float = SLACK, cells: int = CELLS, split: int = PAIRS) -> Overlaps:
    """All pairs of a training class and a held-out class whose cosine reaches ``least_cosine``.

    ``weights``: terms count alike (``even``) or by how often they come in the record (``tf``).  Takes id (unique longs),
    text and split; split ``train`` is one side, every other non-null split the other, rows with a null split or id are left
    out.  Null texts and texts of fewer than ``n`` words overlap nothing and do not appear.  ``cells`` is a power of two;
    ``split`` the binary logarithm of the pairs of a term's lists beyond which they are split.  Neither changes the result.
    """
    spark = records.sparkSession
    rows = spread(records.where(F.col("split").isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), (F.col("split") == "train").alias("train"), F.col(text).alias("text")))
    vectors = cut(rows.mapInPandas(_vectors(n, weights), _VECTOR), "vectors")
    firsts = cut(vectors.groupBy("train", "a", "b").agg(F.min("id").alias("class")), "vector-classes")
    members = cut(vectors.select("id", "train", "a", "b").join(firsts, ["train", "a", "b"]).select("id", "train", "class"), "members")
    sums = {r["train"]: r["n"] for r in vectors.groupBy("train").agg(F.sum("size").alias("n")).collect()}
    cells = min(cells, max(1 << 12, bloom.bits_for(max(sums.values(), default=0)) // 64))
    known = _cells(vectors, cells)  # copies raise counts and change no bound
    distinct = bloom.without(vectors.select("id", "train", "size", "terms", "times"), members.where("id <> class").select("id"))
    test: dict[bool, bloom.Tester | None] = {True: None, False: None}
    for side in test:  # cells alone tell terms of one side where there are enough of them; beyond one pass of a filter, lists are joined unfiltered
        bits = bloom.bits_for(sums.get(side, 0))
        if sums.get(side, 0) > 8 * cells and bits <= bloom.PASS_BITS:
            test[side] = bloom.tester(vectors.where(F.col("train") == side).select("terms"), _flat, bits)
    lists = cut(distinct.mapInPandas(_lists(spark.sparkContext.broadcast(known), test[False], test[True], least_cosine, slack, split), "key long, id long, train boolean, w float, rest float"), "lists")
    a = lists.where("train").select(F.col("id").alias("a"), "key", F.col("w").alias("wa"), F.col("rest").alias("ra"))
    b = lists.where("not train").select(F.col("id").alias("b"), "key", F.col("w").alias("wb"), F.col("rest").alias("rb"))
    met = a.join(b, "key").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("part"), F.max(F.greatest("ra", "rb")).alias("rest"))
    pairs = cut(met.where(F.col("part") + F.col("rest") >= least_cosine - EPSILON).select("a", "b"), "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    stored = bloom.meeting(vectors, ids)
    x, y = (stored.select(F.col("id").alias(s), F.col("terms").alias(f"x{s}"), F.col("times").alias(f"t{s}")) for s in "ab")
    links = pairs.join(x, "a").join(y, "b").mapInPandas(_products, "a long, b long, cosine double, jaccard double").where(F.col("cosine") >= least_cosine - 1e-9)
    return Overlaps(members, links)


def pairs(found: Overlaps) -> DataFrame:
    """(a, b): every training record with every held-out record of a linked class."""
    train = found.members.where("train").select(F.col("id").alias("p"), F.col("class").alias("a"))
    held = found.members.where("not train").select(F.col("id").alias("q"), F.col("class").alias("b"))
    return found.links.join(train, "a").join(held, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))


def linked(found: Overlaps) -> DataFrame:
    """(id, train, class, links): each record with its class and the number of classes of the other side it is linked to."""
    links = cut(found.links.select("a", "b"), "links")
    ends = links.select(F.lit(True).alias("train"), F.col("a").alias("class")).unionByName(links.select(F.lit(False).alias("train"), F.col("b").alias("class")))
    degree = ends.groupBy("train", "class").agg(F.count("*").alias("links"))
    return found.members.join(degree, ["train", "class"], "left").select("id", "train", "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def by_split_and_source(records: DataFrame, found: Overlaps, id: str = "record_id") -> DataFrame:
    """(split, source, records, found): held-out records of each split and source, and how many of them the training split
    has, equal or nearly; the source trimmed and lower-cased, null if blank."""
    linked = found.links.select(F.col("b").alias("class")).distinct()
    hit = found.members.where("not train").join(linked, "class").select("id").withColumn("hit", F.lit(1))
    rows = records.where("split is not null and split <> 'train'").select(F.col(id).cast("long").alias("id"), "split", F.nullif(F.lower(F.trim("source_id")), F.lit("")).alias("source"))
    return rows.join(hit, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("hit").alias("found"))
