"""Near-duplicate records: generalised pigeonhole over signatures, exact verification.

A record is the set of its runs of ``n`` words.  Its signature is a vector of ``COORDINATES`` minimum hashes; written as
bits (one bit for each value of a coordinate) the bits of one coordinate exclude each other, so they stay together.  Two
sets of similarity t differ in about (1 - t) of the coordinates, and more than ``budget`` mismatches are as rare as ``RARE``.

Coordinates whose agreement is correlated are put into one partition of ``WIDTH``: how correlated is measured on all pairs
of a sample of SAMPLE signatures.  By the generalised pigeonhole principle two records with at most ``budget`` mismatches
have, in at least one partition i, at most t_i of them, for any thresholds with sum(t_i + 1) = budget + 1; a partition may
get -1 and be left out.  A dynamic programme chooses the thresholds so that candidates, estimated from sketches of all
signatures, and rows sent are fewest.  A threshold t_i is probed by keys of every choice of WIDTH - t_i coordinates.

Candidates that share a key are thinned inside the join by a 128-bit digest of the signature, then by the whole
signatures, and those left are verified exactly on their sets, which are made once a record.  Equal sets are collapsed
before and never paired.  Keys that very many records share are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import bloom
from weftline.functions.text import WordHashes, mix
from weftline.llm import meet
from weftline.llm.shingles import blobs, pieces, run_sets
from weftline.operators.components import components
from weftline.operators.spread import few, spread
from weftline.scratch import cut

COORDINATES = 32
WIDTH = 4
#: Chance that a pair at the very threshold has more mismatches than the budget; the pigeonhole still finds most of those.
RARE = 0.004
#: Chance that such a pair is lost by the digests inside the join, and again by the signatures after it.
LOST = 5e-4
#: Counters of one sketch.
COUNTERS = 1024
#: Signatures on whose pairs correlations are measured, at most.
SAMPLE = 512
#: What sending a row costs, in candidates.
ROW = 1.0

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _tail(n: int, p: float, over: int) -> float:
    """P(more than ``over`` of n)."""
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(over + 1, n + 1))


def budget(similarity: float) -> int:
    """Mismatches allowed."""
    return next(k for k in range(COORDINATES + 1) if _tail(COORDINATES, 1 - similarity, k) <= RARE)


def agreement(similarity: float, bits: int = 32) -> int:
    """Coordinates that must agree, in ``bits`` bits each, for all but LOST of the pairs at the threshold."""
    equal = similarity + (1 - similarity) / 2**bits
    return max(k for k in range(COORDINATES + 1) if 1 - _tail(COORDINATES, equal, k - 1) <= LOST)


def _signatures(n: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for low, high in pieces(texts):
                ends, s, _ = run_sets(texts[low:high], n, hashes)
                sizes = np.diff(np.r_[0, ends])
                some = sizes > 0
                if not some.any():
                    continue
                starts = (ends - sizes)[some]
                least = np.empty((len(starts), COORDINATES), np.uint64)
                right = s >> np.uint64(29)
                for k in range(COORDINATES):
                    least[:, k] = np.minimum.reduceat((s * _SEEDS[k]) ^ (right * _SEEDS[-1 - k]), starts)
                least = mix(least)
                nibbles = (least >> np.uint64(60)).reshape(len(starts), 2, -1) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                d = np.bitwise_or.reduce(nibbles, 2).view(np.int64)
                a, b = mix(np.add.reduceat(mix(s), starts)), mix(np.bitwise_xor.reduceat(mix(s + np.uint64(7)), starts))
                signature = (least >> np.uint64(28)).astype("<u4")
                out = {"id": pdf["id"].to_numpy(np.int64)[low:high][some], "a": a.view(np.int64), "b": b.view(np.int64), "size": sizes[some].astype(np.int32)}
                yield pd.DataFrame(out | {"signature": [x.tobytes() for x in signature], "d0": d[:, 0], "d1": d[:, 1]})

    return make


_SIGNATURE = "id long, a long, b long, size int, signature binary, d0 long, d1 long"


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u4").reshape(-1, COORDINATES).astype(np.uint64)


class Plan(NamedTuple):
    """Partitions of coordinates and the threshold of each."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def probes(self) -> list[tuple[int, ...]]:
        """The choices of coordinates whose values make a key."""
        return [c for p, t in zip(self.partitions, self.thresholds) if t >= 0 for c in combinations(p, len(p) - t)]

    def missed(self, similarity: float) -> float:
        """Chance that a pair of that similarity shares no key."""
        out = 1.0
        for p, t in zip(self.partitions, self.thresholds):
            out *= _tail(len(p), 1 - similarity, t) if t >= 0 else 1.0
        return out


def _keys(values: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(values), hash(choice) & 0xFFFFFFFFFFFF, np.uint64)
    for k in choice:
        h = mix(h + values[:, k] + np.uint64(k + 1))
    return h


def _second_moments(signatures: DataFrame, choices: list[tuple[int, ...]]) -> list[float]:
    """For each choice of coordinates the estimated sum of squared key frequencies, over all rows.

    Each task adds signs into COUNTERS counters a choice; their sum over all tasks squared is the estimate.  What a task
    sends is of fixed size, whatever its rows; tasks are a few for each core, and choices are added up apart from each other.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(choices), COUNTERS), np.int64)
        some = False
        for pdf in batches:
            if len(pdf):
                some = True
                values = _matrix(pdf["signature"])
                for k, choice in enumerate(choices):
                    h = _keys(values, choice)
                    held[k] += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1), COUNTERS).astype(np.int64)
        if some:
            yield pd.DataFrame({"choice": range(len(choices)), "held": [x.tobytes() for x in held]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, x in zip(pdf["choice"], pdf["held"]):
                held[k] = held.get(k, 0) + np.frombuffer(x, np.int64)
        yield pd.DataFrame({"choice": list(held), "moment": [float((x.astype(float) ** 2).sum()) for x in held.values()]}).astype({"choice": "int64", "moment": "float64"})

    sent = few(signatures.select("signature")).mapInPandas(count, "choice long, held binary")
    tasks = min(len(choices), signatures.sparkSession.sparkContext.defaultParallelism)
    found = {r["choice"]: r["moment"] for r in sent.repartition(tasks, "choice").mapInPandas(add, "choice long, moment double").collect()}
    return [found.get(k, 0.0) for k in range(len(choices))]


def correlation(signatures: DataFrame) -> np.ndarray:
    """How the agreement of coordinates is correlated over all pairs of at most SAMPLE signatures, drawn by their content."""
    drawn = signatures.select("a", "b", "signature").orderBy("a", "b").limit(SAMPLE).toPandas()
    if len(drawn) < 3:
        return np.zeros((COORDINATES, COORDINATES))
    values = _matrix(drawn["signature"])
    i, j = np.triu_indices(len(values), 1)
    agree = (values[i] == values[j]).astype(np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.corrcoef(agree.T))


def grouped(correlated: np.ndarray, width: int = WIDTH) -> tuple[tuple[int, ...], ...]:
    """Coordinates in partitions: the most correlated pair left, and to it those most correlated with what it has."""
    left, out = list(range(len(correlated))), []
    while left:
        own = [left[0]]
        if len(left) > 1:
            own = list(max(((i, j) for i in left for j in left if i < j), key=lambda p: (correlated[p], -p[0], -p[1])))
        while len(own) < min(width, len(left)):
            own.append(max((k for k in left if k not in own), key=lambda k: (sum(correlated[k, o] for o in own), -k)))
        out.append(tuple(sorted(own)))
        left = [k for k in left if k not in own]
    return tuple(out)


def allocate(costs: list[list[float]], need: int) -> tuple[int, ...]:
    """Thresholds of least total cost with sum(t + 1) >= need; costs[i][t + 1] is partition i's at threshold t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, chosen) in best.items():
            for gain, c in enumerate(row):
                at, option = min(need, have + gain), (cost + c, (*chosen, gain - 1))
                if at not in new or option < new[at]:
                    new[at] = option
        best = new
    return best[need][1]


def plan(signatures: DataFrame, similarity: float) -> Plan:
    """Partitions and thresholds for these signatures, from counts over all of them."""
    rows = signatures.count()
    partitions = grouped(correlation(signatures))
    choices = [[list(combinations(p, WIDTH - t)) for t in range(WIDTH)] for p in partitions]
    flat = [c for p in choices for level in p for c in level]
    moment = dict(zip(flat, _second_moments(signatures, flat)))
    costs = [[0.0, *[sum(max(0.0, moment[c] - rows) / 2 + ROW * rows for c in level) for level in p]] for p in choices]
    return Plan(partitions, allocate(costs, budget(similarity) + 1))


def _agreeing(c: meet.Columns, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Coordinates in whose four bits the digests of pairs agree."""
    out = np.full(len(i), COORDINATES, np.uint8)
    for d in ("d0", "d1"):
        x = (c[d][i] ^ c[d][j]).view(np.uint64)
        x |= x >> np.uint64(2)
        out -= np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111))
    return out


@F.pandas_udf(T.IntegerType())
def _matching(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((_matrix(a) == _matrix(b)).sum(1).astype(np.int32)) if len(a) else pd.Series([], dtype="int32")


def _sets(n: int):
    """(id, runs): the distinct runs of each text, in order, as bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for low, high in pieces(texts):
                ends, s, _ = run_sets(texts[low:high], n, hashes)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(np.int64)[low:high], "runs": blobs(s, ends)})

    return make


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype="float64")


class Classes(NamedTuple):
    """``members`` (id, class): each record with the smallest id of an equal set; ``links`` (a, b, similarity): classes
    a < b whose similarity reaches the threshold; the plan used."""

    members: DataFrame
    links: DataFrame
    plan: Plan


def classes(documents: DataFrame, n: int = 5, similarity: float = 0.8, id: str = "doc_id", text: str = "text", limit: int = meet.LIMIT) -> Classes:
    """Records with equal sets of n-word runs as classes, and all links between classes.

    Ids must be unique longs; rows without one are left out.  Null texts and texts of fewer than ``n`` words have no similarity to anything and do not
    appear.  Only id and text are read.  Similarities are exact; a link is missed only if no key or digest shows it, with the
    chance ``Plan.missed`` plus twice LOST, which is largest at the threshold itself.
    """
    spark = documents.sparkSession
    rows = spread(documents.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")))
    signed = cut(rows.mapInPandas(_signatures(n), _SIGNATURE), "signatures")
    firsts = cut(signed.groupBy("a", "b").agg(F.min(F.struct("id", "signature", "size", "d0", "d1")).alias("s")).select("a", "b", "s.*"), "classes")
    members = signed.select("id", "a", "b").join(firsts.select("a", "b", F.col("id").alias("class")), ["a", "b"]).select("id", "class")
    chosen = plan(firsts, similarity)
    probes = chosen.probes()

    least = agreement(similarity, 4)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                values = _matrix(pdf["signature"])
                yield pd.DataFrame({"key": np.concatenate([_keys(values, c).view(np.int64) for c in probes])} | {c: np.tile(pdf[c].to_numpy(np.int64), len(probes)) for c in ("id", "d0", "d1")})

    keyed = firsts.select("id", "signature", "d0", "d1").mapInPandas(keys, "key long, id long, d0 long, d1 long")
    met = meet.pairs(keyed, "key", "id", lambda c, i, j: (c["id"][i] != c["id"][j]) & (_agreeing(c, i, j) >= least), lambda c, i, j: {"a": np.minimum(c["id"][i], c["id"][j]), "b": np.maximum(c["id"][i], c["id"][j])}, "a long, b long", "met", limit)
    close = met.distinct()
    signature = firsts.select("id", "signature", "size")
    near = close.join(signature.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("size").alias("na")), "a").join(signature.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("size").alias("nb")), "b")
    alike = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")
    pairs = cut(near.where(alike & (_matching("sa", "sb") >= agreement(similarity))).select("a", "b"), "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = cut(bloom.meeting(rows, ids).mapInPandas(_sets(n), "id long, runs binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    links = both.select("a", "b", _jaccard("ra", "rb").alias("similarity")).where(F.col("similarity") >= similarity)
    return Classes(members, links, chosen)


def pairs(found: Classes) -> DataFrame:
    """(a, b), a < b: all pairs of records of one class or of linked classes."""
    x, y = found.members.select(F.col("id").alias("p"), F.col("class").alias("cp")), found.members.select(F.col("id").alias("q"), F.col("class").alias("cq"))
    same = x.join(y, (F.col("cp") == F.col("cq")) & (F.col("p") < F.col("q"))).select(F.col("p").alias("a"), F.col("q").alias("b"))
    across = found.links.select(F.col("a").alias("cp"), F.col("b").alias("cq")).join(x, "cp").join(y, "cq").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return same.unionByName(across)


def groups(found: Classes) -> DataFrame:
    """(id, class, group, links): each record with its class, the group of linked classes and its class's number of links."""
    links = cut(found.links.select("a", "b"), "links")
    joined = components(links)
    degree = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    rows = found.members.join(joined.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
    return rows.select("id", "class", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
