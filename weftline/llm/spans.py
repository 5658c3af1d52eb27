"""Long spans that stand character for character in several records.

Windows are hashed only at positions whose remainder modulo a period lies in a difference cover.  Any two positions have
a common step, shorter than the period, to two positions of the cover; so two equal runs of at least ``least`` characters
always share a hashed window of ``least - period + 1``.  The covers used are perfect: q + 1 remainders for a period of
q * q + q + 1, the fewest possible.

Equal windows are joined, those of very many records split over tasks; of all the windows two runs share only the leftmost
is emitted, told by hashes of what stands before.  The pair is then extended on the texts, exactly, in tiles of TILE
positions of either text, so that two records with a passage many times each are no single row.  Records of equal text are collapsed before; they are never
paired with each other until a caller asks for pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.functions.text import mix
from weftline.llm import meet
from weftline.operators.spread import spread
from weftline.scratch import cut

LEAST = 500
#: A hashed window that comes more often is no longer paired where only coverage is asked.
HOT = 64
#: Characters of a text that are hashed at once.
BLOCK = 1 << 20
#: Rows that a task hands on at once, about.
ROWS = 200_000
#: Bits of the positions of one tile.
TILE = 14
_BASE = 0xD1342543DE82EF95


@lru_cache
def cover(q: int) -> tuple[int, ...]:
    """A perfect difference set of q + 1 remainders modulo q * q + q + 1, for a prime q.

    The zeros of a sequence s[i + 3] = a s[i + 2] + b s[i + 1] + c s[i] modulo q, for a recurrence of full period.
    """
    period = q * q + q + 1
    for c, b, a in product(range(1, q), range(q), range(q)):
        s = [0, 0, 1]
        for i in range(period - 3):
            s.append((a * s[i + 2] + b * s[i + 1] + c * s[i]) % q)
        zeros = [i for i, x in enumerate(s) if not x]
        if len(zeros) == q + 1 and len({(x - y) % period for x in zeros for y in zeros if x != y}) == period - 1:
            return tuple(zeros)
    raise ValueError(f"{q} is not prime")


def choose(least: int) -> int:
    """The largest prime q whose period leaves windows of at least three eighths of ``least``."""
    primes = [q for q in range(2, int(least**0.5) + 1) if all(q % p for p in range(2, q))]
    fit = [q for q in primes if q * q + q + 1 <= least * 5 / 8]
    if not fit:
        raise ValueError("spans must be at least 12 characters long")
    return fit[-1]


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64."""

    def __init__(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
        self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _anchor_rows(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("h", "id", "at", "left", "near"), map(np.concatenate, zip(*parts)))))


def _anchors(least: int):
    q = choose(least)
    period, window = q * q + q + 1, least - (q * q + q)
    residues = np.array(cover(q), np.int64)
    gaps = np.zeros(period, np.int64)
    gaps[residues] = (residues - np.roll(residues, 1)) % period
    is_cover = np.zeros(period, bool)
    is_cover[residues] = True

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers(BLOCK + period + window + 1)
        for pdf in batches:
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for id, text in zip(pdf["id"], pdf["text"]):
                if text is None or len(text) < least:
                    continue
                for start in range(0, len(text) - window + 1, BLOCK):
                    left = max(0, start - period)
                    c = mix(codes(text[left : start + BLOCK + window - 1]).astype(np.uint64) + np.uint64(1))
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers.up[: len(c)])])
                    at = np.arange(start, min(start + BLOCK, len(text) - window + 1))
                    at = at[is_cover[at % period]]
                    own = at - left

                    def run(a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
                        return mix((total[a + n] - total[a]) * powers.down[a])

                    def before(n: np.ndarray | int) -> np.ndarray:
                        have = at >= n
                        a = np.where(have, own - n, 0)
                        h = (run(a, np.where(have, n, 0)) >> np.uint64(33)).astype(np.int64) + 1
                        return np.where(have, h, 0).astype(np.int32)

                    held += len(at)
                    out.append((run(own, window).view(np.int64), np.full(len(at), id, np.int64), at.astype(np.int32), before(period), before(gaps[at % period])))
                    if held >= ROWS:
                        yield _anchor_rows(out)
                        out, held = [], 0
            if out:
                yield _anchor_rows(out)

    return make, period, window


def _extend(least: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, seeds, ta, tb in zip(pdf["a"], pdf["b"], pdf["seeds"], pdf["ta"], pdf["tb"]):
                x, y = codes(ta), codes(tb)
                done: set[tuple[int, int]] = set()
                for seed in seeds:
                    p, r = seed["p"], seed["r"]
                    n = min(len(x) - p, len(y) - r)
                    end = _equal(x[p : p + n], y[r : r + n])
                    m = min(p, r)
                    back = _equal(x[p - m : p][::-1], y[r - m : r][::-1])
                    if back + end >= least and (p - back, r - back) not in done:
                        done.add((p - back, r - back))
                        out.append((a, b, p - back, r - back, back + end))
            yield pd.DataFrame(out, columns=["a", "b", "a_start", "b_start", "length"])

    return make


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning; looked at in growing steps."""
    at, step = 0, 1024
    while at < len(x):
        differ = x[at : at + step] != y[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 4
    return len(x)


def copies(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, first, size): records whose text stood before under a smaller id, with that id and the text's length."""
    hashed = cut(documents.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.unhex(F.md5(F.col(text))).alias("h"), F.char_length(text).alias("size")), "texts")
    again = hashed.groupBy("h", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return cut(hashed.join(again, ["h", "size"]).where("id <> first").select("id", "first", "size"), "copies")


def _distinct(documents: DataFrame, least: int, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All records, the copies among them, and the long enough records without those copies."""
    rows = spread(documents.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")))
    again = copies(documents, id, text)
    return rows, again, bloom.without(rows.where(F.char_length("text") >= least), again.select("id"))


def spans(documents: DataFrame, least: int = LEAST, id: str = "doc_id", text: str = "text", limit: int = meet.LIMIT) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): spans are maximal equal runs (a, b, a_start, b_start, length), a < b, of ``least`` characters or
    more between records of different text; copies are those of ``copies``.

    Positions and lengths count code points of the text as stored.  Null and short texts have no spans; ids must be unique
    longs, rows without one are left out; only id and text are read.
    """
    rows, again, distinct = _distinct(documents, least, id, text)
    anchors = distinct.mapInPandas(_anchors(least)[0], _ANCHOR)
    return _extended(rows, _seeds(anchors.withColumn("hot", F.lit(False)), least, limit), least), again


_ANCHOR = "h long, id long, at int, left int, near int"


def _seeds(anchors: DataFrame, least: int, limit: int = meet.LIMIT) -> DataFrame:
    """(a, b, p, r): the leftmost common window of each pair of equal runs; where both records have hot windows, which are
    missing here, all common windows."""
    period = _anchors(least)[1]

    def leftmost(c: meet.Columns, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        before = np.where((c["at"][i] - c["at"][j]) % period == 0, 0, 1)
        x, y = (np.where(before == 0, c["near"][k], c["left"][k]) for k in (i, j))
        return (c["id"][i] != c["id"][j]) & ((x == 0) | (y == 0) | (x != y) | c["hot"][i] & c["hot"][j])

    def seed(c: meet.Columns, i: np.ndarray, j: np.ndarray) -> meet.Columns:
        turned = c["id"][i] > c["id"][j]
        a, b = np.where(turned, j, i), np.where(turned, i, j)
        return {"a": c["id"][a], "b": c["id"][b], "p": c["at"][a], "r": c["at"][b]}

    return meet.pairs(anchors, "h", "id", leftmost, seed, "a long, b long, p int, r int", "seeds", limit)


def _extended(rows: DataFrame, seeds: DataFrame, least: int) -> DataFrame:
    texts = bloom.meeting(rows, seeds.select(F.col("a").alias("id")).unionByName(seeds.select(F.col("b").alias("id"))))
    tile = [F.shiftright("p", TILE).alias("_p"), F.shiftright("r", TILE).alias("_r")]
    per_tile = seeds.groupBy("a", "b", *tile).agg(F.collect_list(F.struct("p", "r")).alias("seeds")).drop("_p", "_r")
    joined = per_tile.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.mapInPandas(_extend(least), "a long, b long, a_start int, b_start int, length int")


def pairs(found: DataFrame, again: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b), a < b: all pairs of records with a common span, those of equal text included."""
    firsts = again.where(F.col("size") >= least)
    whole = firsts.select("id", "first").unionByName(firsts.select(F.col("first").alias("id"), "first").distinct())
    x, y = whole.select(F.col("id").alias("p"), F.col("first").alias("cp")), whole.select(F.col("id").alias("q"), F.col("first").alias("cq"))
    same = x.join(y, (F.col("cp") == F.col("cq")) & (F.col("p") < F.col("q"))).select(F.col("p").alias("a"), F.col("q").alias("b"))
    linked = found.select(F.col("a").alias("cp"), F.col("b").alias("cq")).distinct().join(x, "cp", "left").join(y, "cq", "left").select(F.coalesce("p", "cp").alias("p"), F.coalesce("q", "cq").alias("q"))
    return same.unionByName(linked.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters in the union of intervals, of rows sorted by id and start."""
    at, high, total = None, 0, 0
    for pdf in batches:
        out = []
        for id, start, end in zip(pdf["id"], pdf["start"], pdf["end"]):
            if id != at:
                if at is not None:
                    out.append((at, total))
                at, high, total = id, 0, 0
            total += max(0, end - max(start, high))
            high = max(high, end)
        yield pd.DataFrame(out, columns=["id", "shared"])
    if at is not None:
        yield pd.DataFrame([(at, total)], columns=["id", "shared"])


def _windows(least: int):
    """Hashes of all windows of ``least`` characters that hold one of a record's hot windows: (h, id, start)."""
    period = _anchors(least)[1]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers(BLOCK + least)
        for pdf in batches:
            for id, text, hot in zip(pdf["id"], pdf["text"], pdf["hot"]):
                wanted = np.zeros(max(0, len(text) - least + 1) + 1, np.int64)
                for at in hot:  # windows that begin at most period - 1 before it
                    wanted[min(max(0, at - period + 1), len(wanted) - 1)] += 1
                    wanted[min(at + 1, len(wanted) - 1)] -= 1
                starts = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                for block in range(0, len(text), BLOCK):
                    own = starts[(starts >= block) & (starts < block + BLOCK)] - block
                    if len(own):
                        c = mix(codes(text[block : block + BLOCK + least - 1]).astype(np.uint64) + np.uint64(1))
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers.up[: len(c)])])
                        h = mix((total[own + least] - total[own]) * powers.down[own])
                        yield pd.DataFrame({"h": h.view(np.int64), "id": np.full(len(own), id, np.int64), "start": own + block})

    return make


def coverage(documents: DataFrame, least: int = LEAST, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(id, chars, shared, share): for each record how many of its characters stand in a span shared elsewhere.

    A copy of another record's text is shared whole, if it is long enough.  Null texts have null chars and share 0.

    No pairs are made of passages that many records share: hashed windows that come more than ``hot`` times are taken out of
    the join, and around them every window of ``least`` characters is hashed and counted instead, which grows with the
    characters there and not with their pairs.  The result is the same for every ``hot``.
    """
    rows, again, distinct = _distinct(documents, least, id, text)
    anchors = distinct.mapInPandas(_anchors(least)[0], _ANCHOR)
    often = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "hot-windows")
    hot_at = anchors.select("h", "id", "at").join(often, "h", "left_semi").groupBy("id").agg(F.collect_set("at").alias("hot"))
    hot_at = cut(hot_at, "hot-records")  # as many positions as the record has
    cold = anchors.join(often, "h", "left_anti").join(hot_at.select("id", F.lit(True).alias("hot")), "id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    found = cut(_extended(rows, _seeds(cold, least), least), "spans")
    ends = found.select(F.col("a").alias("id"), F.col("a_start").alias("start"), "length").unionByName(found.select(F.col("b").alias("id"), F.col("b_start").alias("start"), "length"))
    windows = distinct.join(hot_at, "id").mapInPandas(_windows(least), "h long, id long, start int")
    common = windows.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    ends = ends.unionByName(windows.join(common, "h", "left_semi").select("id", "start", F.lit(least).alias("length")))
    merged = ends.select("id", "start", (F.col("start") + F.col("length")).alias("end")).repartition("id").sortWithinPartitions("id", "start").mapInPandas(_covered, "id long, shared long")
    sizes = documents.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.char_length(text).alias("chars")).join(again.select("id", "first"), "id", "left")
    copied = again.select(F.col("first").alias("id")).distinct().withColumn("copied", F.lit(True))
    sizes = sizes.join(copied, "id", "left").withColumn("class", F.coalesce("first", "id")).join(merged.withColumnRenamed("id", "class"), "class", "left")
    whole = (F.col("first").isNotNull() | F.coalesce("copied", F.lit(False))) & (F.col("chars") >= least)
    shared = F.when(whole, F.col("chars").cast("long")).otherwise(F.coalesce("shared", F.lit(0).cast("long")))
    return sizes.select("id", "chars", shared.alias("shared"), F.coalesce(shared / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0)).alias("share"))
