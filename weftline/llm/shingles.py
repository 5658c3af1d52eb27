"""Sets of word runs of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

from weftline.functions.text import WordHashes, runs, words

#: Characters of texts that are taken at once, about; a longer text is taken alone.
CHARS = 1 << 22


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS characters together."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= CHARS:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def run_sets(texts: list[str | None], n: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, runs, times): the distinct hashes of each text's runs of ``n`` words in order, one text after the other, how often
    each comes, and where each text's end; a null text has none."""
    found = [[] if t is None else words(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = hashes(list(chain.from_iterable(found)))
    of = np.repeat(np.arange(len(found)), lengths)
    all_runs = runs(flat, n)
    within = of[: len(all_runs)] == of[n - 1 :] if len(all_runs) else np.empty(0, bool)
    all_runs, of = all_runs[within], of[: len(within)][within]
    bounds = np.r_[0, np.cumsum(np.maximum(lengths - n + 1, 0))]
    for a, b in zip(bounds[:-1], bounds[1:]):
        all_runs[a:b].sort()
    new = np.ones(len(all_runs), bool)
    new[1:] = (all_runs[1:] != all_runs[:-1]) | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.r_[starts, len(all_runs)])
    return np.cumsum(np.bincount(of[starts], minlength=len(found))), all_runs[starts], times


def blobs(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each text's values."""
    data, width = values.tobytes(), values.itemsize
    bounds = [0, *(ends * width).tolist()]
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]
