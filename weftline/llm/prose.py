"""Statistics of each document, and the shares of prose, list, table and junk in it.

Every line becomes a few discrete observations (share of common words, symbols, delimiters, how it begins and ends, ...);
a long line is observed in several pieces, but counts as one line in the statistics.  A hidden Markov model with one state
for each kind of text labels lines and pieces; the labels' shares, weighted by characters, are the document's.  The model is
fitted at each run on a bounded sample: lines that rules know for certain give the first tables, a few rounds of
expectation-maximisation on the whole sample the rest.  Then one pass without a shuffle labels every document.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import HAN
from weftline.llm.shingles import pieces
from weftline.operators.spread import spread

KINDS = ("prose", "list", "table", "junk")
#: Documents that the model is fitted on, at most, and characters of each of them, at most: the driver holds no more.
SAMPLE = 2000
SAMPLE_CHARS = 20_000
#: Common words, at most; they go to every task.
MOST_WORDS = 100_000
#: A line longer than this is labelled in pieces, parted after sentences or at blanks.
LONG = 240
#: Lines of documents that are labelled side by side, padded ones included, at most; a longer document is labelled alone.
CELLS = 1 << 17
ROUNDS = 6
#: What a Han character of a common word counts: grammar takes fewer characters there than words elsewhere.
HAN_WEIGHT = 1.4

_TOKEN = re.compile(f"[{HAN}]+|[^\\W_{HAN}]+")
_WIDE = re.compile("[\uff01-\uff5e]")
#: Full-width forms and what they are made of.
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
ENDS = frozenset(".?!…。？！")
CLOSERS = "\"'”’»)]」』"
_PART = re.compile(r"(?<=[.?!;。？！；])\s*|\s+")
_START = re.compile(r"(?:(\[[ xX]?\])|([-*•◦▪‣·–—+])|(\(?(?:\d{1,4}|[a-zA-Z])[.):])|(\|))\s")
#: Characters that are no symbols, besides letters and digits.
PLAIN = " .,?!'\"’“”。，？！、;:；：()-—"
_SYMBOL = re.compile(f"[^\\w{re.escape(PLAIN)}]|_")
_COMMA = re.compile(r"(?<=\S),(?=\S)")
_WORDS = str.maketrans({chr(c): chr(c) if chr(c).isalnum() else " " for c in range(128)})
_SYMBOLS = str.maketrans({chr(c): None for c in range(128) if chr(c).isalnum() or chr(c) in PLAIN})


class Lexicon(NamedTuple):
    """The common words: those of scripts with blanks, and a pattern of the Han ones, longest first."""

    words: frozenset[str]
    han: re.Pattern

    @staticmethod
    def of(rows: list[str]) -> Lexicon:
        han = re.compile(f"[{HAN}]")
        chinese = sorted((w for w in rows if han.match(w)), key=lambda w: (-len(w), w))
        return Lexicon(frozenset(w.lower() for w in rows if not han.match(w)), re.compile("|".join(map(re.escape, chinese)) or r"(?!)"))


def _pieces(line: str) -> list[str]:
    if len(line) <= LONG:
        return [line]
    out, start, last = [], 0, 0
    for m in _PART.finditer(line):
        if m.end() - start > LONG and last > start:
            out.append(line[start:last])
            start = last
        last = m.end()
    if len(line) - start > LONG and last > start:
        out.append(line[start:last])
        start = last
    rest = line[start:]
    return out + [rest[k : k + LONG] for k in range(0, len(rest), LONG)]


def lines_of(text: str) -> list[str]:
    """Lines that are not blank, without outer white space; entities resolved and full-width forms made plain."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii() and _WIDE.search(text):
        text = text.translate(WIDE)
    return [s for line in text.splitlines() if (s := line.strip())]


class Line(NamedTuple):
    chars: int
    words: int
    letters: int
    common: float
    symbols: int
    ends: bool
    seen: tuple[int, ...]


#: Values of each observation.
SIZES = (6, 3, 5, 4, 5, 6, 6, 4, 3)


#: Where the values of observations part.
_SHARE, _TIGHT, _SYMBOLIC, _COUNT, _LENGTH, _ODD, _DISTINCT = (0.001, 0.08, 0.15, 0.24, 0.36), (0.001, 0.15, 0.4), (0.001, 0.04, 0.12, 0.3), (1, 2, 4, 8, 16), (2.5, 4, 7, 12), (0.001, 0.15, 0.4), (0.35, 0.6)


def _counted(s: str, lexicon: Lexicon) -> tuple:
    """(words, letters, common, odd, characters of Han, tokens, symbols) of a stripped line."""
    if s.isascii():
        tokens = s.lower().translate(_WORDS).split()
        symbols = len(s.translate(_SYMBOLS))
    else:
        tokens = _TOKEN.findall(s.lower())
        symbols = len(_SYMBOL.findall(s))
        if _HAN_ONE.search(s):
            n = letters = han = odd = 0
            common = 0.0
            for t in tokens:
                letters += len(t)
                if _HAN_ONE.match(t):
                    han += len(t)
                    n += len(t)
                    common += HAN_WEIGHT * sum(map(len, lexicon.han.findall(t)))
                else:
                    n += 1
                    common += t in lexicon.words
                    odd += not t.isalpha()
            return n, letters, common, odd, han, tokens, symbols
    n = len(tokens)
    return n, sum(map(len, tokens)), float(sum(map(lexicon.words.__contains__, tokens))), n - sum(map(str.isalpha, tokens)), 0, tokens, symbols


def _figures(s: str, lexicon: Lexicon) -> tuple:
    """(chars, words, letters, common, symbols, ends, *observations) of a stripped line."""
    n, letters, common, odd, han, tokens, symbols = _counted(s, lexicon)
    chars = len(s) - s.count(" ")
    ends = s.rstrip(CLOSERS)[-1:] in ENDS
    start = _START.match(s + " ")
    tight = s.count("|") + s.count("\t") + s.count(";") + s.count("=") + (len(_COMMA.findall(s)) if "," in s else 0)
    units = max(1, n if not han else len(tokens))
    return (
        chars,
        n,
        letters,
        common,
        symbols,
        ends,
        bisect_right(_SHARE, min(1.0, common / n) if n else 0.0),
        2 if ends else int(not s[-1:].isalnum()),
        start.lastindex if start else 0,
        bisect_right(_TIGHT, tight / units),
        bisect_right(_SYMBOLIC, symbols / max(1, chars)),
        bisect_right(_COUNT, n),
        5 if han > letters / 2 else bisect_right(_LENGTH, letters / max(1, (len(tokens) if not han else 0) or n)),
        bisect_right(_ODD, odd / max(1, n)),
        bisect_right(_DISTINCT, len(set(tokens)) / len(tokens) if len(tokens) >= 8 else 1.0),
    )


def observe(line: str, lexicon: Lexicon) -> Line:
    """Figures of one line and its observations."""
    chars, words, letters, common, symbols, ends, *seen = _figures(line.strip(), lexicon)
    return Line(chars, words, letters, common, symbols, ends, tuple(seen))


def observed(text: str | None, lexicon: Lexicon) -> tuple[list[tuple], list[tuple]]:
    """Figures of the lines of a text, and of the lines and pieces that are labelled."""
    whole, parts = [], []
    for line in () if text is None else lines_of(text):
        own = _figures(line, lexicon)
        whole.append(own)
        if len(line) <= LONG:
            parts.append(own)
        else:
            parts += [_figures(s, lexicon) for p in _pieces(line) if (s := p.strip())]
    return whole, parts


_HAN_ONE = re.compile(f"[{HAN}]")


def certain(figures: np.ndarray) -> np.ndarray:
    """The kinds of lines that rules know, -1 for others; rows as those of ``_figures``."""
    chars, words, common = figures[:, 0], figures[:, 1], figures[:, 3]
    _, end, start, tight, symbols, size, length, odd, distinct = figures[:, 6:].T
    share = common / np.maximum(1, words)
    rules = [
        ((distinct == 0) | (symbols == 4) & (tight < 2) & (share < 0.08) | (words == 0) & (chars > 4), 3),
        ((share >= 0.24) & (words >= 5) & (tight <= 1) & (symbols <= 2), 0),
        (share >= 0.08, -1),
        ((start >= 1) & (start <= 3) & (words <= 12) & (tight <= 1), 1),
        ((start == 4) | (tight >= 2), 2),
        ((length == 4) | (odd == 3) & (words >= 4) | (words >= 14), 3),
    ]
    return np.select([r for r, _ in rules], [k for _, k in rules], -1)


class Model(NamedTuple):
    """Logarithms of the first state's, the steps' and the observations' probabilities."""

    first: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]


def _log_emit(model: Model, seen: np.ndarray) -> np.ndarray:
    return sum(table[:, seen[:, k]].T for k, table in enumerate(model.emit))


def _side_by_side(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents with lines, in groups of like length that padded hold at most CELLS lines or are one document."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * lengths[order[last]] <= CELLS:
            last += 1
        yield order[first:last]
        first = last


def _grid(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as rows of a padded array of line numbers, and which cells are filled."""
    filled = np.arange(lengths.max()) < lengths[:, None]
    return np.where(filled, starts[:, None] + np.arange(lengths.max()), 0), filled


def fitted(figures: np.ndarray, lengths: np.ndarray) -> Model:
    """The model of a sample: rows of ``_figures``, and each document's number of rows. Every probability has a prior, so an
    empty sample gives a usable model."""
    K = len(KINDS)
    prior = 2.0
    stay = np.full((K, K), 1.0) + 8 * np.eye(K)
    seen, known = figures[:, 6:].astype(int), certain(figures)
    weight = np.zeros((len(known), K))
    weight[known >= 0, known[known >= 0]] = 1
    fixed = np.where(known[:, None] >= 0, np.where(weight > 0, 0.0, -8.0), 0.0)

    def tables(w: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, size in enumerate(SIZES):
            t = np.stack([np.bincount(seen[:, k], w[:, j], size) for j in range(K)]) + prior
            out.append(np.log(t / t.sum(1, keepdims=True)))
        return out

    model = Model(np.log(np.array([0.55, 0.15, 0.15, 0.15])), np.log(stay / stay.sum(1, keepdims=True)), tables(weight))
    if not len(known):
        return model
    starts = np.cumsum(lengths) - lengths
    for _ in range(ROUNDS):
        e = _log_emit(model, seen) * 0.7 + fixed
        post, steps, first = np.zeros((len(seen), K)), np.zeros((K, K)), np.zeros(K)
        for part in _side_by_side(lengths):
            at, filled = _grid(starts[part], lengths[part])
            g = np.where(filled[:, :, None], e[at], 0.0)
            forward, backward = np.zeros(g.shape), np.zeros(g.shape)
            forward[:, 0] = model.first + g[:, 0]
            for t in range(1, g.shape[1]):
                s = forward[:, t - 1, :, None] + model.step
                forward[:, t] = np.logaddexp.reduce(s, 1) + g[:, t]
            for t in range(g.shape[1] - 2, -1, -1):
                s = model.step + (g[:, t + 1] + backward[:, t + 1])[:, None, :]
                backward[:, t] = np.where(filled[:, t + 1, None], np.logaddexp.reduce(s, 2), 0.0)
            both = forward + backward
            both -= np.logaddexp.reduce(both, 2)[:, :, None]
            post[at[filled]] = np.exp(both[filled])
            first += np.exp(both[:, 0]).sum(0)
            for t in range(g.shape[1] - 1):
                s = forward[:, t, :, None] + model.step + (g[:, t + 1] + backward[:, t + 1])[:, None, :]
                s = s[filled[:, t + 1]]
                if len(s):
                    s = s - np.logaddexp.reduce(s.reshape(len(s), -1), 1)[:, None, None]
                    steps += np.exp(s).sum(0)
        move = steps + stay * 10
        start = first + 10
        model = Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), tables(post + 4 * weight))
    return model


def _rows(documents: list[list[Line]]) -> tuple[np.ndarray, np.ndarray]:
    rows = [(x.chars, x.words, x.letters, x.common, x.symbols, x.ends, *x.seen) for d in documents for x in d]
    return np.array(rows, float).reshape(-1, 6 + len(SIZES)), np.array([len(d) for d in documents], int)


def fit(documents: list[list[Line]]) -> Model:
    """The model of a sample of documents."""
    return fitted(*_rows(documents))


def paths(model: Model, seen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most probable kinds of the lines of documents that lie one after the other."""
    out, starts = np.zeros(len(seen), np.int8), np.cumsum(lengths) - lengths
    for part in _side_by_side(lengths):
        n = lengths[part]
        at, filled = _grid(starts[part], n)
        score = model.first + _log_emit(model, seen[at[:, 0]])
        back = np.zeros((*at.shape, len(KINDS)), np.int8)
        last = score.copy()
        for t in range(1, at.shape[1]):
            s = score[:, :, None] + model.step
            back[:, t] = s.argmax(1)
            score = s.max(1) + _log_emit(model, seen[at[:, t]])
            last = np.where(filled[:, t, None], score, last)
        now, row = last.argmax(1), np.arange(len(part))
        for t in range(at.shape[1] - 1, -1, -1):
            here = filled[:, t]
            out[at[here, t]] = now[here]
            now = np.where(here, back[row, t, now], now)
    return out


def label(model: Model, documents: list[list[Line]]) -> list[np.ndarray]:
    """The most probable kinds of each document's lines."""
    figures, lengths = _rows(documents)
    return np.split(paths(model, figures[:, 6:].astype(int), lengths).astype(int), np.cumsum(lengths)[:-1])


def _fitted(documents: DataFrame, lexicon: Lexicon, most: int, seed: int) -> Model:
    """The model of at most ``most`` documents of at most SAMPLE_CHARS characters, drawn by hash."""
    rows = documents.where("text is not null and doc_id is not null").where(F.char_length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    draw = F.xxhash64("doc_id") if not seed else F.xxhash64(F.lit(seed), "doc_id")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(draw, F.lit(1_000_000_007)) < int(1.2 * most / n * 1_000_000_007)).orderBy(draw, "doc_id").limit(most)
    figures, lengths = [], []
    for r in rows.select("text").toLocalIterator():
        parts = observed(r["text"], lexicon)[1]
        figures.append(np.array(parts, float).reshape(-1, 6 + len(SIZES)))
        lengths.append(len(parts))
    return fitted(np.concatenate([np.empty((0, 6 + len(SIZES))), *figures]), np.array(lengths, int))


_STATISTICS = "doc_id long, chars long, words long, lines long, mean_word_length double, symbol_ratio double, ending_lines double, common_words double"
_COLUMNS = _STATISTICS + ", " + ", ".join(f"{k} double" for k in KINDS)


def statistics(documents: DataFrame, common_words: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """One row of statistics and label shares for each document.

    Takes doc_id and text; further columns are not read.  A null text counts as empty; a text without a line has zeros
    everywhere; rows without doc_id are left out.  Lines are those of the text, blank ones aside, however long.  Label shares
    are by characters without blanks and add up to 1.  Rows that come twice give two rows.  ``common_words`` (lang, word) is a
    fixed list; more than MOST_WORDS fail, null ones are left out.  ``sample`` and ``seed`` say which documents fit the model.
    """
    listed = common_words.where("word is not null").select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    lexicon = Lexicon.of(sorted(r["word"] for r in listed))
    model = _fitted(documents, lexicon, sample, seed)
    sent = documents.sparkSession.sparkContext.broadcast((lexicon, model))
    columns = [c.split()[0] for c in _COLUMNS.split(", ")]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = sent.value
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            for low, high in pieces(texts):
                whole, parts, lines, labelled = [], [], [], []
                for t in texts[low:high]:
                    w, p = observed(t, lexicon)
                    whole.append(np.array([x[:6] for x in w], float).reshape(-1, 6).sum(0))
                    parts.append(np.array(p, np.float32).reshape(-1, 6 + len(SIZES)))
                    lines.append(len(w))
                    labelled.append(len(p))
                chars, words, letters, common, symbols, ends = np.array(whole).T
                figures, labelled, lines = np.concatenate(parts), np.array(labelled), np.array(lines)
                kinds = paths(model, figures[:, 6:].astype(np.int8), labelled)
                of = np.repeat(np.arange(high - low), labelled)
                weight = np.bincount(of * len(KINDS) + kinds, figures[:, 0], (high - low) * len(KINDS)).reshape(-1, len(KINDS))
                shares = weight / np.maximum(1, weight.sum(1, keepdims=True))
                figures = (ids[low:high], chars, words, lines, letters / np.maximum(1, words), symbols / np.maximum(1, chars), ends / np.maximum(1, lines), common / np.maximum(1, words), *shares.T)
                yield pd.DataFrame(dict(zip(columns, figures))).astype({c: np.int64 for c in columns[:4]})

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInPandas(describe, _COLUMNS)


def not_prose(documents: DataFrame, common_words: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """Statistics of the documents of which more than half is list, table or junk."""
    return statistics(documents, common_words, sample, seed).where("chars > 0 and prose < 0.5")
