"""Evaluation texts inside training text, also with other numbers, names or units.

Words become template words: numbers, names and units give way to typed placeholders (slots), everything else stays.  Runs
of ``n`` template words of the items are hashed and joined with those of the documents; where they meet, the words in the
slots decide.  There are two templates of a text.

*Narrow*: numbers, and units beside a number of the same run, are slots.  That depends on nothing but the run's own words, so
equal words always make equal runs; a run that meets with equal slots is verbatim, one with other slots is not.

*Wide*: names are slots too, as their surroundings show them: capitals inside a sentence and no article or the like before;
in Chinese a familiar prefix, or a surname that comes again with the same character after it.  Neighbouring names or numbers
are one slot.  All runs that meet on one diagonal of an item and a document are one alignment; it is a re-parameterised item
if one mapping, one to one, turns the item's slots into the document's over the whole alignment.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.functions.text import HAN, WordHashes, mix, words
from weftline.llm.shingles import pieces
from weftline.operators.spread import spread
from weftline.scratch import cut

#: Item runs that are sent to every task; more are joined by a shuffle, with the same result.
MOST_RUNS = 400_000
#: Runs that meet which are looked at together, about.
MET = 500_000
#: Words that stand before common nouns, not before names: those of German, which writes nouns with capitals, also with one word between. Fixed values.
GERMAN = frozenset("der die das den dem des ein eine einen einem einer eines kein keine keinen mein dein sein ihr unser euer dieser diese dieses jeder jede jedes im am zum zur vom beim".split())
ARTICLES = frozenset(
    "the a an this that these those my your his her its our their some any each every no another which what "
    "el la los las un una unos unas mi tu su este esta estos estas cada del al "
    "le les une du au aux mon ton son ma ta sa ce cette ces chaque".split()
)
#: Units of measure and currency, which are units only beside a number. Fixed values.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp cny dollar dollars euro euros cent cents yuan percent kb mb gb tb "
    "stunde stunden tag tage woche wochen monat monate jahr jahre sekunde sekunden minuten prozent heure heures jour jours semaine semaines mois an ans année années hora horas día días semana semanas mes meses año años "
    "米 克 元 吨 升 秒 天 年 月 岁 里 斤 %".split()
)
#: Characters before a familiar name, and what makes other words of them. Fixed values.
FAMILIAR, NOT_NAMES = "小老阿", "时学心说数区麦组师板虎鼠们子孩伙是的了在大百"
#: Common surnames. Fixed values.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"

#: Codes of words.
_NUMBER, _UNIT, _ARTICLE, _FAMILIAR, _SURNAME, _OTHER_HAN, _HAN_NAME, _STOP, _GERMAN = (1 << k for k in range(9))
#: Template words of slots, and kinds of slots.
_SLOTS = np.array([0, *WordHashes()(["\0number", "\0unit", "\0name"])], np.uint64)
_STOPS = ".!?:\"\n"
_ASCII = str.maketrans({c: chr(c) if chr(c).isalnum() else " . " if chr(c) in _STOPS else " " for c in range(128)})
_CASED = re.compile(f"[{HAN}]|[^\\W_{HAN}]+|[.!?:\"\n。！？：“”「」]")
_HAN = re.compile(f"[{HAN}]")
_STOP_TOKENS = frozenset(".!?:\"\n。！？：“”「」")


def _cased(text: str) -> list[str]:
    """Words as written and marks after which a sentence begins."""
    if "&" in text:
        text = html.unescape(text)
    return text.translate(_ASCII).split() if text.isascii() else _CASED.findall(unicodedata.normalize("NFKC", text))


def _code(word: str) -> int:
    if word in _STOP_TOKENS:
        return _STOP
    if len(word) == 1 and _HAN.match(word):
        code = (_FAMILIAR if word in FAMILIAR else 0) | (_SURNAME if word in SURNAMES else 0) | (_OTHER_HAN if word in NOT_NAMES else _HAN_NAME)
        return code | (_UNIT if word in UNITS else 0)
    if not word.isalpha() and any(c.isnumeric() for c in word):
        return _NUMBER
    return (_UNIT if word in UNITS else 0) | (_ARTICLE if word in ARTICLES else _ARTICLE | _GERMAN if word in GERMAN else 0)


class Codes:
    """Codes of words, with a cache of bounded size."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint16, len(found))
        except KeyError:
            for w in set(found):
                if w not in known:
                    known[w] = _code(w)
            return np.fromiter(map(known.__getitem__, found), np.uint16, len(found))


class Template(NamedTuple):
    """Template words of several texts: the text each belongs to, its hash, its kind of slot (0 if none), and the hash of
    what stands there."""

    of: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    value: np.ndarray


def _shifted(x: np.ndarray, by: int, of: np.ndarray) -> np.ndarray:
    """What stands ``by`` places before, false at the beginning of a text; after, for negative ``by``."""
    out = np.zeros(len(x), x.dtype)
    if 0 < by < len(x):
        out[by:] = np.where(of[by:] == of[:-by], x[:-by], 0)
    elif by < 0 and -by < len(x):
        out[:by] = np.where(of[:by] == of[-by:], x[-by:], 0)
    return out


class Maker:
    """Templates of texts."""

    def __init__(self) -> None:
        self.hashes, self.codes = WordHashes(), Codes()

    def __call__(self, texts: list[str | None]) -> tuple[Template, np.ndarray, np.ndarray, Template]:
        """The narrow template, its kinds where nothing stands before and where nothing stands after, and the wide template."""
        cased = [[] if t is None else _cased(t) for t in texts]
        of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cased), np.int64, len(cased)))
        flat = list(chain.from_iterable(cased))
        lower = list(map(str.lower, flat))
        code = self.codes(lower)
        title = np.fromiter(map(str.istitle, flat), bool, len(flat))
        stop = code == _STOP
        first = _shifted(~stop, 1, of) == 0
        keep = ~stop
        of, code, title, first = of[keep], code[keep], title[keep], first[keep]
        raw = self.hashes([w for w, k in zip(lower, keep) if k])
        wide = self._wide(of, code, title, first, raw)
        odd = [k for k, t in enumerate(texts) if t and "İ" in t]  # the one letter that lower case splits
        if odd:
            own = [words(t) if k in odd else [w for w in map(str.lower, c) if w not in _STOP_TOKENS] for k, (t, c) in enumerate(zip(texts, cased))]
            flat = list(chain.from_iterable(own))
            of, code, raw = np.repeat(np.arange(len(texts)), np.fromiter(map(len, own), np.int64, len(own))), self.codes(flat), self.hashes(flat)
        number = code == _NUMBER
        unit = (code & _UNIT) > 0
        after, before = unit & _shifted(number, 1, of), unit & _shifted(number, -1, of)
        kinds = [np.where(number, 1, np.where(u, 2, 0)).astype(np.int8) for u in (after | before, before, after)]
        return Template(of, np.where(kinds[0] > 0, _SLOTS[kinds[0]], raw), kinds[0], raw), kinds[1], kinds[2], wide

    def _wide(self, of: np.ndarray, code: np.ndarray, title: np.ndarray, first: np.ndarray, raw: np.ndarray) -> Template:
        number = code == _NUMBER
        unit = ((code & _UNIT) > 0) & (_shifted(number, 1, of) | _shifted(number, -1, of))
        article = (code & _ARTICLE) > 0
        guided = _shifted(article, 1, of) & ~first | _shifted((code & _GERMAN) > 0, 2, of) & ~first & ~_shifted(first, 1, of)
        name = title & ~first & ~guided & ~number & ~article
        key = mix(raw + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if name.any():
            name |= title & first & ~article & np.isin(key, key[name])
        # a familiar prefix and a character; a surname and a character that come together again in the text
        next_han = _shifted((code & _HAN_NAME) > 0, -1, of)
        pair = ((code & _FAMILIAR) > 0) & next_han
        surname = np.flatnonzero(((code & _SURNAME) > 0) & next_han)
        if len(surname):
            _, at, n = np.unique(mix(key[surname] + raw[surname + 1]), return_inverse=True, return_counts=True)
            pair[surname[n[at] > 1]] = True
        name |= pair | _shifted(pair, 1, of)
        kind = np.where(number, 1, np.where(name, 3, np.where(unit, 2, 0))).astype(np.int8)
        merged = ((kind == 1) | (kind == 3)) & (kind == _shifted(kind, 1, of))
        starts = np.flatnonzero(~merged)
        if not len(starts):
            return Template(of, raw, kind, raw)
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        value = np.add.reduceat(np.where(place > 0, mix(raw + place.astype(np.uint64)), raw), starts)
        of, kind = of[starts], kind[starts]
        return Template(of, np.where(kind > 0, _SLOTS[kind], value), kind, value)


def _run_hashes(word: np.ndarray, n: int, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of ``n``; the words at their ends may differ from those inside."""
    count = len(word) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        source = first if i == 0 and first is not None else last if i == n - 1 and last is not None else word
        total = mix(total + source[i : i + count] + np.uint64(i + 1))
    return total


class Runs(NamedTuple):
    """Runs of several texts: the text, the place in its template and in the piece, the template's hash, and for narrow runs
    the hash of the words in slots."""

    of: np.ndarray
    at: np.ndarray
    flat: np.ndarray
    template: np.ndarray


def _within(of: np.ndarray, n: int) -> np.ndarray:
    count = max(0, len(of) - n + 1)
    return np.flatnonzero(of[:count] == of[n - 1 :]) if count else np.empty(0, np.int64)


def _places(of: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The place of positions in their texts."""
    return flat - np.searchsorted(of, of[flat])


def _narrow_runs(t: Template, alone_first: np.ndarray, alone_last: np.ndarray, n: int) -> Runs:
    ends = [np.where(k > 0, _SLOTS[k], t.value) for k in (alone_first, alone_last)]
    at = _within(t.of, n)
    return Runs(t.of[at], _places(t.of, at), at, _run_hashes(t.word, n, *ends)[at])


def _wide_runs(t: Template, n: int, least_plain: int) -> Runs:
    """Runs with a slot and enough words that are none."""
    at = _within(t.of, n)
    slots = np.r_[0, np.cumsum(t.kind > 0)]
    slots = slots[at + n] - slots[at]
    at = at[(slots > 0) & (n - slots >= least_plain)]
    return Runs(t.of[at], _places(t.of, at), at, _run_hashes(t.word, n)[at])


def _slot_hashes(t: Template, alone_first: np.ndarray, alone_last: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the slots of narrow runs, and how many slots there are."""
    total, slots = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64)
    for i in range(n):
        kind = (alone_first if i == 0 else alone_last if i == n - 1 else t.kind)[flat + i]
        total = np.where(kind > 0, mix(total + t.value[flat + i] + np.uint64(i + 1)), total)
        slots += kind > 0
    return total, slots


_RUN = "wide boolean, row long, id long, at int, template long, slots array<long>, held int"


def _runs_of(n: int, least_plain: int, asked: bloom.Tester | None = None):
    """Rows of runs: for narrow ones slots has one hash of all slots, for wide ones the hash in each slot; held is their
    number.  With ``asked`` only runs whose template it lets through."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Maker()
        for pdf in batches:
            texts, ids, rows = pdf["text"].tolist(), pdf["id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
            for low, high in pieces(texts):
                t, first, last, wide = maker(texts[low:high])
                for is_wide, own, r in ((False, t, _narrow_runs(t, first, last, n)), (True, wide, _wide_runs(wide, n, least_plain))):
                    take = np.arange(len(r.of)) if asked is None else np.flatnonzero(asked(r.template)) if len(r.of) else np.empty(0, np.int64)
                    for k in range(0, len(take), 50_000):
                        some = take[k : k + 50_000]
                        flat = r.flat[some]
                        if is_wide:
                            at = flat[:, None] + np.arange(n)
                            slots = [v[s].view(np.int64) for v, s in zip(own.value[at], own.kind[at] > 0)]
                            held = [len(s) for s in slots]
                        else:
                            value, held = _slot_hashes(own, first, last, flat, n)
                            slots = list(value.view(np.int64)[:, None])
                        yield pd.DataFrame({"wide": is_wide, "row": rows[low:high][r.of[some]], "id": ids[low:high][r.of[some]], "at": r.at[some].astype(np.int32), "template": r.template[some].view(np.int64), "slots": slots, "held": np.asarray(held, np.int32)})

    return make


_LEAK = "doc_id long, item_id long, exact_runs long, exact_slot_runs long, other_runs long, refused_runs long"


def leaks(documents: DataFrame, items: DataFrame, n: int = 12, least_plain: int = 6, most_runs: int = MOST_RUNS) -> DataFrame:
    """(doc_id, item_id, exact_runs, exact_slot_runs, other_runs, refused_runs): runs of ``n`` template words of an item in a document.

    exact_runs are verbatim, exact_slot_runs those of them with a slot, which only the words in the slots tell from a
    re-parameterised run; other_runs hold another number, name or unit and belong to an alignment with one mapping, one to
    one; refused_runs met too, but their slots follow no such mapping.  Runs are counted by their place in the document,
    once for an item; a wide run needs a slot and ``least_plain`` other words.  Null texts and texts of fewer than ``n`` words have no runs;
    only doc_id, item_id and text are read; an item or document that comes twice counts with all its rows; rows without an id are left out.
    """
    docs = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"))
    item_runs = items.where("item_id is not null").select(F.lit(0).cast("long").alias("row"), F.col("item_id").cast("long").alias("id"), "text").mapInPandas(_runs_of(n, least_plain), _RUN)
    held = item_runs.limit(most_runs + 1).toPandas() if most_runs else pd.DataFrame()
    if most_runs and len(held) <= most_runs:
        sent = documents.sparkSession.sparkContext.broadcast(Table.of(held, n))
        found = docs.mapInPandas(_probe(n, least_plain, sent), _LEAK)
        return found.groupBy("doc_id", "item_id").agg(*[F.sum(c).alias(c) for c in _LEAK.replace(" long", "").split(", ")[2:]])
    item_runs = cut(item_runs, "item-runs")
    bits = bloom.bits_for(item_runs.count())
    asked = bloom.tester(item_runs.select("template"), lambda pdf: pdf["template"].to_numpy(np.int64), bits) if bits <= bloom.PASS_BITS else None
    i = item_runs.select(*[F.col(c).alias(f"i_{c}") for c in ("wide", "id", "at", "template", "slots")])
    d = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInPandas(_runs_of(n, least_plain, asked), _RUN)
    met = cut(d.join(i, (F.col("template") == F.col("i_template")) & (F.col("wide") == F.col("i_wide"))).select("wide", "row", F.col("id").alias("doc_id"), F.col("i_id").alias("item_id"), "at", (F.col("at") - F.col("i_at")).alias("diagonal"), "slots", "i_slots", "held"), "met-runs")
    narrow = met.where("not wide").withColumn("same", F.col("slots") == F.col("i_slots"))
    pair = ["row", "doc_id", "item_id"]
    exact = narrow.where("same").groupBy(*pair, "at").agg(F.max("held").alias("held")).groupBy("doc_id", "item_id").agg(F.count("*").alias("exact_runs"), F.count_if(F.col("held") > 0).alias("exact_slot_runs"))
    line = [*pair, "diagonal"]
    mapped = met.where("wide").select(*line, F.explode(F.arrays_zip(F.col("i_slots").alias("x"), F.col("slots").alias("y"))).alias("m")).distinct()
    checked = mapped.groupBy(*line).agg(F.count("*").alias("n"), F.count_distinct("m.x").alias("x"), F.count_distinct("m.y").alias("y")).select(*line, ((F.col("n") == F.col("x")) & (F.col("n") == F.col("y"))).alias("one"))
    other = met.where("wide").where(F.col("slots") != F.col("i_slots")).join(cut(checked, "alignments"), line).groupBy(*pair, "at").agg(F.max("one").alias("one"))
    other = other.groupBy("doc_id", "item_id").agg(F.count_if("one").alias("other_runs"), F.count_if(~F.col("one")).alias("refused_runs"))
    return exact.join(other, ["doc_id", "item_id"], "full_outer").fillna(0).select(*_LEAK.replace(" long", "").split(", "))


class Table(NamedTuple):
    """All runs of the items in packed arrays, narrow ones and wide ones each by template."""

    template: tuple[np.ndarray, np.ndarray]
    item: tuple[np.ndarray, np.ndarray]
    at: tuple[np.ndarray, np.ndarray]
    slots: tuple[np.ndarray, np.ndarray]  # one hash a run; or n a run, those beyond its slots 0

    @staticmethod
    def of(rows: pd.DataFrame, n: int) -> Table:
        out = []
        for wide in (False, True):
            own = rows[rows["wide"] == wide] if len(rows) else rows
            order = np.argsort(own["template"].to_numpy(np.int64).view(np.uint64), kind="stable") if len(own) else np.empty(0, np.int64)
            slots = np.zeros((len(own), n if wide else 1), np.int64)
            for k, s in enumerate(own["slots"] if len(own) else ()):
                slots[k, : len(s)] = s
            take = (lambda c, t: own[c].to_numpy(t)[order]) if len(own) else (lambda c, t: np.empty(0, t))
            out.append((take("template", np.int64).view(np.uint64), take("id", np.int64), take("at", np.int64), slots[order].view(np.uint64)))
        return Table(*zip(*out))


def _probe(n: int, least_plain: int, sent):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: Table = sent.value
        maker = Maker()
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["id"].to_numpy(np.int64)
            for low, high in pieces(texts):
                t, first, last, wide = maker(texts[low:high])
                own = ids[low:high]
                yield from _exact(t, first, last, n, table, own)
                yield from _other(wide, n, least_plain, table, own)

    return probe


def _met(r: Runs, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs and rows of the table with one template, in portions that end where a text does."""
    if not len(keys) or not len(r.of):
        return
    low = np.searchsorted(keys, r.template)
    hits = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == r.template)
    if not len(hits):
        return
    n = np.searchsorted(keys, r.template[hits], "right") - low[hits]
    portion = np.cumsum(n) // MET
    begins = np.flatnonzero(np.r_[True, r.of[hits][1:] != r.of[hits][:-1]])
    portion = np.repeat(portion[begins], np.diff(np.r_[begins, len(hits)]))
    for p in np.unique(portion):
        some = portion == p
        h, m = hits[some], n[some]
        yield np.repeat(h, m), np.repeat(low[h], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def _counted(ids: np.ndarray, of: np.ndarray, item: np.ndarray, at: np.ndarray, **flags: np.ndarray) -> pd.DataFrame:
    """Places of a text where a run of an item has a flag, each once."""
    rows = pd.DataFrame({"of": of, "item_id": item, "at": at} | flags).groupby(["of", "item_id", "at"], sort=False).max()
    sums = rows.groupby(level=["of", "item_id"], sort=False).sum().reset_index()
    out = pd.DataFrame({"doc_id": ids[sums["of"].to_numpy(np.int64)], "item_id": sums["item_id"]})
    for c in ("exact_runs", "exact_slot_runs", "other_runs", "refused_runs"):
        out[c] = sums[c].astype(np.int64) if c in sums else 0
    return out


def _exact(t: Template, first: np.ndarray, last: np.ndarray, n: int, table: Table, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    r = _narrow_runs(t, first, last, n)
    for run, row in _met(r, table.template[0]):
        value, slots = _slot_hashes(t, first, last, r.flat[run], n)
        same = value == table.slots[0][row, 0]
        if same.any():
            run, row, slots = run[same], row[same], slots[same]
            yield _counted(ids, r.of[run], table.item[0][row], r.at[run], exact_runs=np.ones(len(run), bool), exact_slot_runs=slots > 0)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """How many different values the second and further columns have for each value of the first, which counts from 0."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(31) + c.astype(np.uint64))
    _, at = np.unique(key, return_index=True)
    return np.bincount(columns[0][at], minlength=int(columns[0].max()) + 1)


def _other(t: Template, n: int, least_plain: int, table: Table, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    r = _wide_runs(t, n, least_plain)
    for run, row in _met(r, table.template[1]):
        at = r.flat[run][:, None] + np.arange(n)
        slot = t.kind[at] > 0
        place = np.cumsum(slot, 1) - 1
        theirs = np.take_along_axis(table.slots[1][row], np.maximum(place, 0), 1)
        ours = t.value[at]
        changed = (slot & (theirs != ours)).any(1)
        if not changed.any():
            continue
        item, diagonal = table.item[1][row], r.at[run] - table.at[1][row]
        line = np.unique(np.stack([r.of[run].astype(np.int64), item, diagonal]), axis=1, return_inverse=True)[1].reshape(-1)
        lines = np.broadcast_to(line[:, None], slot.shape)[slot]
        x, y = theirs[slot], ours[slot]
        pairs = _distinct(lines, x, y)
        one = ((pairs == _distinct(lines, x)) & (pairs == _distinct(lines, y)))[line]
        run, item, one = run[changed], item[changed], one[changed]
        out = _counted(ids, r.of[run], item, r.at[run], other_runs=one, met=np.ones(len(run), bool))
        met = pd.DataFrame({"of": r.of[run], "item_id": item, "at": r.at[run]}).drop_duplicates().groupby(["of", "item_id"], sort=False).size()
        out["refused_runs"] = met.to_numpy() - out["other_runs"].to_numpy()
        yield out
