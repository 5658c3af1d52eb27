"""Every operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.text import alnum, clean, words
from weftline.llm import budget, formatting, leakage, mixture, neardup, overlap, prose, spans

VOCABULARY = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "tel") for b in ("n", "rk", "st", "va", "x", "d")]


def sentence(r, n=12):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(r, text, share):
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


def corpus(seed=3, n=60):
    r = random.Random(seed)
    texts = [sentence(r, r.randint(40, 90)) for _ in range(n // 3)]
    while len(texts) < n:
        base = r.choice(texts)
        texts.append(r.choice([base, edited(r, base, 0.03), edited(r, base, 0.12), base.upper() + "!", base + " " + sentence(r, 30), sentence(r, 50)]))
    return texts


def frame(spark, texts, id="doc_id", **more):
    """Texts with ids, and columns whose names clash with those used inside."""
    rows = [(k, t, "x", 1, 2.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{id} long, text string, h string, a int, copies double").repartition(3)


ODD = [None, "", " ", "one", "one two", "\0�", "é" * 3, "。", "{", "{}", "a: b", "word " * 3000]


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def similar(texts, n, least):
    sets = [set() if t is None else shingles(t, n) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


# 1


LEXICON = ["the", "a", "of", "in", "and", "is", "was", "it", "that", "on", "with", "的", "了", "但是"]


def lexicon(spark):
    return spark.createDataFrame([("en", w) for w in LEXICON] + [("en", None)], "lang string, word string")


def natural(r):
    return ". ".join(f"The {r.choice(VOCABULARY)} of a {r.choice(VOCABULARY)} is in the {r.choice(VOCABULARY)} and it was on that {r.choice(VOCABULARY)}" for _ in range(8)) + "."


def kinds(r, kind):
    w = lambda: r.choice(VOCABULARY)
    return {
        "prose": lambda: natural(r),
        "wrapped": lambda: "\n".join(natural(r)[k : k + 40] for k in range(0, 400, 40)),
        "list": lambda: "\n".join(f"- {w()} {w()}" for _ in range(20)),
        "table": lambda: "\n".join(f"| {w()} | {r.randint(1, 99)} | {w()} |" for _ in range(20)),
        "pairs": lambda: "\n".join(f"{w()}=1; {w()}={w()}; {w()}=3.5" for _ in range(20)),
        "symbols": lambda: "\n".join("".join(r.choice("#%&*{}[]<>/\\|~^") for _ in range(60)) for _ in range(12)),
        "blob": lambda: "\n".join("".join(r.choice("abcDEF0123456789+/") for _ in range(76)) for _ in range(12)),
        "pile": lambda: " ".join(w() for _ in range(150)),
        "again": lambda: "bank lost 55 " * 80,
    }[kind]()


def test_prose_is_told_from_the_rest(spark):
    r = random.Random(1)
    names = ["prose"] * 5 + ["wrapped", "list", "table", "pairs", "symbols", "blob", "pile", "again"]
    sample = [(k, kinds(r, r.choice(names))) for k in range(200)]
    fixed = [(1000 + k, kinds(r, n)) for k, n in enumerate(["prose", "wrapped", "list", "table", "pairs", "symbols", "blob", "pile", "again"])]
    mixed = [(2000, natural(r) + "\n- one\n- two\n" + natural(r)), (2001, "It is.\n" + kinds(r, "list"))]
    df = spark.createDataFrame(sample + fixed + mixed, "doc_id long, text string")
    found = {x.doc_id for x in prose.not_prose(df, lexicon(spark)).collect()}
    assert {k for k in found if k >= 1000} == {1002, 1003, 1004, 1005, 1006, 1007, 1008, 2001}
    shares = {x.doc_id: x for x in prose.statistics(df, lexicon(spark)).collect()}
    assert shares[1002]["list"] > 0.8 and shares[1003]["table"] > 0.8 and shares[1005]["junk"] > 0.8
    assert all(abs(sum(x[k] for k in prose.KINDS) - 1) < 1e-9 for x in shares.values())


def test_prose_statistics_of_odd_texts(spark):
    got = {x.doc_id: x for x in prose.statistics(frame(spark, ODD), lexicon(spark)).collect()}
    assert len(got) == len(ODD) and got[0].chars == got[1].chars == 0 and got[11].words == 3000 and got[4].mean_word_length == 3
    assert prose.statistics(frame(spark, ["x"]).where("false"), lexicon(spark).where("false")).count() == 0
    x = prose.statistics(spark.createDataFrame([(1, "The cat is in.\nno end"), (None, "x")], "doc_id long, text string"), lexicon(spark)).collect()
    assert len(x) == 1 and (x[0].words, x[0].lines, x[0].ending_lines, x[0].common_words) == (6, 2, 0.5, 0.5)


def test_a_long_text_beside_short_ones(spark):
    """300,000 lines: labelled alone, in memory that does not grow with the number of texts beside it."""
    r = random.Random(3)
    texts = ["\n".join(f"- item {k % 977}" for k in range(300_000))] + [natural(r) for _ in range(50)]
    got = {x.doc_id: x for x in prose.statistics(frame(spark, texts), lexicon(spark)).collect()}
    assert got[0].lines == 300_000 and got[0].words == 600_000 and got[0]["list"] > 0.9
    assert all(got[k].prose > 0.5 for k in range(1, 51))


def test_lines_are_those_of_the_text(spark):
    """A paragraph is one line with one end, though it is labelled in pieces; a blob without blanks is one word."""
    r = random.Random(4)
    paragraph = natural(r) + " " + natural(r)
    texts = [paragraph, paragraph + "\n\n  \nno end here", "x" * 1000, "ａｂ，ｃ。\r\n&lt;x&gt;"]
    assert len(paragraph) > 2 * prose.LONG
    got = {x.doc_id: (x.lines, x.ending_lines, x.words) for x in prose.statistics(frame(spark, texts), lexicon(spark)).collect()}
    n = len(words(paragraph))
    assert got == {0: (1, 1.0, n), 1: (2, 0.5, n + 3), 2: (1, 0.0, 1), 3: (2, 0.5, 3)}


def test_groups_of_documents_are_bounded():
    lengths = np.array([0, 5, prose.CELLS + 7, 1, 1, prose.CELLS // 2, prose.CELLS // 2, 3])
    groups = list(prose._side_by_side(lengths))
    assert sorted(k for g in groups for k in g) == [k for k, n in enumerate(lengths) if n]
    assert all(len(g) == 1 or len(g) * lengths[g].max() <= prose.CELLS for g in groups)


def test_draws_of_the_sample_agree(spark):
    r = random.Random(8)
    names = ["prose"] * 5 + ["wrapped", "list", "table", "pairs", "symbols", "blob", "pile", "again"]
    df = spark.createDataFrame([(k, kinds(r, r.choice(names))) for k in range(400)], "doc_id long, text string")
    draws = [{x.doc_id for x in prose.not_prose(df, lexicon(spark), 200, seed).select("doc_id").collect()} for seed in (0, 1, 2)]
    assert max(len(draws[0] ^ d) for d in draws) <= 0.03 * 400, [len(draws[0] ^ d) for d in draws]
    assert 100 < len(draws[0]) < 300


def test_too_many_common_words(spark, monkeypatch):
    monkeypatch.setattr(prose, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="common words"):
        prose.statistics(frame(spark, ["x"]), lexicon(spark))


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    model = prose.fit([])
    model = prose.Model(model.first, model.step, [np.log(r.dirichlet(np.ones(s), 4)) for s in prose.SIZES])
    line = lambda: prose.Line(1, 1, 1, 0, 0, False, tuple(int(r.integers(s)) for s in prose.SIZES))
    docs = [[line() for _ in range(n)] for n in (1, 5, 0, 3)]

    def score(doc, path):
        e = [sum(model.emit[k][s, x.seen[k]] for k in range(len(prose.SIZES))) for s, x in zip(path, doc)]
        return model.first[path[0]] + sum(e) + sum(model.step[a, b] for a, b in zip(path, path[1:]))

    from itertools import product

    for doc, got in zip(docs, prose.label(model, docs)):
        if doc:
            assert score(doc, tuple(got)) == pytest.approx(max(score(doc, p) for p in product(range(4), repeat=len(doc))))
        else:
            assert len(got) == 0


# 2


@pytest.mark.parametrize(("n", "least"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_equal_brute_force(spark, n, least):
    texts = corpus() + ODD
    found = neardup.classes(frame(spark, texts), n, least)
    assert {(r.a, r.b) for r in neardup.pairs(found).collect()} == similar(texts, n, least)
    groups = {r.id: r for r in neardup.groups(found).collect()}
    assert set(groups) == {k for k, t in enumerate(texts) if t and shingles(t, n)}
    assert all(groups[a].group == groups[b].group for a, b in similar(texts, n, least))


def test_near_duplicates_one_text_holds_a_third(spark):
    texts = corpus(7, 60) + ["the same words again and again here " * 3] * 30
    found = neardup.classes(frame(spark, texts), 3, 0.5)
    assert found.members.groupBy("class").count().agg(F.max("count")).first()[0] == 30
    assert found.links.where("a = b").count() == 0
    assert neardup.classes(frame(spark, []), 3, 0.5).links.count() == 0


@given(st.lists(st.lists(st.floats(0, 100), min_size=5, max_size=5), min_size=2, max_size=5), st.integers(1, 8))
@settings(max_examples=60)
def test_allocation_is_the_cheapest(costs, need):
    from itertools import product

    costs = [[0.0, *c[1:]] for c in costs]
    got = neardup.allocate(costs, need)
    assert sum(t + 1 for t in got) >= need
    best = min(sum(c[t] for c, t in zip(costs, p)) for p in product(range(5), repeat=len(costs)) if sum(p) >= need)
    assert sum(c[t + 1] for c, t in zip(costs, got)) == pytest.approx(best)


def test_pigeonhole_covers_the_budget():
    plan = neardup.Plan(tuple(tuple(range(k, k + 4)) for k in range(0, 32, 4)), (2, 2, 3, -1, 2, 2, 2, 3))
    probes = [set(c) for c in plan.probes()]
    r = random.Random(2)
    allowed = sum(t + 1 for t in plan.thresholds) - 1
    for _ in range(500):
        wrong = set(r.sample(range(32), allowed))
        assert any(not (c & wrong) for c in probes)


@pytest.mark.parametrize("limit", [1, 2, 7, 4096])
def test_pairs_of_one_key_meet_once(spark, limit):
    """Blocks above the limit are dealt into parts; one key has a third of all rows."""
    from weftline.llm import meet

    r = random.Random(limit)
    data = [(7 if k % 3 == 0 else r.randint(-40, 40), k, r.random() < 0.5) for k in range(240)]
    df = spark.createDataFrame(data, "key long, id long, odd boolean").repartition(5)
    got = meet.pairs(df, "key", "id", lambda c, i, j: c["odd"][i] | c["odd"][j], lambda c, i, j: {"a": np.minimum(c["id"][i], c["id"][j]), "b": np.maximum(c["id"][i], c["id"][j])}, "a long, b long", "test", limit)
    want = sorted((i, j) for k, i, x in data for m, j, y in data if i < j and k == m and (x or y))
    assert sorted(map(tuple, got.collect())) == want
    assert meet.pairs(df.where("false"), "key", "id", lambda c, i, j: i < j, lambda c, i, j: {"a": i}, "a long", "test", limit).count() == 0


@pytest.mark.parametrize("limit", [3, 20])
def test_near_duplicates_and_spans_do_not_depend_on_the_limit(spark, limit):
    texts = corpus(9, 40) + ["one passage that many records share word for word and " * 3 + f"end {k}" for k in range(25)]
    df = frame(spark, texts)
    links = lambda n: {(x.a, x.b) for x in neardup.classes(df, 3, 0.5, limit=n).links.collect()}
    assert links(limit) == links(4096)
    found = lambda n: sorted(map(tuple, spans.spans(df, 40, limit=n)[0].collect()))
    assert found(limit) == found(4096)


def test_correlated_coordinates_share_a_partition():
    c = np.eye(32)
    for group in ((0, 9, 17, 30), (3, 4, 8, 31)):
        for i in group:
            for j in group:
                c[i, j] = 0.9
    got = neardup.grouped(c)
    assert got[0] in ((0, 9, 17, 30), (3, 4, 8, 31)) and {(0, 9, 17, 30), (3, 4, 8, 31)} <= set(got)
    assert sorted(k for p in got for k in p) == list(range(32)) and {len(p) for p in got} == {4}


# 4


def test_overlaps_equal_brute_force(spark):
    texts = corpus(11, 70) + ODD
    split = ["train" if k % 3 else ("validation" if k % 2 else "test") for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, s, "SRC ", 1) for k, (t, s) in enumerate(zip(texts, split))] + [(999, texts[0], None, "x", 1)], "record_id long, text string, split string, source_id string, term int")
    for n, least in ((3, 0.5), (5, 0.8)):
        found = overlap.overlaps(df, overlap.bound(least), n)
        links = overlap.Overlaps(found.members, found.links.where(F.col("jaccard") >= least))
        want = {(i, j) for i, j in similar(texts, n, least) if (split[i] == "train") != (split[j] == "train")}
        assert {tuple(sorted(r)) for r in overlap.pairs(links).collect()} == want
    counts = {(r.split, r.source): (r.records, r.found) for r in overlap.by_split_and_source(df, links).collect()}
    held = {j if split[j] != "train" else i for i, j in want}
    assert counts["test", "src"] == (split.count("test"), sum(split[k] == "test" for k in held))


def test_overlaps_with_crowded_cells_and_split_lists(spark):
    """Few cells, so that terms share them and Bloom filters are asked; every list of a pair or more is split; one text is a third of all."""
    texts = corpus(13, 60) + ["the same words again and again here " * 4] * 30
    df = spark.createDataFrame([(k, t, "train" if k % 2 else "test") for k, t in enumerate(texts)], "record_id long, text string, split string")
    want = {(a, b) if a % 2 else (b, a) for a, b in similar(texts, 3, 0.5) if (a % 2) != (b % 2)}
    for options in ({"cells": 64}, {"split": 0}, {"cells": 64, "split": 1, "slack": 0.2}, {"slack": 0.0}):
        found = overlap.overlaps(df, overlap.bound(0.5), 3, **options)
        links = overlap.Overlaps(found.members, found.links.where("jaccard >= 0.5"))
        assert {tuple(r) for r in overlap.pairs(links).collect()} == want, options
    rows = overlap.linked(links).collect()
    assert len(rows) == len([t for t in texts if shingles(t, 3)]) and len({r["class"] for r in rows if r.id >= 60}) == 2


def test_cosine_of_term_counts(spark):
    texts = corpus(5, 40)
    split = ["train" if k % 2 else "test" for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(zip(texts, split))], "record_id long, text string, split string")

    def vector(t):
        w, v = words(t), defaultdict(int)
        for k in range(len(w) - 1):
            v[tuple(w[k : k + 2])] += 1
        return v

    def cosine(u, v):
        return sum(u[k] * v.get(k, 0) for k in u) / np.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))

    vectors = [vector(t) for t in texts]
    want = {(a, b): cosine(vectors[a], vectors[b]) for a in range(len(texts)) for b in range(len(texts)) if split[a] == "train" and split[b] == "test" and cosine(vectors[a], vectors[b]) >= 0.6}
    found = overlap.overlaps(df, 0.6, 2, "tf")
    assert {(r.a, r.b) for r in overlap.pairs(found).collect()} == set(want)
    assert all(r.cosine == pytest.approx(want[r.a, r.b]) for r in found.links.collect())
    assert overlap.overlaps(df.where("false"), 0.6).links.count() == 0


# 5


def test_collapse_in_passes_and_with_a_hot_group(spark):
    """A group of a third of all records; the filter as large as ever but sent in 1, 4 and 16 passes."""
    texts = ["The same, text."] * 500 + ["THE SAME TEXT"] * 500 + [f"text {k}" for k in range(1500)] + [None] * 250 + ["!"] * 250
    df = frame(spark, texts, "record_id")
    for pass_bits in (1 << 28, 1 << 14, 1 << 12):
        got = {r.id: r.copies for r in formatting.collapsed(df, pass_bits=pass_bits).collect()}
        assert got == {0: 1000} | {k: 1 for k in range(1000, 3000)}
        rows = formatting.grouped(df, pass_bits=pass_bits)
        assert rows.count() == 3000 and rows.where("first = 0 and copies = 1000").count() == 1000


def test_canonical_forms():
    same = [
        ['{"a": 1, "b": {"c": "X y", "d": [1, 2]}}', '{ "B": {"d": [1,2], "c": "x-Y"}, "A": "1" }'],
        ["name: A b\nsize = 3\n\n note: x", "NOTE=X\nsize:3\nname = a-B", '{"size": "3", "note": "x", "name": "ab"}'],
        ["Hello, World 1", "hello world1", "HELLO\nWORLD\t1!"],
        ["0.10: x\na=1\nb=2", "a=1\nb=2\n0.10=x"],
    ]
    forms = [{formatting.canonical(t) for t in group} for group in same]
    assert all(len(f) == 1 for f in forms) and len(set.union(*forms)) == len(forms)
    assert formatting.canonical(None) is formatting.canonical(" -!") is None
    assert formatting.canonical('{"a": 0.0001}') != formatting.canonical('{"a": 1e-4}')
    assert formatting.canonical("a: b\nc: d") == "tabcd"  # two lines are no text of fields
    assert formatting.canonical('{"a": [1, 2]}') != formatting.canonical('{"a": [2, 1]}')
    assert formatting.canonical('{"a": 1, "a": 2}') == formatting.canonical('{"a": 2, "a": 1}')


def test_collapse_equals_brute_force(spark):
    r = random.Random(4)
    texts = list(ODD)
    for k in range(200):
        fields = {f"k{j}": r.randint(0, 1) for j in range(3)}
        items = list(fields.items())
        r.shuffle(items)
        texts.append(r.choice([json.dumps(dict(items)), "\n".join(f"{a} = {b}" for a, b in items), r.choice(["Same text.", "same TEXT", f"text {k % 20}"])]))
    df = frame(spark, texts, "record_id")
    first, copies = {}, defaultdict(int)
    for k, t in enumerate(texts):
        form = formatting.canonical(t)
        form = form if form is not None else ("own", k)
        first.setdefault(form, k)
        copies[first[form]] += 1
    assert {(r.id, r.copies) for r in formatting.collapsed(df).collect()} == set(copies.items())
    assert all(r.copies == copies[r.first] for r in formatting.grouped(df).collect())
    assert formatting.grouped(df.where("false")).count() == 0


# 6


TOKENIZERS = [budget.Estimate(), budget.Whitespace()]
FILES = "/opt/tokenizers"


def tokenizers():
    import os

    more = [budget.BytePairs(f"{FILES}/{f}", budget.BYTE_PATTERN) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken") if os.path.exists(f"{FILES}/{f}")]
    if os.path.exists(f"{FILES}/word_bpe_49k.json"):
        more.append(budget.WordPairs(f"{FILES}/word_bpe_49k.json"))
    return TOKENIZERS + more


@pytest.mark.parametrize("tokenizer", tokenizers(), ids=lambda t: f"{type(t).__name__}")
def test_pieces_add_up(tokenizer):
    r = random.Random(9)
    alphabet = ["it's", "we'll", " ", "  ", "\n", "\t\n", "abc", "XYZ", "12345", "...", "!?", "，", "。", "漢字", "é", "'", "'s", " ", "🙂", "a'b", "-"]

    @given(st.lists(st.sampled_from(alphabet), max_size=60), st.integers(1, 20))
    @settings(max_examples=150, deadline=None)
    def run(parts, size):
        text = "".join(parts)
        ends = [*tokenizer.cuts(text, size), len(text)]
        pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
        assert "".join(pieces) == text
        assert sum(tokenizer.count(pieces)) == tokenizer.count([text])[0]

    run()
    long = " ".join(r.choice(alphabet) for _ in range(3000))
    assert len(tokenizer.cuts(long, 50)) > 50


def test_counts_of_cut_and_whole_documents_agree(spark):
    texts = corpus(2, 30) + ODD
    df = frame(spark, texts).withColumn("k", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + (1 << 60)))
    for tokenizer in tokenizers()[:3]:
        whole, cut = (sorted(map(tuple, budget.counted(df, tokenizer, keep=("k",), most_chars=n, salts=7).collect()), key=str) for n in (1 << 20, 64))
        assert whole == cut and len(whole) == len(texts)
    estimate = {i: t for i, t in budget.counted(df, budget.Estimate(), most_chars=64).collect()}
    assert estimate == {k: max(1, len(t or "") // 4) for k, t in enumerate(texts)}
    assert budget.counted(df.where("false"), budget.Estimate()).count() == 0


def test_slices_and_snapshots(spark):
    docs = spark.createDataFrame([(1, "x" * 400, " Web", "EN-us", "https://www.A.example/p", "d1"), (2, "y" * 41, None, None, "", "d1"), (3, None, "web", "en", "a.example", "d2")], "doc_id long, text string, source string, lang string, domain string, download_id string")
    got = {tuple(r) for r in budget.by_slice(docs, budget.Estimate()).collect()}
    assert got == {("web", "en", "a.example", 2, 101), (None, None, None, 1, 10)}
    snaps = [("d1", 1, 100, 1), ("d1", 2, 112, 2), ("d2", 3, None, 1), ("d3", 4, 0, 1), ("d4", 5, 5, 1), (None, 6, 5, 1), ("d1", 7, 1, None)]
    s = spark.createDataFrame(snaps, "download_id string, snapshot_id long, estimated_tokens long, updated_at int")
    assert sorted(r.download_id for r in budget.off_snapshots(docs, s).collect()) == ["d2", "d4"]
    s = spark.createDataFrame([("d1", 1, 113, 1)], "download_id string, snapshot_id long, estimated_tokens long, updated_at int")
    assert budget.off_snapshots(docs, s).count() == 1


# 7


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    items = [sentence(r, r.randint(8, 40)) for _ in range(12)] + [None, "", "one"]
    texts = []
    for _ in range(60):
        w = r.choice(items[:12]).split()
        a = r.randint(0, len(w))
        texts.append(sentence(r, 20) + " " + r.choice([str.upper, str.title, lambda s: s.replace(" ", ", ")])(" ".join(w[a : a + r.randint(0, 40)])) + " " + sentence(r, 5))
    texts += ODD
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, id int")

    def runs(t):
        w = words(t or "")
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if runs(t) & runs(x)}
    for most in (leakage.MOST_RUNS, 0):
        got = leakage.leaks(docs, bench, most_runs=most)
        assert {(r.doc_id, r.item_id) for r in got.where("exact_runs > 0").collect()} == want
    assert leakage.leaks(docs, bench.where("false")).count() == leakage.leaks(docs.where("false"), bench).count() == 0


def test_other_numbers_names_and_units(spark):
    item = "If Marla buys 12 apples for 3 dollars and Tobin sells 12 pears, how much does Marla pay for all of them?"
    other = "if Quenya buys 40 apples for 7 euros and Peskin sells 40 pears, how much does Quenya pay for all of them?"
    broken = "if Quenya buys 40 apples for 7 euros and Peskin sells 41 pears, how much does Quenya pay for all of them?"
    plain = "We saw that he buys apples for her and sells pears too; how much does it pay for all of them?"
    docs = frame(spark, [other, broken, "x " + item.upper(), plain])
    bench = spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")
    for most in (leakage.MOST_RUNS, 0):
        got = {(r.doc_id, r.item_id): r for r in leakage.leaks(docs, bench, most_runs=most).collect()}
        assert got[0, 1].exact_runs == 0 and got[0, 1].other_runs == 11
        assert got[1, 1].other_runs < got[0, 1].other_runs
        assert got[2, 1].exact_runs == 11
        assert got[1, 1].other_runs == 0 and got[1, 1].refused_runs == 11  # one mapping over the whole alignment
        assert got[2, 1].exact_slot_runs == 11  # numbers and units: without the slots these were any re-parameterised run


NAMES = {"en": "Marla Tobin Quenya Peskin Orlando Ingrid Yusuf Delphine".split(), "de": "Jürgen Anneliese Torben Mechthild Korbinian Svenja Ottokar Wiebke".split(), "zh": [a + b for a in "王李张" for b in "芳强丽"] + ["小明", "小红", "老周"]}
ITEMS = {
    "en": [
        "On Monday {a} buys {n} apples for {m} {u} and later {b} sells {n} pears, so how much money does {a} have to pay for all of them?",
        "When the train that {a} takes leaves the old station it needs {n} {u} to reach the coast, while {b} drives there in {m} {u}; who is faster and why?",
        "In the garden {a} and {b} dig {n} holes each, and every hole takes them {m} {u}. How long are they going to work if nobody helps {a} at all?",
    ],
    "de": [
        "Am Morgen kauft {a} auf dem Markt {n} Birnen für {m} {u} und danach verkauft {b} noch {n} Eier, also wie viel muss {a} am Ende bezahlen?",
        "Wenn der alte Zug mit {a} pünktlich abfährt, braucht er {n} {u} bis zur Küste, während {b} mit dem Auto in {m} {u} dort ist; wer ist schneller?",
    ],
    "zh": ["昨天{a}在学校门口的商店里买了{n}支铅笔，后来{b}又送给{a}{m}支铅笔，请问{a}现在一共有多少支铅笔，{b}还剩下多少支？"],
}
WORDS = {"en": ["minutes", "hours", "dollars", "seconds"], "de": ["minuten", "stunden", "euro", "sekunden"], "zh": ["元"]}


def filled(r, lang, text, break_it=False):
    a, b = r.sample(NAMES[lang], 2)
    values = {"a": a, "b": b, "n": r.randint(10, 4999), "m": r.randint(10, 4999), "u": r.choice(WORDS[lang])}
    first = text.replace("{n}", str(values["n"] + 7000), 1).replace("{a}", "Zebulon" if lang != "zh" else "小天", 1) if break_it else text
    return first.format(**values)


def test_recall_of_reparameterised_items(spark):
    r = random.Random(21)
    items, docs, want, broken = [], [], set(), set()
    for lang, texts in ITEMS.items():
        for text in texts:
            for _ in range(10):
                items.append(filled(r, lang, text))
                for k in range(3):
                    other = filled(r, lang, text, break_it=k == 2)
                    if k < 2:
                        want.add((len(docs), text))
                    elif max(text.count("{a}"), text.count("{n}")) > 1:  # else another first name or number is as good as any
                        broken.add((len(docs), text))
                    docs.append(f"{sentence(r, 30).capitalize()}. {natural(r)} {other} {sentence(r, 25)}")
    owner = [t for ts in ITEMS.values() for t in ts for _ in range(10)]
    df, bench = frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    by_mode = []
    for most in (leakage.MOST_RUNS, 0):
        got = leakage.leaks(df, bench, most_runs=most)
        by_mode.append(sorted(map(tuple, got.collect())))
    assert by_mode[0] == by_mode[1]
    found = {(d, owner[i]) for d, i, exact, _, other, _ in by_mode[0] if other}
    recall = len(found & want) / len(want)
    print("recall", recall, "of", len(want), "broken reported", len(found & broken), "of", len(broken))
    assert recall >= 0.9
    left = [(d, docs[d][-330:]) for d, _ in sorted(found & broken)]
    assert len(left) <= 0.1 * len(broken), left[::7]


# 8


def test_mixture(spark):
    r = random.Random(8)
    rows = [(k, "x" * r.randint(1, 400), r.choice([" A ", "a", "b", "c", None])) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("expected", F.lit(1)).repartition(5)
    plan = spark.createDataFrame([("a", 0.5, 2, "train", True), ("b", 0.4, 1, "train", None), ("c", 0.1, None, "train", True), ("d", 0.2, 3, "train", True), ("a", None, None, "test", True), ("z", 1.0, 1, "train", False)], "id string, weight double, max_repeats int, split string, enabled boolean")
    draws, planned = mixture.mixture(docs, plan)
    tokens = defaultdict(int)
    for _, t, s in rows:
        if s:
            tokens[s.strip().lower()] += max(1, len(t) // 4)
    total = sum(tokens.values())
    expect = {"a": 0.5 * total / tokens["a"], "b": 1.0, "c": 0.1 * total / tokens["c"]}
    copies = defaultdict(list)
    for x in draws.collect():
        copies[x.source].append(x.copies)
    size = {s: sum((y or "").strip().lower() == s for _, _, y in rows) for s in "abc"}
    for s, e in expect.items():
        assert set(copies[s]) <= {int(np.floor(e)), int(np.ceil(e))} and abs(sum(copies[s]) - e * size[s]) <= 1
    report = {x.id: x for x in mixture.report(draws, planned).collect()}
    assert set(report) == {"a", "b", "c", "d"}
    assert report["b"].short == (0.4 * total > tokens["b"]) and not report["a"].short and not report["c"].short and report["d"].short
    assert abs(sum(x.share for x in report.values()) - 1) < 1e-9
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, mixture.mixture(docs.repartition(2), plan)[0].collect()))


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "a")], "doc_id long, text string, source string")
    plan = spark.createDataFrame([("a", float("nan"), 1, "train", True)], "id string, weight double, max_repeats int, split string, enabled boolean")
    assert mixture.mixture(docs, plan)[0].count() == 0
    assert mixture.report(*mixture.mixture(docs.where("false"), plan)).first().tokens == 0


# 9


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13, 17])
def test_cover(q):
    period = q * q + q + 1
    c = set(spans.cover(q))
    assert len(c) == q + 1
    assert all(any((i + d) % period in c and d % period in c for d in range(period)) for i in range(period))


def runs_of(x, y, least):
    """Maximal equal runs by dynamic programming."""
    out, before = set(), [0] * (len(y) + 1)
    for i in range(len(x) + 1):
        now = [0] * (len(y) + 1)
        for j in range(len(y) + 1):
            if i and j and x[i - 1] == y[j - 1]:
                now[j] = before[j - 1] + 1
            length = before[j - 1] if i and j else 0
            if i and j and (x[i - 1] != y[j - 1]) and length >= least:
                out.add((i - 1 - length, j - 1 - length, length))
        if i == len(x):
            out |= {(i - n, j - n, n) for j, n in enumerate(now) if n >= least}
        elif i:
            if now[len(y)] >= least:
                out.add((i - now[len(y)], len(y) - now[len(y)], now[len(y)]))
        before = now
    return out


def test_spans_equal_brute_force(spark):
    r = random.Random(12)
    base = "".join(r.choice("abcdefgh é漢🙂") for _ in range(600))
    texts = []
    for _ in range(14):
        a, n = r.randint(0, 500), r.randint(20, 120)
        texts.append("".join(r.choice("qrstuv") for _ in range(r.randint(0, 60))) + base[a : a + n] + "".join(r.choice("wxyz") for _ in range(r.randint(0, 60))) + base[a : a + 45])
    texts += [texts[0], texts[1][3:], base[:100], base[:100] + "!", None, "", "aaaa" * 40, "aaaa" * 41]
    least = 40
    found, again = spans.spans(frame(spark, texts), least)
    got = defaultdict(set)
    for x in found.collect():
        got[x.a, x.b].add((x.a_start, x.b_start, x.length))
    first = {}
    copies = set()
    for k, t in enumerate(texts):
        if t is not None:
            if t in first:
                copies.add((k, first[t]))
            first.setdefault(t, k)
    assert {(x.id, x.first) for x in again.collect()} == copies
    want = {}
    kept = [k for k in first.values()]
    for b in kept:
        for a in kept:
            if a < b and (runs := runs_of(texts[a], texts[b], least)):
                want[a, b] = runs
    assert set(got) == set(want)
    regular = {p for p in want if max(p) < 20}
    assert all(got[p] == want[p] for p in regular)
    pairs = {(x.a, x.b) for x in spans.pairs(found, again, least).collect()}
    whole = {(a, b) for b in range(len(texts)) for a in range(b) if texts[a] and texts[b] and runs_of(texts[a], texts[b], least)}
    assert pairs == whole
    shares = [{x.id: x for x in spans.coverage(frame(spark, texts), least, hot=h).collect()} for h in (spans.HOT, 1, 2, 4)]
    share = shares[0]
    assert all(s == share for s in shares)
    for k in kept:
        marked = set()
        for (a, b), runs in want.items():
            for s, t, n in runs:
                if k == a:
                    marked |= set(range(s, s + n))
                if k == b:
                    marked |= set(range(t, t + n))
        if k < 14 and k != 0:
            assert share[k].shared == len(marked)
    assert share[0].shared == len(texts[0])
    assert spans.spans(frame(spark, []), least)[0].count() == 0


def test_clean_words_agree():
    assert words("Ａ１ x") == ["a1", "x"] and clean("a b") == "a b" and alnum("Ａ1") == "ａ1"
