import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import blend, components, ingest, postprocess, prefix, sequences, shuffle, tokens

LONG = "alpha beta gamma delta"


def raw(spark, texts, **more):
    rows = [(0, k, t, "s", more.get("hash"), more.get("flag")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_idx int, line_no long, text string, source_id string, document_hash string, text_preprocessed boolean")


def test_first_matching_reason_and_statistics(spark):
    df = raw(spark, [LONG, "short", None, LONG + " " * 9, "x" * 99, "eta theta iota kappa"])
    got = postprocess.reasons(df, ["file_idx", "line_no"], 10, 50, 0)
    assert [r.outcome for r in got.orderBy("line_no").collect()] == ["train", "short", "short", "duplicate", "long", "train"]
    assert tuple(postprocess.statistics(got).first()) == (6, 2, 0, 2, 1, 1, 0)
    kept = postprocess.processed(df, ["file_idx", "line_no"], 10, 50, 0)
    assert [(r.line_no, r.text) for r in kept.orderBy("line_no").collect()] == [(0, LONG), (5, "eta theta iota kappa")]


def test_trusted_record_is_not_cleaned(spark):
    text = "Alpha  &amp; Gamma"
    digest = hashlib.sha256(text.encode()).hexdigest()
    r = postprocess.with_cleaned(raw(spark, [text], hash=digest, flag=True)).first()
    assert (r.cleaned, r.digest, r.trusted) == (text, digest, True)
    r = postprocess.with_cleaned(raw(spark, [text], hash="zz", flag=True)).first()
    assert (r.cleaned, r.trusted) == ("Alpha & Gamma", False)


def test_empty_table(spark):
    df = raw(spark, []).where("false")
    assert postprocess.processed(df, ["file_idx", "line_no"]).count() == 0
    assert tuple(postprocess.statistics(postprocess.reasons(df, ["file_idx", "line_no"])).first()) == (0,) * 7


def test_allocation(spark):
    def run(weights, total):
        df = spark.createDataFrame(list(weights.items()), "id string, weight double")
        return {r.id: r.target_tokens for r in blend.allocate(df, total).collect()}

    assert run({"general_web": 0.55, "education": 0.2, "long_form": 0.1, "math": 0.07, "code": 0.06, "multilingual": 0.02}, 100) == {"general_web": 55, "education": 20, "long_form": 10, "math": 7, "code": 6, "multilingual": 2}
    got = run({"a": 0.333, "b": 0.333, "c": 0.334}, 10)
    assert got["c"] == 4 and sum(got.values()) == 10
    with pytest.raises(ValueError):
        run({"a": 1.0}, 0)
    with pytest.raises(Exception, match="nonnegative"):
        run({"a": -1.0}, 5)


def test_tasks_and_budgets(spark):
    df = spark.createDataFrame([("a", 10), ("b", 2)], "id string, target_tokens long")
    got = [tuple(r) for r in blend.tasks(df, 4).orderBy("download_id").collect()]
    assert got[0] == ("a", "a.part000", 0, None, 3) and got[3] == ("a", "a.part003", 3, None, 2) and got[6] == ("b", "b.part002", 2, 0, None)
    assert blend.token_budget(1000, 513, 128) == 512
    with pytest.raises(ValueError):
        blend.token_budget(10, 5, 128)
    r = spark.range(1).select(blend.evaluations(F.lit(12), 5), blend.evaluations(F.lit(7), 5), blend.evaluations(F.lit(3), 5)).first()
    assert tuple(r) == (4, 1, 5)


def test_shard_before_skip(spark):
    df = spark.createDataFrame([(k, f"document-{k}") for k in range(5)], "n long, t string")
    assert [r.t for r in ingest.shard(df, "n", 2, 1, 1).collect()] == ["document-3"]


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([("a", k, 10) for k in range(5)] + [("b", 0, 100)], "s string, k long, n long")
    got = ingest.within_budget(df, ["k"], F.col("n"), F.lit(25), ["s"])
    assert sorted((r.s, r.k) for r in got.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_budgets_of_columns_and_no_budget(spark):
    rows = [("a", k, 10, 15) for k in range(4)] + [("b", k, 10, None) for k in range(3)] + [("c", 0, None, 0), ("d", 0, 5, 0)]
    df = spark.createDataFrame(rows, "s string, k long, n long, most long").repartition(3)
    got = ingest.within_budget(df, ["k"], F.coalesce("n", F.lit(0)), F.col("most"), ["s"])
    assert got.columns == df.columns and sorted((r.s, r.k) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]
    assert ingest.within_budget(df.where("false"), ["k"], F.col("n"), F.lit(1), ["s"]).count() == 0


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_prefix_sum(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long").repartition(3)
    got = [r.start for r in prefix.prefix_sum(df, ["k"], "v").orderBy("k").collect()]
    assert got == [sum(values[:k]) for k in range(len(values))]


def test_shuffle_is_a_reproducible_permutation_in_each_split(spark):
    data = [(k, "train" if k < 12 else "validation", "code" if k % 2 else "math", f"h{k}") for k in range(19)]
    df = spark.createDataFrame(data, "ordinal long, split string, source_id string, document_hash string")
    once, again = ([tuple(r)[:4] for r in shuffle.shuffled(d, 17, 3).select("split", "ordinal", "source_id", "document_hash").collect()] for d in (df, df.repartition(5)))
    assert once == again and sorted(once) == sorted((s, k, c, h) for k, s, c, h in data)
    train = [k for s, k, _, _ in once if s == "train"]
    assert train != sorted(train)

    def key(k, s, h):
        return hashlib.sha256(f"17\0{s}\0{k}\0{h}".encode()).hexdigest()

    def bucket(k, s, h):
        return hashlib.sha256(f"17\0{s}\0bucket\0{int(key(k, s, h)[:16], 16) % 3}".encode()).hexdigest()

    assert train == sorted(range(12), key=lambda k: (bucket(k, "train", f"h{k}"), key(k, "train", f"h{k}")))


def test_balanced_schedule_interleaves(spark):
    df = spark.createDataFrame([(0, {"code": 4, "math": 4, "general_web": 4, " ": 0})], "shard_id long, source_token_counts map<string,long>")
    planned = shuffle.chunks(shuffle.source_counts(df), 2, ["shard_id"], ["source"])
    got = shuffle.schedule(planned, 17, ["shard_id"]).orderBy("step").collect()
    assert len(got) == 6 and {r.source for r in got[:3]} == {"code", "math", "general_web"}
    assert sorted((r.source, r.offset) for r in got) == [("code", 0), ("code", 2), ("general_web", 4), ("general_web", 6), ("math", 8), ("math", 10)]


def test_schedule_gives_each_chunk_once_and_every_source_its_stride(spark):
    r = random.Random(3)
    data = [(k % 7, s, 0, 100 * k, r.randint(1, 9)) for k, s in enumerate("a" * 60 + "b" * 20 + "c")]
    df = spark.createDataFrame(data, "shard_id long, source string, chunk long, offset long, tokens long")
    got, again = ([tuple(x) for x in shuffle.schedule(d, 5, ["shard_id"]).orderBy("step").collect()] for d in (df, df.repartition(4)))
    assert got == again and sorted(x[:5] for x in got) == sorted(data) and [x[5] for x in got] == list(range(81))
    whole = {s: sum(n for _, t, _, _, n in data if t == s) for s in "abc"}
    given = dict.fromkeys("abc", 0)
    for _, s, _, _, n, step in got:
        given[s] += n
        if step < 80:
            assert abs(given["a"] / whole["a"] - given["b"] / whole["b"]) < 0.12
    other = [tuple(x) for x in shuffle.schedule(df, 6, ["shard_id"]).orderBy("step").collect()]
    assert [x[:5] for x in other] != [x[:5] for x in got]
    assert shuffle.schedule(df.where("false"), 5, ["shard_id"]).count() == 0


def test_word_length_tokens(spark):
    df = spark.createDataFrame([("alpha beta",), ("  ",), ("gamma\tdelta",)], "t string")
    assert [r[0] for r in df.select(tokens.word_length_tokens(F.col("t"))).collect()] == [[5, 4, 0], [0], [5, 5, 0]]


def lengths():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def test_encode_skips_empty(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in tokens.encode(df, lengths, 0).collect()] == [(1, [5, 4, 0])]


def test_greedy_cap_goes_on_after_a_miss(spark):
    r = random.Random(1)
    data = [(s, k, r.randint(1, 30)) for s in "abc" for k in range(60)]
    df = spark.createDataFrame(data, "source_id string, k long, n long")
    limits = spark.createDataFrame([("a", 100), ("b", 7)], "source string, most long")
    want, used = [], {}
    for s, k, n in data:
        most = {"a": 100, "b": 7}.get(s)
        if most is None or used.get(s, 0) + n <= most:
            used[s] = used.get(s, 0) + n
            want.append((s, k, n))
    assert sorted(tuple(r) for r in tokens.capped(df, limits, ["k"]).collect()) == want


def test_pieces_cover_documents(spark):
    df = spark.createDataFrame([("general_web", 0, 2), ("code", 2, 3), ("x", 5, 0), ("y", 5, 11)], "source_id string, start long, n long")
    got = sorted((r.shard, r.source_id, r["from"], r.taken, r.place) for r in tokens.shard_pieces(df, 3).collect())
    assert got[:3] == [(0, "code", 0, 1, 2), (0, "general_web", 0, 2, 0), (1, "code", 1, 2, 0)]
    assert sum(t for _, s, _, t, _ in got if s == "y") == 11


def test_locate(spark):
    shards = spark.createDataFrame([("a", 0, 5), ("b", 5, 1), ("c", 6, 10)], "path string, offset long, tokens long")
    got = tokens.locate(spark.range(0, 20, 5).withColumnRenamed("id", "position"), shards).collect()
    assert sorted((r.position, r.path, r.place) for r in got) == [(0, "a", 0), (5, "b", 0), (10, "c", 4), (15, "c", 9)]


def test_labels_and_packing(spark):
    data = [(0, [0, 10, 20]), (3, []), (3, [30]), (4, [40, 50, 60, 70, 80, 90]), (10, [100])]
    docs = spark.createDataFrame(data, "start long, tokens array<long>")
    assert [tuple(r) for r in sequences.labelled(docs).orderBy("position").collect()] == [(k, 10 * k, 10 * k + 10 if k < 10 else None) for k in range(11)]
    packed = sequences.packed(docs, 4).orderBy("sequence").collect()
    assert [r.input_ids for r in packed] == [[0, 10, 20, 30], [40, 50, 60, 70]] and packed[1].labels == [50, 60, 70, 80]
    assert sequences.largest_token(docs).first().largest == 100
    assert sequences.permutation(5, 3, 4) == np.random.default_rng(7).permutation(np.arange(5)).tolist()


@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.integers(1, 6), st.integers(0, 7), st.one_of(st.none(), st.integers(0, 40)))
@settings(max_examples=6, deadline=None)
def test_packing_equals_brute_force(spark, sizes, length, first, last):
    stream = list(range(100, 100 + sum(sizes)))
    docs = [(sum(sizes[:k]), stream[sum(sizes[:k]) : sum(sizes[: k + 1])], "s") for k in range(len(sizes))]
    want, at = [], first
    while at + length <= min(len(stream) - 1, len(stream) if last is None else last):
        want.append((stream[at : at + length], stream[at + 1 : at + length + 1]))
        at += length
    df = spark.createDataFrame(docs, "start long, tokens array<long>, split string").repartition(3)
    got = sequences.packed(df, length, first, last, ["split"]).orderBy("sequence").collect()
    assert [(r.input_ids, r.labels) for r in got] == want and [r.sequence for r in got] == list(range(len(want)))


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
@settings(max_examples=8, deadline=None)
def test_components(spark, links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links or [(None, None)], "a long, b long")
    assert {tuple(r) for r in components.components(df).collect()} == {(x, root(x)) for x in parent}
