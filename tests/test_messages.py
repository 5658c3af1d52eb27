import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.operators import exactly_once as E
from weftline.operators import ledger

SCHEMA = "delivery_id long, event_id string, experiment_id string, final_run_id string, type string, timestamp string"


@given(st.lists(st.integers(0, 30)))
def test_ranges(numbers):
    r, seen = E.Ranges(), set()
    for n in numbers:
        assert r.add(n) == (n not in seen)
        seen.add(n)
    pairs = r.pairs()
    assert {n for a, b in pairs for n in range(a, b + 1)} == seen
    assert all(b + 1 < c for (_, b), (c, _) in zip(pairs, pairs[1:]))


def brute(rows):
    seen, again = set(), []
    for d, event, exp, final, kind, when in sorted(rows):
        run = final if final and final.strip() else exp
        if run is None or not run.strip():
            continue
        event = (event or "").strip()
        key = (run, event) if event else (run, "", kind or "", when)
        if key in seen:
            again.append(d)
        seen.add(key)
    return again


def test_repeats_equal_brute_force(spark, rows):
    r = random.Random(5)
    data = []
    for k in range(600):
        run = r.choice(["exp-1", "exp-1", "exp-2", None, " "])
        event = r.choice([f"{run}:{r.randint(1, 60):06d}", f"{r.randint(1, 30):06d}", f" {r.randint(1, 9)} ", "07", "7", "abc", "x-", None, "", "99999999999999999999999"])
        data.append((k, event, run, r.choice([None, "", "final-run-1"]), r.choice(["heartbeat", "validation", None]), r.choice(["2026-02-25T15:06:06Z", "2026-02-25T15:06:07Z", None])))
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert [x for (x,) in sorted(rows(E.repeats(df)))] == brute(data)
    assert E.exactly_once(df).count() == len(data) - len(brute(data))


def test_one_instant_written_differently(spark, rows):
    when = ["2026-02-25T10:00:00.500-05:00", "2026-02-25T15:00:00.500Z", "2026-02-25T15:00:00.500", "2026-02-25T15:00:00Z", "soon", " soon"]
    df = spark.createDataFrame([(k, None, "e", None, "heartbeat", w) for k, w in enumerate(when)], SCHEMA)
    assert rows(E.repeats(df)) == [(1,), (2,), (5,)]


def test_one_hot_message_and_extra_columns(spark):
    df = spark.range(20_000).selectExpr("id as delivery_id", "'exp-1:000001' as event_id", "'exp-1' as experiment_id", "cast(null as string) as final_run_id", "'t' as type", "'x' as timestamp", "1 as producer", "2 as run")
    assert E.repeats(df).count() == 19_999
    assert [r.delivery_id for r in E.exactly_once(df).collect()] == [0]
    assert E.repeats(df.where("false")).count() == 0


def test_seen_ranges(spark, rows):
    df = spark.createDataFrame([(k, f"r:{n}", "r", None, "t", "x") for k, n in enumerate([1, 2, 3, 7, 8, 2, 5])], SCHEMA)
    assert [(a, b) for _, a, b in rows(E.seen_ranges(df))] == [(1, 3), (5, 5), (7, 8)]


def events(spark, data):
    return spark.createDataFrame(data, "delivery_id long, event_id string, experiment_id string, final_run_id string, type string, loss double")


def test_idempotence_and_late_events(spark):
    data = [(1, "a", "e1", None, "worker_started", None), (2, "a", "e1", "", "worker_started", None), (3, None, "e1", None, "validation", 2.0), (4, None, "e1", None, "validation", 2.0), (5, "z", "e1", None, "worker_completed", None), (6, "y", "e1", None, "validation", 1.0), (7, "a", "e1", "f1", "heartbeat", None)]
    df = ledger.idempotent(events(spark, data), "delivery_id")
    assert [r.delivery_id for r in df.where("repeat").collect()] == [2]
    from pyspark.sql import functions as F

    late = ledger.before_terminal(df.withColumn("run", F.coalesce(F.nullif("final_run_id", F.lit("")), "experiment_id")), ["run"], "delivery_id", F.col("type") == "worker_completed")
    assert [r.delivery_id for r in late.where("late").collect()] == [6]
    got = ledger.values_in_order(late.where("not late"), ["run"], "delivery_id", "loss", "losses").select("run", *ledger.loss_summary(F.col("losses"))).collect()
    assert [tuple(r) for r in got] == [("e1", 2, 2.0, 2.0, 2.0)]


def test_fair_share(spark):
    df = spark.createDataFrame([("e1", "s1"), ("e2", "s1"), ("e3", "s2")], "e string, s string")
    got = ledger.fair_share(ledger.queue_positions(df, "e"), "s", "position").orderBy("e").collect()
    assert [(r.position, r["rank"]) for r in got] == [(1, 1), (2, 3), (3, 2)]


@pytest.mark.parametrize(
    ("predicted", "lower", "upper", "actual", "want"),
    [
        (2.8, 2.7, 2.9, 2.75, (0.05, True, 0.2, 0.0, 0.2, 0.125)),
        (2.7, 2.6, 2.9, 2.55, (0.15, False, 0.3, 0.05, 0.8, 0.475)),
        (2.7, 2.9, 2.6, 2.5, (0.2, None, None, None, None, None)),
        (None, 2.6, 2.9, 2.5, (None,) * 6),
    ],
)
def test_prediction_scores(spark, predicted, lower, upper, actual, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(predicted, lower, upper, actual)], "p double, l double, u double, a double")
    got = df.select(*[c.alias(k) for k, c in ledger.prediction_scores(*map(F.col, "plua")).items()]).first()
    assert tuple(round(x, 9) if isinstance(x, float) else x for x in got) == want


def test_upsert_and_fallback(spark, rows):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, n long, v string")
    last = ledger.latest(a, ["k"], ["n"])
    assert rows(last) == [("k", 2, "y")]
    b = spark.createDataFrame([("k", 9, "z"), ("m", 1, "w")], "k string, n long, v string")
    assert rows(ledger.coalesced(last, b, ["k"])) == [("k", "first", 2, "y"), ("m", "second", 1, "w")]
    assert rows(ledger.missing(b, a, ["k"])) == [("m", 1, "w")]


def test_balances(spark, rows):
    data = [("s", "grant", 100), ("s", "reserve", 40), ("s", "release", 40), ("s", "charge", 25), ("s", "refund", 5), ("s", "adjust", -10), ("t", "grant", 7)]
    df = spark.createDataFrame(data, "owner string, kind string, seconds long")
    assert rows(ledger.balances(df, "owner")) == [("s", 90, 0, 20, 70), ("t", 7, 0, 0, 7)]
    with pytest.raises(Exception, match="unknown kind gift"):
        ledger.balances(df.selectExpr("owner", "'gift' as kind", "seconds"), "owner").collect()


def test_clipped_charge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 10), (50, 10), (5, 10), (None, 10)], "a long, r long")
    assert [r[0] for r in df.select(ledger.clipped(F.col("a"), F.col("r"))).collect()] == [1, 10, 5, 10]
