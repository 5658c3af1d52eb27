"""Queries over the whole of processed_records, not one split of it."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """A folder of tables: the largest token and most sequences lie in train records."""
    d = tmp_path_factory.mktemp("splits")
    word = lambda n: "x" * n
    rows = [(k, " ".join([word(1 + k % 7)] * 99), "s", "train") for k in range(40)]
    rows += [(100 + k, " ".join([word(3)] * 99), "s", "validation") for k in range(4)]
    rows += [(200, word(500), "s", "train"), (201, word(40) + " a", "t", "test"), (202, word(8), "s", None), (203, None, "s", "train")]
    spark.createDataFrame(rows, "record_id long, text string, source_id string, split string").write.parquet(f"{d}/processed_records.parquet")
    return str(d)


def test_largest_token_of_every_split(spark, records, rows):
    assert rows(entry.queries()["vocab_check"](spark, records)) == [("test", 40), ("train", 500), ("validation", 3)]


def test_sequences_of_every_split(spark, records):
    got = entry.queries()["sequence_packing"](spark, records).groupBy("split").count().collect()
    # 40 * 100 + 2 + 2 tokens of train, the last one without a label; 400 of validation; 3 of test
    assert {r["split"]: r["count"] for r in got} == {"train": 4003 // 128, "validation": 399 // 128}


def test_labels_stay_within_their_split(spark, records):
    got = entry.queries()["next_token"](spark, records)
    ends = {r["split"]: (r["position"], r["token"]) for r in got.where("label is null").collect()}
    assert ends == {"train": (4003, 0), "validation": (399, 0), "test": (2, 0)}
    assert got.count() == 4004 + 400 + 3


def test_round_trip_reads_every_token_of_every_split(spark, records, rows):
    got = entry.queries()["shard_round_trip"](spark, records)
    assert rows(got) == rows(entry.queries()["next_token"](spark, records), "split", "position", "token")


def test_round_trip_across_shards(spark, tmp_path, rows):
    """Several shards of a split, the last one not full, none of whose borders is a block's."""
    from weftline.plans import files

    text = " ".join("x" * (1 + k % 9) for k in range(1699))
    spark.createDataFrame([(k, text, "s", "train") for k in range(10)], "record_id long, text string, source_id string, split string").write.parquet(f"{tmp_path}/processed_records.parquet")
    got = rows(files.shard_round_trip(spark, str(tmp_path)))
    want = ([1 + k % 9 for k in range(1699)] + [0]) * 10
    assert got == sorted([("train", p, t) for p, t in enumerate(want)], key=repr)
    assert len(got) > 3 * files.SHARD


def test_partial_range_is_part_of_the_whole(spark, tmp_path, rows):
    from weftline.sources import shards

    docs = spark.createDataFrame([(k, "s", [k] * 70) for k in range(100)], "record_id long, source_id string, tokens array<long>")
    shards.write_shards(docs, ["record_id"], str(tmp_path), 500)
    uri = f"file://{tmp_path}/index.json"
    assert rows(shards.read_range(spark, uri, 100, 4100, block=150)) == rows(shards.read_range(spark, uri).where("position >= 100 and position < 4100"))


def test_shuffle_rewrites_every_split(spark, records, rows):
    got = rows(entry.queries()["corpus_shuffle"](spark, records))
    before = rows(entry.queries()["next_token"](spark, records), "split", "position", "token")
    assert [r[:2] for r in got] == [r[:2] for r in before if r[0] != "x"]
    assert sorted((s, t) for s, _, t in got) == sorted((s, t) for s, _, t in before)
    assert [t for s, _, t in sorted(got) if s == "test"] == [40, 1, 0]  # one chunk stays as it is
