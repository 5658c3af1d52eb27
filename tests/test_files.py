import gzip
import json
import os
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.functions import bloom
from weftline.plans import pipeline
from weftline.sources import hub, jsonl, shards, tables
from weftline.streaming import events

LENGTHS = "tests.test_files:lengths"


def lengths():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def put(path, records, opener=open):
    with opener(path, "wt", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)


def test_scan_of_all_codecs_in_path_order(spark, tmp_path):
    put(tmp_path / "b.jsonl", [{"text": "zwei"}])
    put(tmp_path / "a.jsonl.gz", [{"text": "eins"}, {"text": 3}, {"text": None, "source_id": "s"}], gzip.open)
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.compress('{"text": "drei é"}\n'.encode()))
    (tmp_path / "note.txt").write_text("no")
    got = [(r.file_idx, r.line_no, r.text, r.source_id) for r in jsonl.raw_records(spark, str(tmp_path)).orderBy("file_idx", "line_no").collect()]
    assert got == [(0, 0, "eins", "a.jsonl"), (0, 1, None, "a.jsonl"), (0, 2, None, "s"), (1, 0, "zwei", "b"), (2, 0, "drei é", "c.jsonl")]


def test_scan_of_a_uri_equals_that_of_the_folder(spark, tmp_path, rows):
    put(tmp_path / "b.jsonl", [{"text": "zwei"}, {"text": "é 漢"}])
    put(tmp_path / "a.jsonl.gz", [{"text": "eins"}, {"text": 3}], gzip.open)
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl").write_bytes(b'{"text": "x"}\r\n{"text": "y"}')
    (tmp_path / "note.txt").write_text("no")
    by_folder, by_uri = (rows(jsonl.records(spark, at).select("file_idx", "line_no", F.to_json("value"))) for at in (str(tmp_path), f"file://{tmp_path}"))
    assert [r[1:] for r in by_folder] == [r[1:] for r in by_uri] and len(by_uri) == 6
    assert [r[0] for r in by_uri] == [0, 0, 1, 1, 2, 2]  # empty files take no number there


def test_raw_records_of_a_uri_equal_those_of_the_folder(spark, tmp_path, rows):
    put(tmp_path / "b.c.jsonl", [{"text": "zwei"}, {"text": "drei", "source_id": "s"}])
    put(tmp_path / "a.jsonl.gz", [{"text": "eins", "text_preprocessed": True}], gzip.open)
    by_folder, by_uri = (rows(jsonl.raw_records(spark, at)) for at in (str(tmp_path), f"file://{tmp_path}"))
    assert by_folder == by_uri and [r[3] for r in by_uri] == ["a.jsonl", "b.c", "s"]
    (tmp_path / "empty").mkdir()
    for at in (f"{tmp_path}/empty", f"file://{tmp_path}/empty"):
        with pytest.raises(FileNotFoundError, match="no JSON lines"):
            jsonl.raw_records(spark, at)


def test_files_of_splits(spark, tmp_path, rows):
    put(tmp_path / "train.jsonl", [{"text": "a"}, {"text": "b"}])
    put(tmp_path / "validation.jsonl.gz", [{"text": "c"}], gzip.open)
    got = jsonl.split_records(spark, str(tmp_path), ["validation", "train", "validation"])
    assert rows(got.select("split", "line_no", jsonl.text_of(F.col("value"), "text"))) == [("train", 0, "a"), ("train", 1, "b"), ("validation", 0, "c")]
    with pytest.raises(FileNotFoundError):
        jsonl.split_file(str(tmp_path), "test")
    put(tmp_path / "train.jsonl.gz", [], gzip.open)
    with pytest.raises(ValueError, match="several files: train.jsonl, train.jsonl.gz"):
        jsonl.split_file(str(tmp_path), "train")


def test_malformed_and_blank_lines_fail_with_their_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\n')
    with pytest.raises(Exception, match="line 2 of file 0"):
        jsonl.raw_records(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="field body is missing"):
        (tmp_path / "a.jsonl").write_text('{"text": "x"}\n')
        jsonl.records(spark, str(tmp_path)).select(jsonl.text_of(F.col("value"), "body", required=True)).collect()


def test_empty_folder(spark, tmp_path):
    assert jsonl.lines(spark, str(tmp_path)).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("ü", None, "train"), ("b", 2, "validation")], "b string, a int, split string")
    jsonl.write(df, str(tmp_path / "o"), split="split")
    assert {p.name for p in (tmp_path / "o").iterdir() if p.is_dir()} == {"split=train", "split=validation"}
    jsonl.write_sorted(df.drop("split").coalesce(1), str(tmp_path / "s"))
    assert "".join(p.read_text() for p in (tmp_path / "s").glob("part*")).splitlines() == ['{"a":null,"b":"ü"}', '{"a":2,"b":"b"}']
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"), ["split", "a"])
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part*")).splitlines() == ["split,a", "train,", "validation,2"]


def test_unique_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_text("student_id,api_key\ns1,a\ns2,a\n")
    with pytest.raises(ValueError, match="twice"):
        tables.unique_csv(spark, str(tmp_path / "k.csv"), ["student_id"], "api_key")
    with pytest.raises(ValueError, match="lacks"):
        tables.unique_csv(spark, str(tmp_path / "k.csv"), ["x"], "api_key")
    assert tables.unique_csv(spark, str(tmp_path / "k.csv"), ["api_key"], "student_id").count() == 2


def test_json_and_guards(tmp_path):
    tables.write_json(str(tmp_path / "d" / "m.json"), {"b": 1, "a": "é"})
    assert tables.load_json(f"file://{tmp_path}/d/m.json") == tables.load_json('{"a": "é", "b": 1}') == {"a": "é", "b": 1}
    assert os.listdir(tmp_path / "d") == ["m.json"]
    with pytest.raises(FileExistsError):
        tables.clear_folder(str(tmp_path / "d"), re.compile("tokens-.*"))
    tables.clear_folder(str(tmp_path / "d"), re.compile("m.json"))
    assert os.listdir(tmp_path / "d") == []


def test_snapshot_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.save_tables({"t": df, "u": df}, str(tmp_path))
    assert rows(tables.load_tables(spark, str(tmp_path))["u"]) == [(1, "a")]
    with pytest.raises(ValueError):
        tables.load_tables(spark, str(tmp_path), version=2)
    with pytest.raises(ValueError, match="differ .* in u, v"):
        tables.load_tables(spark, str(tmp_path), {"t", "v"})


def write(spark, folder, size=3):
    df = spark.createDataFrame([("general_web", 0, [1, 2]), ("code", 1, [3, 4, 4294967295])], "source_id string, k long, tokens array<long>")
    return shards.write_shards(df, ["k"], str(folder), size)


def test_shards(spark, tmp_path):
    index = write(spark, tmp_path)
    assert index["total_tokens"] == 5 and [s["source_token_counts"] for s in index["shards"]] == [{"code": 1, "general_web": 2}, {"code": 2}]
    assert np.fromfile(tmp_path / "tokens-000001.bin", "<u4").tolist() == [4, 4294967295]
    uri = f"file://{tmp_path}/index.json"
    assert shards.load_index(uri, full=True) == index
    assert [r.token for r in shards.read_range(spark, uri, 1, 4, block=2).orderBy("position").collect()] == [2, 3, 4]
    at = spark.createDataFrame([(4,), (0,)], "position long")
    assert {tuple(r) for r in shards.read_positions(spark, uri, at).collect()} == {(4, 4294967295), (0, 1)}
    (tmp_path / "tokens-000000.bin").write_bytes(b"\0" * 12)
    shards.load_index(uri)
    with pytest.raises(ValueError, match="hash"):
        shards.load_index(uri, full=True)
    with pytest.raises(ValueError, match="mounted"):
        shards.load_index("s3://x/index.json")


def test_shuffled_corpus_keeps_chunks_and_mixes_sources(spark, tmp_path):
    rows = [(s, k, [n * 100 + i for i in range(1, 5)]) for k, (n, s) in enumerate([(1, "code"), (2, "math"), (3, "general_web")])]
    shards.write_shards(spark.createDataFrame(rows, "source_id string, k long, tokens array<long>"), ["k"], str(tmp_path / "a"), 4)
    index = shards.shuffle_corpus(spark, f"{tmp_path}/a/index.json", str(tmp_path / "b"), 2, 17, 5)
    assert index["source_token_counts"] == {"code": 4, "general_web": 4, "math": 4} and [s["tokens"] for s in index["shards"]] == [5, 5, 2]
    assert shards.load_index(f"{tmp_path}/b/index.json", full=True) == index
    got = [r.token for r in shards.read_range(spark, f"{tmp_path}/b/index.json").orderBy("position").collect()]
    chunks = [tuple(got[k : k + 2]) for k in range(0, 12, 2)]
    assert sorted(chunks) == [(101, 102), (103, 104), (201, 202), (203, 204), (301, 302), (303, 304)]
    assert {c[0] // 100 for c in chunks[:3]} == {1, 2, 3}


def test_order_of_sources_is_that_of_first_appearance():
    index = {"shards": [{"source_token_counts": {"m": 1, " b ": 2, "z": 0}}, {"source_token_counts": {"a": 3, "b": 1, " ": 4}}]}
    assert list(shards.source_order(index)) == ["b", "m", "a", "unknown"]
    assert list(shards.source_order(index, ["z", "m", "z"])) == ["z", "m", "b", "a", "unknown"]
    assert shards.normal_counts({" x": 1, "x ": 2, "": 3, "y": 0}) == {"x": 3, "unknown": 3}


def test_package(spark, tmp_path):
    write(spark, tmp_path / "a")
    for k in range(5):
        (tmp_path / "many").mkdir(exist_ok=True)
        np.array([k], "<u4").tofile(tmp_path / "many" / f"tokens-{k:06d}.bin")
    shards.package(str(tmp_path / "many"), str(tmp_path / "q"), 2, 2)
    read = lambda p: [int(np.fromfile(f, "<u4")[0]) for f in shards.listing(str(p))]
    assert read(tmp_path / "q" / "train") == [0, 1] and read(tmp_path / "q" / "validation") == [2, 3]
    shards.package(str(tmp_path / "many"), str(tmp_path / "r"), 4, 1, validation_source=str(tmp_path / "q" / "validation"))
    assert read(tmp_path / "r" / "train") == [0, 1, 2, 3] and read(tmp_path / "r" / "validation") == [2]
    with pytest.raises(ValueError, match="wanted"):
        shards.package(str(tmp_path / "many"), str(tmp_path / "s"), 5, 1)
    got = shards.package(str(tmp_path / "a"), str(tmp_path / "p"), 1, how="hardlink")
    summary = shards.index_summary(spark, {s: f"{tmp_path}/p/{s}/index.json" for s in ("train", "validation")})
    assert sorted(map(tuple, summary.collect())) == [("train", 1, 3, 0, 3), ("validation", 1, 2, 0, 2)]
    assert got["train"]["total_tokens"] == 3 and shards.load_index(f"{tmp_path}/p/validation/index.json", full=True)["total_tokens"] == 2


def remote(options):
    return [{"text": f"t{k}"} if k != 3 else {"text": 5} for k in range(6)]


def test_hub_source(spark):
    source = {"loader": "tests.test_files:remote", "shards": 2, "skip": 1}
    got = sorted((r.file_idx, r.line_no, r.text) for r in hub.rows(spark, source).collect())
    assert got == [(0, 1, "t2"), (0, 2, "t4"), (1, 1, None), (1, 2, "t5")]


def test_pipeline(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    docs = [{"body": " ".join(words[(i * k) % 5] for i in range(12)) + f" {k}", "source_id": "code" if k % 2 else "math"} for k in range(40)]
    put(raw / "a.jsonl", docs)
    put(raw / "b.jsonl", docs[:5] + [{"body": "x"}])
    settings = {"tokenizer": "lengths", "text_field": "body", "min_chars": 20, "validation_rate": 0.3, "buckets": 4, "shard_tokens": 64, "limits": {"code": 100}}
    got = pipeline.prepare(spark, str(raw), str(tmp_path / "out"), lengths, 0, **settings)
    s = got["statistics"]
    assert (s["input_documents"], s["dropped_duplicate_documents"], s["dropped_short_documents"]) == (46, 5, 1)
    assert s["kept_train_documents"] + s["kept_validation_documents"] == 40
    train = shards.load_index(f"{tmp_path}/out/train/index.json", full=True)
    assert train["source_token_counts"]["code"] <= 100 and all(x["tokens"] == 64 for x in train["shards"][:-1])
    assert got["splits"]["validation"]["total_tokens"] == 14 * s["kept_validation_documents"]
    assert pipeline.prepare(spark, str(raw), str(tmp_path / "out"), None, 0, **settings) == got  # not run again
    os.remove(f"{tmp_path}/out/train/tokens-000000.bin")
    assert pipeline.prepare(spark, str(raw), str(tmp_path / "out"), lengths, 0, **settings) == got  # a shard was lost
    other = pipeline.prepare(spark, f"file://{raw}", str(tmp_path / "out"), lambda: lambda texts: [[1] for _ in texts], 0, **settings | {"tokenizer": "ones"})
    assert other["splits"]["validation"]["total_tokens"] == 2 * s["kept_validation_documents"] and other["statistics"] == s
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        pipeline.prepare(spark, f"file://{tmp_path}/none", str(tmp_path / "out"), lengths, 0)


def test_rebuild_from_processed_records(spark, tmp_path):
    folder = tmp_path / "processed"
    folder.mkdir()
    put(folder / "train.jsonl.gz", [{"text": "alpha beta " * (k + 1), "source_id": "code" if k % 2 else None, "document_hash": f"h{k}"} for k in range(6)], gzip.open)
    put(folder / "validation.jsonl", [{"text": "gamma"}])
    got = pipeline.rebuild(spark, str(folder), str(tmp_path / "out"), lengths, 0, buckets=4, shard_tokens=16, limits={"code": 20})
    assert got["splits"]["train"]["source_token_counts"]["unknown"] == 3 + 7 + 11 and got["splits"]["train"]["source_token_counts"]["code"] <= 20
    assert got["splits"]["validation"]["total_tokens"] == 2 and shards.load_index(f"{tmp_path}/out/train/index.json", full=True)


def test_unknown_event_types_fail_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.json", [{"delivery_id": 1, "experiment_id": "r", "type": "odd"}])
    query = events.run_states(events.stream(spark, str(folder), 1), known=("heartbeat",)).writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    with pytest.raises(Exception, match="unknown event type odd"):
        query.awaitTermination()


def test_streams(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    base = {"experiment_id": "r", "final_run_id": None, "timestamp": "2026-01-01T00:00:00Z"}
    put(folder / "1.json", [base | {"delivery_id": 1, "event_id": "r:1", "type": "worker_started"}, base | {"delivery_id": 2, "event_id": "r:1", "type": "worker_started"}, base | {"delivery_id": 3, "event_id": None, "type": "validation", "loss": 2.5}])
    put(folder / "2.json", [base | {"delivery_id": 4, "event_id": "r:2", "type": "worker_completed"}, base | {"delivery_id": 5, "event_id": "r:1", "type": "worker_started"}, base | {"delivery_id": 6, "event_id": None, "type": "validation", "loss": 2.5}, base | {"delivery_id": 7, "event_id": "r:9", "type": "heartbeat"}])
    once = events.exactly_once(events.stream(spark, str(folder), 1))
    events.available_now(once, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
    assert {i for i, again in rows(spark.read.parquet(str(tmp_path / "out"))) if again} == {2, 5, 6}
    put(folder / "3.json", [base | {"delivery_id": 8, "event_id": "r:9", "type": "heartbeat"}])
    events.available_now(once, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    assert {i for i, again in rows(spark.read.parquet(str(tmp_path / "out"))) if again} == {2, 5, 6, 8}
    query = events.run_states(events.stream(spark, str(folder), 10)).writeStream.format("memory").queryName("runs").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    query.awaitTermination()
    assert rows(spark.table("runs")) == [("r", 4, 1, 2.5, "worker_completed", True, 4)]


def test_bloom(spark):
    df = spark.range(2000).selectExpr("id * 7919 as h").repartition(4)
    both = df.unionByName(df.where("h % 5 = 0")).repartition(4)
    again = bloom.repeated(both, 1 << 16)
    marked = df.withColumn("m", again(F.col("h")))
    assert marked.where("h % 5 = 0 and not m").count() == 0 and marked.where("h % 5 <> 0 and m").count() < 60
    listed = df.where("h % 10 = 0").unionByName(spark.createDataFrame([(None,)], "h long"))
    left = bloom.without(df.unionByName(spark.createDataFrame([(None,)], "h long")), listed, "h")
    assert left.count() == 1801
    assert bloom.bits_for(0) == 1 << 16 and bloom.bits_for(10**12) == 1 << 44
