import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weftline.operators import ledger, records
from weftline.sources import export, resume, shards, sinks, tables


def test_failure_details(spark, rows):
    data = [(1, "numerical", " loss is nan ", None), (2, "odd", None, "gone"), (3, "odd", " ", None), (4, None, None, None), (5, "", "x", "y")]
    df = spark.createDataFrame(data, "k int, kind string, message string, error string")
    got = df.select("k", records.failure_detail(F.col("kind"), F.col("message"), F.lit(None).cast("string"), F.col("error"), ("numerical",)))
    assert rows(got) == [(1, "loss is nan"), (2, "odd: gone"), (3, "odd"), (4, ""), (5, "x")]
    shown = spark.createDataFrame([("config", "token=abc"), ("system", "token=abc"), ("system", "ValueError: token=abc"), (None, None)], "r string, t string")
    assert [r[0] for r in shown.select(records.shown_detail(F.col("r"), F.col("t"), ("config",))).collect()] == ["token=[redacted]", "", "ValueError: token=[redacted]", ""]
    parts = spark.createDataFrame([("slurm", "", None)], "a string, b string, c string")
    assert parts.select(records.parts_text(name=F.col("a"), job=F.col("b"), message=F.col("c"))).first()[0] == "name=slurm"


def test_small_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], 2.0, " e1", None, None, 5, 7), ([1.0], 1.1, " ", "f1", 3, None, 7), (None, None, None, None, None, None, 7)], "l array<double>, s double, e string, f string, m long, c long, r long")
    got = df.select(records.final_loss(F.col("l"), F.col("s")), records.worker_identity(F.col("e"), F.col("f")), records.runtime_limit(F.col("m"), F.col("c"), F.col("r")), records.run_number("exp", F.lit(7))).collect()
    assert [tuple(r) for r in got] == [(2.0, "e1", 5, "exp-000007"), (None, "f1", 3, "exp-000007"), (None, None, 7, "exp-000007")]
    with pytest.raises(Exception, match="positive"):
        df.select(records.runtime_limit(F.lit(0).cast("long"), F.col("c"), F.col("r"))).collect()


def test_locations(spark):
    data = [(None, "a/b", None, {}, 1, 0), (None, "a/b", "sub", {"hf_revision": '"x"', "hf_data_dir": None}, 4, 2), ("/data", "a", "b", {"k": "1"}, 1, 0), (" ", "a", None, None, 2, 1)]
    df = spark.createDataFrame(data, "local string, path string, name string, options map<string,string>, parts int, part int")
    got = [r[0] for r in df.select(records.location(*map(F.col, ("local", "path", "name", "options", "parts", "part")))).collect()]
    assert got == ["a/b", 'a/b:sub?hf_revision="x"#download_shard=2/4', "/data", "a#download_shard=1/2"]


def test_phases_turns_chunks_and_messages(spark, rows):
    data = [("a", "submitted", False), ("a", "validation", False), ("b", "validation", True), ("c", "worker_started", True), ("d", "worker_failed", False), ("d", "worker_started", False)]
    df = spark.createDataFrame(data, "run string, type string, final boolean")
    assert rows(df.groupBy("run").agg(records.phase(F.col("type"), F.col("final"), ("worker_failed",)).alias("p"))) == [("a", "running"), ("b", "submitted"), ("c", "running"), ("d", "ended")]
    tasks = spark.createDataFrame([(s, p) for s in "abc" for p in (0, 1)], "s string, p int")
    assert [(r.s, r.p) for r in records.turns(tasks, "s", "p", 2).orderBy("turn").collect()] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 1)]
    lines = spark.createDataFrame([(f, n) for f in (0, 1) for n in range(5)], "f int, n int")
    assert [c for _, _, c in rows(records.chunks(lines, ["f", "n"], 4))] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert rows(records.first_few(lines.selectExpr("f", "n + 10 * f as n"), ["f"], "n", 3)) == [(0, "0, 1, 2", 2), (1, "10, 11, 12", 2)]
    events = spark.createDataFrame([("e1", 1), (" ", 2), (None, 3), ("e2", 4)], "experiment_id string, k int")
    assert [r.k for r in ledger.of_experiments(events).orderBy("k").collect()] == [1, 4] and ledger.of_experiments(events, "e2").count() == 1


def test_export_set(spark, tmp_path):
    runs = spark.createDataFrame([("f1", "s1", 2.8, 2.7, 2.9, 2.75, None), ("f2", "s2", None, None, None, None, 0.5)], "final_run_id string, student_id string, predicted_final_loss double, predicted_final_loss_lower double, predicted_final_loss_upper double, actual_final_validation_loss double, prediction_absolute_error double")
    paths = export.course_export(spark, {"final_runs": runs}, f"file://{tmp_path}")
    assert len(paths) == 13 and sum(k.endswith("_csv") for k in paths) == 5
    grades = {r["final_run_id"]: r for r in spark.read.csv(paths["grading_csv"], header=True).collect()}
    assert grades["f1"]["prediction_interval_covered"] == "true" and round(float(grades["f1"]["prediction_quality_penalty"]), 6) == 0.125
    assert grades["f2"]["prediction_absolute_error"] == "0.5" and not grades["f2"]["prediction_interval_covered"]
    assert list(grades["f1"].asDict()) == export.COLUMNS["grading"]
    assert tables.csv_rows(spark, paths["experiments_csv"]) == 0 and spark.read.csv(paths["experiments_csv"], header=True).columns == export.COLUMNS["experiments"]
    with pytest.raises(ValueError):
        export.course_export(spark, {"x": runs}, f"file://{tmp_path}/y")


def test_ingest_goes_on_and_begins_anew(spark, tmp_path):
    df = spark.range(100).selectExpr("id as ordinal", "concat('text ', id) as text").repartition(3)
    ask = lambda rows, **more: resume.ingest(rows, str(tmp_path), {"location": "a", "field": "text"} | more.pop("request", {}), F.lit(10), batch=30, **more)
    broken = df.withColumn("text", F.when(F.col("ordinal") >= 60, F.raise_error(F.lit("gone")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="gone"):
        ask(broken)
    state = tables.load_json(f"{tmp_path}/state.json")
    assert (state["status"], state["batches"], state["scanned_documents"]) == ("interrupted", 2, 60)
    assert resume.ingested(df, str(tmp_path)).count() == 60
    done = ask(df)
    assert (done["status"], done["stop_reason"], done["written_documents"], done["estimated_tokens"]) == ("completed", "source_exhausted", 100, 1000)
    assert resume.ingested(df, str(tmp_path)).select("ordinal").distinct().count() == 100
    assert ask(broken) == done  # not repeated
    limited = ask(df, max_tokens=415)
    assert (limited["stop_reason"], limited["written_documents"]) == ("max_tokens", 42) and resume.ingested(df, str(tmp_path)).count() == 42
    assert ask(df, max_documents=45)["written_documents"] == 45
    with pytest.raises(Exception, match="gone"):
        ask(broken, request={"field": "body"})


def test_torn_log_is_cut_and_compressed(tmp_path):
    log = tmp_path / "a.resume.jsonl"
    log.write_bytes(b'{"a":1}\n{"a":2}\n{"a":')
    assert resume.repair(str(log)) == 2 and log.read_bytes() == b'{"a":1}\n{"a":2}\n'
    assert resume.finalize(str(log), str(tmp_path / "a.jsonl.gz")) == 2 and not log.exists()
    assert gzip.open(tmp_path / "a.jsonl.gz").read() == b'{"a":1}\n{"a":2}\n'
    log.write_bytes(b"torn")
    assert resume.repair(str(log)) == 0 and log.read_bytes() == b""


class _Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        self.seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        self.send_response(200)
        self.end_headers()

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        shard = {"path": "tokens-000000.bin", "tokens": 3}
        self.wfile.write(json.dumps(shards.INDEX | {"total_tokens": 3 if self.path == "/good" else 4, "shards": [shard]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_index_over_http(server, tmp_path):
    assert shards.read_index(f"{server}/good")["total_tokens"] == 3
    for bad, match in ((f"{server}/bad", "sum of the shards"), ("s3://b/index.json", "mounted"), ("gs://b/i", "mounted")):
        with pytest.raises(ValueError, match=match):
            shards.read_index(bad)
    with pytest.raises(ValueError, match="larger"):
        shards.read_index(f"{server}/good", most=10)
    (tmp_path / "i.json").write_text("[]")
    with pytest.raises(ValueError):
        shards.read_index(str(tmp_path / "i.json"))


def test_sinks(spark, server, tmp_path):
    log = tmp_path / "events.jsonl"
    emit = sinks.Emitter("exp-1", sinks.All(sinks.Lines(str(log)), sinks.Http(f"{server}/events")))
    emit("worker_started")
    emit("validation", loss=2.5)
    want = [{"event_id": "exp-1:000001", "type": "worker_started"}, {"event_id": "exp-1:000002", "type": "validation", "loss": 2.5}]
    assert [json.loads(x) for x in log.read_text().splitlines()] == want and _Handler.seen[-2:] == want
    sinks.send(spark.createDataFrame([("a", 1), ("b", 2)], "type string, n int"), sinks.Lines(str(log)))
    assert len(log.read_text().splitlines()) == 4


def test_manifests_keys_and_settings(spark, tmp_path):
    store = sinks.Manifests(str(tmp_path), "https://host/runs/")
    assert store.put("exp-1", {"a": 1}) == "https://host/runs/exp-1.json" and store.get("exp-1") == {"a": 1}
    for bad in ("../x", "a/b", "", ".."):
        with pytest.raises(ValueError):
            store.put(bad, {})
    with pytest.raises(ValueError):
        sinks.Manifests(str(tmp_path), "ftp://x")
    tables.write_env(str(tmp_path / "env"), {"A": "it's", "N": 3})
    assert (tmp_path / "env").read_text().splitlines() == ["export A='it'\"'\"'s'", "export N=3"]
    (tmp_path / "roster.csv").write_text("student_id\ns2\ns1\n")
    assert tables.student_keys(spark, str(tmp_path / "roster.csv"), str(tmp_path / "keys.csv")) == 2
    keys = spark.read.csv(str(tmp_path / "keys.csv"), header=True).collect()
    assert [r.student_id for r in keys] == ["s1", "s2"] and len({r.api_key for r in keys}) == 2
