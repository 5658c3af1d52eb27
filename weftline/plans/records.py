"""Queries of run records, configurations and manifests as others see them, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import finite
from weftline.operators import blend, checks, ledger, records, shuffle
from weftline.operators.prefix import ordinals
from weftline.plans import corpus
from weftline.plans.corpus import table
from weftline.plans.runs import ACTIVE, TERMINAL

#: Sources that stand in for reasons of failure: those whose details are shown, and those that a detail does not repeat.
SHOWN, KNOWN = ("code", "math"), ("code", "general_web")
PRIVATE = ("message", "step")
ALLOWED = ["d_model", "n_heads", "n_layers", "global_batch_size", "sequence_length", "total_tokens", "learning_rate", "dropout", "warmup_steps", "optimizer", "seed", "run_name", "training_config"]
DEVICES, VOCABULARY = 4, 50_000


def public_failure_detail(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts as failure details of a reason, as they may be shown."""
    reason = F.lower(F.trim("source_id"))
    none = F.lit(None).cast("string")
    detail = records.failure_detail(reason, F.col("text"), none, none, KNOWN)
    return table(spark, d, "raw_records").select("record_id", records.shown_detail(reason, detail, SHOWN).alias("detail"))


def provider_details(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each experiment's job, as one text."""
    parts = records.parts_text(provider_name=F.col("provider_name"), provider_job_id=F.col("provider_job_id"), provider_status=F.col("provider_status"), raw_status=F.col("failure_reason"))
    return table(spark, d, "experiments").select("experiment_id", parts.alias("detail"))


def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a run's interval as in prediction_scores; a failed run's stored error stands in place of the computed one."""
    losses = F.col("validation_losses")
    computed = ledger.prediction_scores(F.try_element_at(losses, F.lit(-2)), F.array_min(losses), F.array_max(losses), finite(F.col("final_validation_loss")))
    stored = {k: F.lit(None).cast("boolean" if k == "covered" else "double") for k in computed} | {"absolute_error": F.when(F.col("status") == "failed", F.lit(1.0))}
    best = records.stored_or_computed(stored, computed)
    return table(spark, d, "experiments").select("experiment_id", *[c.alias(k) if k == "covered" else F.round(c, 6).alias(k) for k, c in best.items()])


def final_losses(spark: SparkSession, d: str) -> DataFrame:
    """Completed runs with their last loss, null where the supplied one is another."""
    loss = records.final_loss(F.col("validation_losses"), F.col("final_validation_loss"))
    return table(spark, d, "experiments").where("status = 'completed'").select("experiment_id", loss.alias("final_loss"), (loss.isNull() & F.col("final_validation_loss").isNotNull()).alias("refused"))


def run_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Experiments by number, with the id that number has."""
    rows = table(spark, d, "experiments").select("experiment_id")
    numbered = rows.join(ordinals(rows, ["experiment_id"]), "experiment_id")
    return numbered.select("experiment_id", (F.col("ordinal") + 1).alias("number"), records.run_number("exp", F.col("ordinal") + 1, 8).alias("formatted"))


def worker_identities(spark: SparkSession, d: str) -> DataFrame:
    """Events by the run a worker speaks for, which names the experiment first, and whether it is another one than the run that the ledger books."""
    rows = table(spark, d, "experiment_events")
    worker = records.worker_identity(F.col("experiment_id"), F.col("final_run_id"))
    booked = records.worker_identity(F.col("final_run_id"), F.col("experiment_id"))
    return rows.groupBy(worker.alias("run_id")).agg(F.count("*").alias("events"), F.count_if(worker != booked).alias("booked_elsewhere"))


def runtime_limits(spark: SparkSession, d: str) -> DataFrame:
    """The limit of each experiment: what it used stands for the manifest's, a job's absence for the configuration's."""
    limit = records.runtime_limit(F.when(F.col("status") == "completed", F.col("used_runtime_seconds")), F.when(F.col("provider_job_id").isNull(), F.lit(600).cast("long")), F.col("reserved_runtime_seconds"))
    return table(spark, d, "experiments").where("reserved_runtime_seconds > 0 and (status <> 'completed' or coalesce(used_runtime_seconds, 1) > 0)").select("experiment_id", limit.alias("limit"))


def artifact_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Schemes and hosts of the logs' URIs."""
    uri = F.col("provider_artifacts.logs_uri")
    return table(spark, d, "experiments").groupBy(F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("runs"))


def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Students of requests by their key; a key that nobody has gives null. The smaller side is sent to tasks if Spark finds it small."""
    keys = table(spark, d, "budget_snapshots").select(F.md5(F.col("student_id")).alias("api_key"), "student_id")
    requests = table(spark, d, "experiments").select("experiment_id", F.md5(F.when(F.col("status") == "cancelled", F.lit("nobody")).otherwise(F.col("student_id"))).alias("api_key"))
    return requests.join(keys, "api_key", "left").select("experiment_id", "student_id")


def active_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Active experiments of each student, and of all of them under a null student."""
    return table(spark, d, "experiments").where("student_id is not null").rollup("student_id").agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count("*").alias("runs"))


def status_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: runs by status, students, and whether all of several things hold."""
    rows = table(spark, d, "experiments")
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "queued", "submitted")]
    return rows.agg(
        F.count("*").alias("runs"),
        F.count_distinct("student_id").alias("students"),
        *by,
        F.bool_and(F.coalesce(F.col("status") != "completed", F.lit(True)) | F.col("final_validation_loss").isNotNull()).alias("completed_have_loss"),
        F.bool_and(F.col("reserved_runtime_seconds") > 0).alias("all_reserved"),
    )


def source_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources by first appearance over all shards, by name within one."""
    first = shuffle.with_first(shuffle.source_counts(corpus._shards(spark, d)), "shard_id").select("first", "source").distinct()
    return first.join(ordinals(first, ["first", "source"], "rank"), ["first", "source"]).select("source", "rank")


def first_short_records(spark: SparkSession, d: str) -> DataFrame:
    """The first eight records of each source that are short, as a message lists them."""
    rows = table(spark, d, "raw_records").where(F.coalesce(F.char_length("text"), F.lit(0)) < corpus.MIN_CHARS).select(corpus.source("source_id").alias("source"), "record_id")
    return records.first_few(rows, ["source"], "record_id", 8)


def queued_without_job(spark: SparkSession, d: str) -> DataFrame:
    """Active experiments that no job was made for."""
    return table(spark, d, "experiments").where(F.col("status").isin(*ACTIVE) & (F.coalesce(F.trim("provider_job_id"), F.lit("")) == "")).select("experiment_id", "status")


def failed_experiments(spark: SparkSession, d: str) -> DataFrame:
    """Experiments by status and, were one given, by student."""
    return ledger.selected(table(spark, d, "experiments"), status="failed").select("experiment_id", "student_id", "failure_reason")


def experiment_only_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of experiments among all worker events, by experiment."""
    return ledger.of_experiments(table(spark, d, "experiment_events")).groupBy("experiment_id").agg(F.count("*").alias("events"))


def events_of_hottest(spark: SparkSession, d: str) -> DataFrame:
    """Events of the one experiment that has most."""
    rows = ledger.of_experiments(table(spark, d, "experiment_events"))
    most = rows.groupBy("experiment_id").agg(F.count("*").alias("n")).agg(F.max_by("experiment_id", F.struct("n", "experiment_id")).alias("experiment_id"))
    return rows.join(F.broadcast(most), "experiment_id").select("delivery_id", "experiment_id", "type")  # one row


def audit_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit rows; of the two run ids a blank one is left out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    row = F.struct(F.col("type"), text("experiment_id").alias("experiment_id"), text("final_run_id").alias("final_run_id"))
    return table(spark, d, "experiment_events").select("delivery_id", F.to_json(row).alias("row"))


def public_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Keys of payloads that are left when the private ones are dropped."""
    kept = F.array_join(F.array_sort(F.map_keys(records.without_keys(F.col("payload"), PRIVATE))), ",")
    return table(spark, d, "experiment_events").groupBy("type", kept.alias("keys")).agg(F.count("*").alias("events"))


def run_phases(spark: SparkSession, d: str) -> DataFrame:
    """How far each run came."""
    final = F.coalesce(F.trim("final_run_id"), F.lit("")) != ""
    rows = table(spark, d, "experiment_events").withColumn("final", final).withColumn("run_id", records.worker_identity(F.col("final_run_id"), F.col("experiment_id")))
    return rows.groupBy("run_id").agg(records.phase(F.col("type"), F.col("final"), TERMINAL).alias("phase"))


def record_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Raw records in chunks of 512 across files: files, first line and records of each."""
    held = records.chunks(table(spark, d, "raw_records").select("file_idx", "line_no"), ["file_idx", "line_no"], 512)
    return held.groupBy("chunk").agg(F.count("*").alias("records"), F.min("file_idx").alias("first_file"), F.max("file_idx").alias("last_file"))


def download_turns(spark: SparkSession, d: str) -> DataFrame:
    """Download tasks in the order in which two sources at a time are fetched."""
    return records.turns(blend.tasks(corpus._plan(spark, d), 4, 1.15).select("id", "part"), "id", "part", 2)


def source_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where each row of the mix comes from, part 1 of 4 of the training rows."""
    null = F.lit(None).cast("string")
    options = F.create_map(F.lit("split"), F.concat(F.lit('"'), F.col("split"), F.lit('"')))
    of = records.location(null, F.col("hf_path"), F.col("hf_name"), options, F.when(F.col("split") == "train", 4).otherwise(1), F.lit(1))
    return table(spark, d, "general_100b_mix").select("download_id", of.alias("location"))


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, text, and whole numbers by name) of raw records that are a run's configuration."""
    rows = table(spark, d, "raw_records").where(r"ltrim(text) like '{%' and json_object_keys(text) is not null")
    of = lambda k: F.get_json_object("text", f"$.{k}").try_cast("long").alias(k)
    return rows.select("record_id", "text", *map(of, ("d_model", "n_heads", "n_layers", "global_batch_size", "sequence_length", "total_tokens")))


def resolved_config(spark: SparkSession, d: str) -> DataFrame:
    """Rules that each configuration breaks, and the keys it may not have."""
    head = F.col("d_model") / F.col("n_heads")
    rules = {
        "layers": ~F.coalesce(F.col("n_layers") > 0, F.lit(False)),
        "heads": F.pmod("d_model", "n_heads") != 0,
        "head_dim": (F.pmod("d_model", "n_heads") == 0) & ((head > 128) | (F.pmod(head.cast("long"), F.lit(8)) != 0)),
        "batch_sharding": F.pmod("global_batch_size", F.lit(DEVICES)) != 0,
        "parameter_sharding": F.pmod("d_model", F.lit(DEVICES)) != 0,
        "steps": F.pmod(F.col("total_tokens"), F.col("sequence_length") * F.col("global_batch_size")) != 0,
    }
    unknown = F.array_join(checks.unknown_keys(F.json_object_keys("text"), ALLOWED), ",")
    return _configs(spark, d).select("record_id", F.array_join(checks.violations(rules), ",").alias("broken"), unknown.alias("unknown"))


def config_cost(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of each configuration that says how large it is, its feed-forward layers four times as wide."""
    size = checks.parameter_count(F.col("n_layers"), F.col("d_model"), F.col("d_model") * 4, F.lit(VOCABULARY))
    return _configs(spark, d).where("n_layers is not null and d_model is not null").select("record_id", size.cast("string").alias("parameters"))


def budget_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Budgets in the order of students, with what is left."""
    rows = table(spark, d, "budget_snapshots")
    left = ledger.remaining(F.col("total_seconds"), F.col("reserved_seconds"), F.col("charged_seconds"))
    placed = rows.join(ordinals(rows.select("student_id"), ["student_id"], "place"), "student_id")
    return placed.select("place", "student_id", "total_seconds", "reserved_seconds", "charged_seconds", left.alias("remaining_seconds")).orderBy("place")


def frozen_or_live(spark: SparkSession, d: str) -> DataFrame:
    """Each student's run as it stands: the last completed one, frozen, or else the last active one, live."""
    rows = table(spark, d, "experiments").select("student_id", "experiment_id", "status")
    last = lambda df: ledger.latest(df, ["student_id"], ["experiment_id"])
    return ledger.coalesced(last(rows.where("status = 'completed'")), last(rows.where(F.col("status").isin(*ACTIVE))), ["student_id"])


def token_index_summary(spark: SparkSession, d: str) -> DataFrame:
    """Shards, tokens and sources of each split."""
    rows = table(spark, d, "token_shards").select("shard_id", "split", "source_token_counts").dropDuplicates(["shard_id"])
    counted = shuffle.source_counts(rows)
    return counted.groupBy("split").agg(F.count_distinct("shard_id").alias("shards"), F.sum("tokens").alias("tokens"), F.count_distinct("source").alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        public_failure_detail, provider_details, prediction_metrics, final_losses, run_numbers, worker_identities, runtime_limits, artifact_hosts, key_lookup, active_rollup, status_report,
        source_order, first_short_records, queued_without_job, failed_experiments, experiment_only_events, events_of_hottest, audit_payloads, public_payloads, run_phases, record_chunks,
        download_turns, source_locations, resolved_config, config_cost, budget_snapshot, frozen_or_live, token_index_summary,
    )
}

_NAMES = ", ".join(f"'{x}'" for x in ALLOWED)
_NUMBER = "try_cast(json_extract_string(text, '$.{0}') as bigint) as {0}"
_CONFIGS = f"""
with c as (select record_id, text, {', '.join(_NUMBER.format(k) for k in ('d_model', 'n_heads', 'n_layers', 'global_batch_size', 'sequence_length', 'total_tokens'))} from raw_records where ltrim(text) like '{{%' and json_valid(text))"""
_ID = "nullif(trim({}), '')"

SQL = {
    "public_failure_detail": corpus.redacted(
        f"""select record_id, case when coalesce(r in {SHOWN}, false) or coalesce(regexp_matches(x, '(?i)traceback \\(most recent call last\\):|worker failed for |\\b[a-z_][a-z0-9_.]*(error|exception):'), false) then x else '' end as x
 from (select record_id, r, case when m is null then coalesce(r, '') when coalesce(r, '') <> '' and r not in {KNOWN} then r || ': ' || m else m end as x
  from (select record_id, lower(trim(source_id)) as r, nullif(trim(text, ' '), '') as m from raw_records))"""
    ),
    "provider_details": "select experiment_id, concat_ws('; ', "
    + ", ".join(f"case when trim({c}) <> '' then '{n}=' || {c} end" for n, c in (("provider_name", "provider_name"), ("provider_job_id", "provider_job_id"), ("provider_status", "provider_status"), ("raw_status", "failure_reason")))
    + ") as detail from experiments",
    "prediction_metrics": """
with p as (select experiment_id, status, validation_losses[-2] as p, list_min(validation_losses) as lo, list_max(validation_losses) as hi, case when isfinite(final_validation_loss) then final_validation_loss end as a from experiments),
q as (select *, abs(p - a) as e, case when p is not null and a is not null and lo <= hi then hi - lo end as w, case when p is not null and a is not null and lo <= hi then greatest(0, lo - a) + greatest(0, a - hi) end as m from p)
select experiment_id, case when status = 'failed' then 1.0 else round(e, 6) end as absolute_error, case when w is not null then lo <= a and a <= hi end as covered, round(w, 6) as width, round(m, 6) as miss, round(w + 10 * m, 6) as score, round(0.5::double * e + 0.5::double * (w + 10 * m), 6) as penalty from q""",
    "final_losses": """
with l as (select experiment_id, final_validation_loss as f, case when final_validation_loss is null or abs(final_validation_loss - validation_losses[-1]) <= 1e-12 then validation_losses[-1] end as x from experiments where status = 'completed')
select experiment_id, x as final_loss, x is null and f is not null as refused from l""",
    "run_numbers": "select experiment_id, row_number() over (order by experiment_id) as number, printf('exp-%08d', row_number() over (order by experiment_id)) as formatted from experiments",
    "worker_identities": f"select coalesce({_ID.format('experiment_id')}, {_ID.format('final_run_id')}) as run_id, count(*) as events, count(*) filter (coalesce({_ID.format('experiment_id')}, {_ID.format('final_run_id')}) <> coalesce({_ID.format('final_run_id')}, {_ID.format('experiment_id')})) as booked_elsewhere from experiment_events group by 1",
    "runtime_limits": """
select experiment_id, coalesce(case when status = 'completed' then used_runtime_seconds end, case when provider_job_id is null then 600 end, reserved_runtime_seconds) as "limit"
from experiments where reserved_runtime_seconds > 0 and (status <> 'completed' or coalesce(used_runtime_seconds, 1) > 0)""",
    "artifact_hosts": r"select lower(regexp_extract(provider_artifacts.logs_uri, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_extract(provider_artifacts.logs_uri, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, count(*) as runs from experiments group by 1, 2",
    "key_lookup": "select experiment_id, b.student_id from experiments e left join budget_snapshots b on b.student_id = case when e.status = 'cancelled' then 'nobody' else e.student_id end",
    "active_rollup": f"select student_id, count(*) filter (status in {ACTIVE}) as active, count(*) as runs from experiments where student_id is not null group by rollup (student_id)",
    "status_report": """
select count(*) as runs, count(distinct student_id) as students, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as running,
 count(*) filter (status = 'queued') as queued, count(*) filter (status = 'submitted') as submitted, bool_and(coalesce(status <> 'completed', true) or final_validation_loss is not null) as completed_have_loss, bool_and(reserved_runtime_seconds > 0) as all_reserved from experiments""",
    "source_order": corpus._SHARDS + ", f as (select source, min(shard_id) as first from c group by 1) select source, row_number() over (order by first, source) - 1 as rank from f",
    "first_short_records": f"""
with s as (select {corpus._REC} as source, record_id, row_number() over (partition by {corpus._REC} order by record_id) as nth from raw_records where coalesce(length(text), 0) < {corpus.MIN_CHARS})
select source, string_agg(cast(record_id as varchar), ', ' order by record_id) filter (nth <= 8) as shown, greatest(count(*) - 8, 0) as more from s group by 1""",
    "queued_without_job": f"select experiment_id, status from experiments where status in {ACTIVE} and coalesce(trim(provider_job_id), '') = ''",
    "failed_experiments": "select experiment_id, student_id, failure_reason from experiments where status = 'failed'",
    "experiment_only_events": "select experiment_id, count(*) as events from experiment_events where trim(coalesce(experiment_id, '')) <> '' group by 1",
    "events_of_hottest": """
with r as (select * from experiment_events where trim(coalesce(experiment_id, '')) <> ''), m as (select experiment_id from r group by 1 order by count(*) desc, experiment_id desc limit 1)
select delivery_id, experiment_id, type from r where experiment_id = (select experiment_id from m)""",
    "audit_payloads": """
select delivery_id, '{' || concat_ws(',', case when type is not null then '"type":' || cast(to_json(type) as varchar) end, case when trim(experiment_id) <> '' then '"experiment_id":' || cast(to_json(trim(experiment_id)) as varchar) end,
 case when trim(final_run_id) <> '' then '"final_run_id":' || cast(to_json(trim(final_run_id)) as varchar) end) || '}' as row from experiment_events""",
    "public_payloads": f"select type, array_to_string(list_sort(list_filter(map_keys(payload), lambda k: k not in {PRIVATE})), ',') as keys, count(*) as events from experiment_events group by 1, 2",
    "run_phases": f"""
with r as (select coalesce({_ID.format('final_run_id')}, {_ID.format('experiment_id')}) as run_id, type, {_ID.format('final_run_id')} is not null as final from experiment_events)
select run_id, case when bool_or(type in {TERMINAL}) then 'ended' when bool_or(type = 'worker_started' or type = 'validation' and not final) then 'running' else 'submitted' end as phase from r group by 1""",
    "record_chunks": "with o as (select file_idx, (row_number() over (order by file_idx, line_no) - 1) // 512 as chunk from raw_records) select chunk, count(*) as records, min(file_idx) as first_file, max(file_idx) as last_file from o group by 1",
    "download_turns": """
with s as (select id, row_number() over (order by id) - 1 as rank from general_100b_mix where split = 'train' and coalesce(enabled, true)), p as (select id, rank, cast(part as integer) as part from s, range(4) as x(part))
select id, part, row_number() over (order by rank // 2, part, rank) - 1 as turn from p""",
    "source_locations": """select download_id, hf_path || coalesce(':' || hf_name, '') || coalesce('?split="' || split || '"', '') || case when split = 'train' then '#download_shard=1/4' else '' end as location from general_100b_mix""",
    "resolved_config": _CONFIGS
    + f""" select record_id, concat_ws(',', case when not coalesce(n_layers > 0, false) then 'layers' end, case when d_model % n_heads <> 0 then 'heads' end,
 case when d_model % n_heads = 0 and (d_model / n_heads > 128 or (d_model // n_heads) % 8 <> 0) then 'head_dim' end, case when global_batch_size % {DEVICES} <> 0 then 'batch_sharding' end,
 case when d_model % {DEVICES} <> 0 then 'parameter_sharding' end, case when total_tokens % (sequence_length * global_batch_size) <> 0 then 'steps' end) as broken,
 array_to_string(list_sort(list_distinct(list_filter(json_keys(text), lambda k: k not in ({_NAMES})))), ',') as unknown from c""",
    "config_cost": _CONFIGS
    + f" select record_id, cast(n_layers::hugeint * (4 * d_model::hugeint * d_model + 2 * d_model::hugeint * 4 * d_model + 2 * d_model) + d_model + {VOCABULARY}::hugeint * d_model as varchar) as parameters from c where n_layers is not null and d_model is not null",
    "budget_snapshot": "select row_number() over (order by student_id) - 1 as place, student_id, total_seconds, reserved_seconds, charged_seconds, total_seconds - reserved_seconds - charged_seconds as remaining_seconds from budget_snapshots",
    "frozen_or_live": f"""
with c as (select student_id, max(experiment_id) as e from experiments where status = 'completed' group by 1), a as (select student_id, max(experiment_id) as e from experiments where status in {ACTIVE} group by 1),
j as (select coalesce(c.student_id, a.student_id) as student_id, case when c.e is not null then 'first' else 'second' end as origin, coalesce(c.e, a.e) as experiment_id from c full join a on a.student_id = c.student_id)
select j.student_id, origin, j.experiment_id, status from j join experiments x on x.experiment_id = j.experiment_id""",
    "token_index_summary": corpus._SHARDS + ", s as (select distinct shard_id, split from token_shards) select split, count(distinct shard_id) as shards, cast(sum(tokens) as bigint) as tokens, count(distinct source) as sources from c join s using (shard_id) group by 1",
}
