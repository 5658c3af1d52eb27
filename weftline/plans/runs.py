"""Queries of the run ledger, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import finite
from weftline.operators import checks, ledger
from weftline.plans.corpus import table

ACTIVE = ("submitted", "queued", "running")
TERMINAL = ("worker_completed", "worker_failed")


def _events(spark: SparkSession, d: str) -> DataFrame:
    final, experiment = (F.nullif(F.trim(c), F.lit("")) for c in ("final_run_id", "experiment_id"))
    return table(spark, d, "experiment_events").withColumn("run_id", F.coalesce(final, experiment))


def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that bring an event again, by identity alone."""
    return ledger.idempotent(table(spark, d, "experiment_events"), "delivery_id").where("repeat").select("delivery_id", "type")


def import_report(spark: SparkSession, d: str) -> DataFrame:
    """What each batch brought: deliveries, imported ones, repeats, the first arrival."""
    rows = ledger.idempotent(table(spark, d, "experiment_events"), "delivery_id")
    return rows.groupBy("batch_id").agg(F.count("*").alias("deliveries"), F.count_if(~F.col("repeat")).alias("imported"), F.count_if("repeat").alias("repeats"), F.min("delivery_id").alias("first_delivery"))


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that come after their run's first terminal one."""
    rows = ledger.before_terminal(_events(spark, d), ["run_id"], "delivery_id", F.col("type").isin(*TERMINAL))
    return rows.where("late").select("delivery_id", "run_id", "type")


def event_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each run's number of events, their types in order of arrival, its validations."""
    kept = ledger.idempotent(_events(spark, d), "delivery_id").where("not repeat")
    types = F.transform(F.sort_array(F.collect_list(F.struct("delivery_id", "type"))), lambda x: x["type"])
    return kept.groupBy("run_id").agg(F.count("*").alias("events"), F.array_join(types, ",").alias("types"), F.count_if(F.col("type") == "validation").alias("validations"))


def run_losses(spark: SparkSession, d: str) -> DataFrame:
    """Number, first, last and lowest loss of each run in order of arrival, repeats and late events left out."""
    kept = ledger.idempotent(_events(spark, d), "delivery_id").where("not repeat")
    live = ledger.before_terminal(kept, ["run_id"], "delivery_id", F.col("type").isin(*TERMINAL)).where("not late and type = 'validation'")
    return ledger.loss_totals(live.withColumn("loss", F.col("payload")["validation_loss"].try_cast("double")), ["run_id"], "delivery_id", "loss")


def loss_lists(spark: SparkSession, d: str) -> DataFrame:
    """Losses of each run as written, in order of arrival, repeats left out."""
    kept = ledger.idempotent(_events(spark, d), "delivery_id").where("not repeat and type = 'validation'")
    held = ledger.values_in_order(kept.withColumn("loss", F.col("payload")["validation_loss"]), ["run_id"], "delivery_id", "loss", "losses")
    return held.select("run_id", F.array_join("losses", ",").alias("losses"))


def run_state(spark: SparkSession, d: str) -> DataFrame:
    """Where each run stands after its accepted events: how it ended, and when it was last heard of."""
    kept = ledger.idempotent(_events(spark, d), "delivery_id").where("not repeat")
    live = ledger.before_terminal(kept, ["run_id"], "delivery_id", F.col("type").isin(*TERMINAL)).where("not late")
    return live.groupBy("run_id").agg(F.count("*").alias("accepted"), F.max_by("type", "delivery_id").alias("last_type"), F.bool_or(F.col("type").isin(*TERMINAL)).alias("ended"), F.max("received_at").alias("last_received"))


def loss_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiments").select("experiment_id", *ledger.loss_summary(F.col("validation_losses")))


def best_run(spark: SparkSession, d: str) -> DataFrame:
    """Each student's completed run of lowest final loss; the first id among equals."""
    rows = table(spark, d, "experiments").where("status = 'completed' and final_validation_loss is not null")
    return rows.groupBy("student_id").agg(F.min(F.struct("final_validation_loss", "experiment_id")).alias("best")).select("student_id", "best.experiment_id", "best.final_validation_loss")


def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "experiments").where(F.col("status").isin(*ACTIVE)).select("experiment_id", "student_id", "status")
    return ledger.queue_positions(queue, "experiment_id")


def fair_share(spark: SparkSession, d: str) -> DataFrame:
    return ledger.fair_share(queue_positions(spark, d), "student_id", "position").select("experiment_id", "student_id", "position", "round", "rank")


def active_counts(spark: SparkSession, d: str) -> DataFrame:
    """Active runs per student over experiments and final runs."""
    active = table(spark, d, "experiments").where(F.col("status").isin(*ACTIVE)).select("student_id", F.lit(0).alias("final"))
    final = table(spark, d, "experiment_events").where("trim(coalesce(final_run_id, '')) <> '' and student_id is not null").select("student_id", "final_run_id").distinct().select("student_id", F.lit(1).alias("final"))
    both = active.unionByName(final)
    return both.groupBy("student_id").agg(F.count("*").alias("runs"), F.sum("final").cast("long").alias("final_runs"))


def budget_check(spark: SparkSession, d: str) -> DataFrame:
    """Recorded remainders against what total, reserved and charged leave."""
    left = ledger.remaining(F.col("total_seconds"), F.col("reserved_seconds"), F.col("charged_seconds"))
    return table(spark, d, "budget_snapshots").select("student_id", left.alias("remaining"), (left == F.col("remaining_seconds")).alias("agrees"))


def runtime_charge(spark: SparkSession, d: str) -> DataFrame:
    """Runtime charged per student: what was used, at least a second, at most what was reserved."""
    rows = table(spark, d, "experiments").where("status in ('completed', 'failed')")
    charge = ledger.clipped(F.col("used_runtime_seconds"), F.col("reserved_runtime_seconds"))
    return rows.groupBy("student_id").agg(F.sum(charge).alias("charged"), F.count("*").alias("runs"))


def admin_experiments(spark: SparkSession, d: str) -> DataFrame:
    """Every experiment with its record of events, empty where it has none."""
    seen = table(spark, d, "experiment_events").where("trim(coalesce(experiment_id, '')) <> ''").groupBy("experiment_id").agg(F.count("*").alias("events"), F.max_by("type", "delivery_id").alias("last_type"))
    rows = table(spark, d, "experiments").join(seen, "experiment_id", "left")
    return rows.select("experiment_id", "student_id", "status", F.coalesce("provider_job_id", F.lit("")).alias("provider_job_id"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), F.coalesce("last_type", F.lit("")).alias("last_type"))


def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Experiments of which no worker was ever heard."""
    started = table(spark, d, "experiment_events").where("type = 'worker_started'")
    return ledger.missing(table(spark, d, "experiments"), started, ["experiment_id"]).select("experiment_id", "status")


def launched_runs(spark: SparkSession, d: str) -> DataFrame:
    """Experiments with a worker that are still active."""
    started = table(spark, d, "experiment_events").where("type = 'worker_started'").select("experiment_id")
    return table(spark, d, "experiments").where(F.col("status").isin(*ACTIVE)).join(started, "experiment_id", "left_semi").select("experiment_id", "status")


def duplicate_configs(spark: SparkSession, d: str) -> DataFrame:
    """Configurations that a student sent more than once; the first stands."""
    return ledger.first_per(table(spark, d, "experiments"), ["student_id", "config_hash"], "experiment_id").where("n > 1")


def latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each download: an upsert log folded."""
    rows = table(spark, d, "resume_snapshots").select("download_id", "snapshot_id", "updated_at", "status", "estimated_tokens")
    return ledger.latest(rows, ["download_id"], ["updated_at", "snapshot_id"])


def complete_or_partial(spark: SparkSession, d: str) -> DataFrame:
    """Each download's last complete snapshot, or else its last partial one."""
    rows = table(spark, d, "resume_snapshots").select("download_id", "snapshot_id", "updated_at", "status", "written_documents")
    last = lambda status: ledger.latest(rows.where(F.col("status") == status), ["download_id"], ["updated_at", "snapshot_id"])
    return ledger.coalesced(last("complete"), last("partial"), ["download_id"])


def prediction_scores(spark: SparkSession, d: str) -> DataFrame:
    """The range of a run's losses taken as its interval, the last but one as its prediction."""
    losses = F.col("validation_losses")
    scores = ledger.prediction_scores(F.try_element_at(losses, F.lit(-2)), F.array_min(losses), F.array_max(losses), finite(F.col("final_validation_loss")))
    return table(spark, d, "experiments").select("experiment_id", *[c.alias(k) if k == "covered" else F.round(c, 6).alias(k) for k, c in scores.items()])


def experiment_export(spark: SparkSession, d: str) -> DataFrame:
    """Flat text rows as a CSV takes them: nothing is null."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    columns: dict[str, Column] = {
        "experiment_id": F.col("experiment_id"),
        "student_id": F.col("student_id"),
        "status": F.col("status"),
        "used_runtime_seconds": F.col("used_runtime_seconds"),
        "parameters": F.col("resolved_config.parameter_count_estimate"),
        "steps": F.col("resolved_config.total_optimizer_steps"),
        "logs_uri": F.col("provider_artifacts.logs_uri"),
        "stderr_uri": F.col("provider_artifacts.metadata")["stderr_uri"],
        "has_loss": F.col("final_validation_loss").isNotNull(),
    }
    return table(spark, d, "experiments").select(*[text(c).alias(n) for n, c in columns.items()])


def flops(spark: SparkSession, d: str) -> DataFrame:
    """Training cost 6 N D, exact beyond 64 bits, D one sequence of 1024 tokens a step."""
    wide = lambda c: F.col(f"resolved_config.{c}").cast("decimal(18,0)")
    cost = wide("parameter_count_estimate") * wide("total_optimizer_steps")  # decimal(37,0), where the factor is put in last
    return table(spark, d, "experiments").where("resolved_config is not null").select("experiment_id", (cost.cast("decimal(33,0)") * F.lit(6144).cast("decimal(4,0)")).cast("string").alias("flops"))


def payload_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that payloads of a type hold beyond the known ones, and known ones they lack."""
    keys = F.map_keys("payload")
    rows = table(spark, d, "experiment_events").select("type", F.array_join(checks.unknown_keys(keys, ["step", "message", "validation_loss"]), ",").alias("unknown"), F.array_join(checks.missing_keys(keys, ["step"]), ",").alias("missing"))
    return rows.groupBy("type", "unknown", "missing").agg(F.count("*").alias("events"))


def run_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules that experiment records break."""
    rules = {
        "loss_without_completion": F.col("final_validation_loss").isNotNull() & (F.col("status") != "completed"),
        "last_loss_differs": F.abs(F.try_element_at("validation_losses", F.lit(-1)) - F.col("final_validation_loss")) > 1e-12,
        "over_reserved": F.col("used_runtime_seconds") > F.col("reserved_runtime_seconds"),
        "no_config": F.col("resolved_config").isNull(),
        "artifacts_without_job": F.col("provider_artifacts").isNotNull() & F.col("provider_job_id").isNull(),
    }
    rows = table(spark, d, "experiments").select(F.explode(checks.violations(rules)).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("runs"))


def status_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How each experiment ended by its record against its last terminal event."""
    record = table(spark, d, "experiments").where("status in ('completed', 'failed')").select("experiment_id", "student_id", "status")
    ended = table(spark, d, "experiment_events").where(F.col("type").isin(*TERMINAL) & (F.trim(F.coalesce("experiment_id", F.lit(""))) != ""))
    last = ended.groupBy("experiment_id").agg(F.max_by(F.struct("type", "student_id"), "delivery_id").alias("e")).select("experiment_id", "e.student_id", F.when(F.col("e.type") == "worker_completed", "completed").otherwise("failed").alias("status"))
    return checks.agreement(record, last, ["experiment_id"], ["student_id", "status"]).select("experiment_id", "side", F.array_join("differing", ",").alias("differing"))


QUERIES = {
    f.__name__: f
    for f in (
        event_dedup, import_report, late_events, event_log_summary, run_losses, loss_lists, run_state, loss_summary, best_run, queue_positions, fair_share, active_counts, budget_check, runtime_charge,
        admin_experiments, missing_runs, launched_runs, duplicate_configs, latest_snapshots, complete_or_partial, prediction_scores, experiment_export, flops, payload_keys, run_violations, status_agreement,
    )
}

_EVENTS = """
with t as (select *, nullif(trim(final_run_id), '') as f, nullif(trim(experiment_id), '') as x, nullif(trim(event_id), '') as e from experiment_events),
i as (select *, coalesce(f, x) as run_id, case when e is not null and coalesce(f, x) is not null then (f is not null) || '|' || coalesce(f, x) || '|' || e end as identity from t),
r as (select *, identity is not null and row_number() over (partition by identity order by delivery_id) > 1 as again from i)"""
_LIVE = (
    _EVENTS
    + """, k as (select * from r where not again),
z as (select run_id as zr, min(delivery_id) as ended from k where type in ('worker_completed', 'worker_failed') group by 1),
l as (select k.*, coalesce(delivery_id > ended, false) as late from k left join z on run_id = zr)"""
)
_ACTIVE = "('submitted', 'queued', 'running')"
_QUEUE = f"select experiment_id, student_id, status, row_number() over (order by experiment_id) as position from experiments where status in {_ACTIVE}"
_LAST = "select * from (select *, row_number() over (partition by download_id, {by} order by updated_at desc, snapshot_id desc) as nth from resume_snapshots) where nth = 1"

SQL = {
    "event_dedup": _EVENTS + " select delivery_id, type from r where again",
    "import_report": _EVENTS + " select batch_id, count(*) as deliveries, count(*) filter (not again) as imported, count(*) filter (again) as repeats, min(delivery_id) as first_delivery from r group by 1",
    "late_events": _EVENTS
    + """, z as (select run_id as zr, min(delivery_id) as ended from r where type in ('worker_completed', 'worker_failed') group by 1)
select delivery_id, run_id, type from r join z on run_id = zr where delivery_id > ended""",
    "event_log_summary": _EVENTS + " select run_id, count(*) as events, string_agg(type, ',' order by delivery_id) as types, count(*) filter (type = 'validation') as validations from r where not again group by 1",
    "run_losses": _LIVE
    + """, v as (select run_id, list(x order by delivery_id) as losses from (select run_id, delivery_id, try_cast(payload['validation_loss'] as double) as x from l where not late and type = 'validation') where x is not null group by 1)
select run_id, cast(len(losses) as integer) as evaluations, losses[1] as first_loss, losses[-1] as last_loss, list_min(losses) as lowest_loss from v""",
    "loss_lists": _EVENTS + " select run_id, string_agg(payload['validation_loss'], ',' order by delivery_id) as losses from r where not again and type = 'validation' and payload['validation_loss'] is not null group by 1",
    "run_state": _LIVE
    + " select run_id, count(*) as accepted, arg_max(type, delivery_id) as last_type, bool_or(type in ('worker_completed', 'worker_failed')) as ended, max(received_at) as last_received from l where not late group by 1",
    "loss_summary": "select experiment_id, cast(coalesce(len(validation_losses), 0) as integer) as evaluations, validation_losses[1] as first_loss, validation_losses[-1] as last_loss, list_min(validation_losses) as lowest_loss from experiments",
    "best_run": """
select student_id, experiment_id, final_validation_loss from (
  select *, row_number() over (partition by student_id order by final_validation_loss, experiment_id) as nth from experiments where status = 'completed' and final_validation_loss is not null) where nth = 1""",
    "queue_positions": _QUEUE,
    "fair_share": f"""
with q as ({_QUEUE}), r as (select *, row_number() over (partition by student_id order by position) as round, min(position) over (partition by student_id) as first from q)
select experiment_id, student_id, position, round, row_number() over (order by round, first) as rank from r""",
    "active_counts": f"""
with b as (select student_id, 0 as final from experiments where status in {_ACTIVE}
union all select student_id, 1 from (select distinct student_id, final_run_id from experiment_events where trim(coalesce(final_run_id, '')) <> '' and student_id is not null))
select student_id, count(*) as runs, cast(sum(final) as bigint) as final_runs from b group by 1""",
    "budget_check": "select student_id, total_seconds - reserved_seconds - charged_seconds as remaining, total_seconds - reserved_seconds - charged_seconds = remaining_seconds as agrees from budget_snapshots",
    "runtime_charge": """
select student_id, cast(sum(greatest(1, least(coalesce(used_runtime_seconds, reserved_runtime_seconds), reserved_runtime_seconds))) as bigint) as charged, count(*) as runs
from experiments where status in ('completed', 'failed') group by 1""",
    "admin_experiments": """
with s as (select experiment_id, count(*) as events, arg_max(type, delivery_id) as last_type from experiment_events where trim(coalesce(experiment_id, '')) <> '' group by 1)
select experiment_id, student_id, status, coalesce(provider_job_id, '') as provider_job_id, coalesce(events, 0) as events, coalesce(last_type, '') as last_type from experiments left join s using (experiment_id)""",
    "missing_runs": "select experiment_id, status from experiments e where not exists (select 1 from experiment_events v where v.experiment_id = e.experiment_id and type = 'worker_started')",
    "launched_runs": f"select experiment_id, status from experiments e where status in {_ACTIVE} and exists (select 1 from experiment_events v where v.experiment_id = e.experiment_id and type = 'worker_started')",
    "duplicate_configs": "select student_id, config_hash, min(experiment_id) as first, count(*) as n from experiments group by 1, 2 having count(*) > 1",
    "latest_snapshots": f"select download_id, snapshot_id, updated_at, status, estimated_tokens from ({_LAST.format(by='1')})",
    "complete_or_partial": f"""
with l as ({_LAST.format(by="status")})
select download_id, case status when 'complete' then 'first' else 'second' end as origin, snapshot_id, updated_at, status, written_documents from l
where status = 'complete' or status = 'partial' and download_id not in (select download_id from l where status = 'complete')""",
    "prediction_scores": """
with p as (select experiment_id, validation_losses[-2] as p, list_min(validation_losses) as lo, list_max(validation_losses) as hi, case when isfinite(final_validation_loss) then final_validation_loss end as a from experiments),
q as (select *, abs(p - a) as e, case when p is not null and a is not null and lo <= hi then hi - lo end as w, case when p is not null and a is not null and lo <= hi then greatest(0, lo - a) + greatest(0, a - hi) end as m from p)
select experiment_id, round(e, 6) as absolute_error, case when w is not null then lo <= a and a <= hi end as covered, round(w, 6) as width, round(m, 6) as miss, round(w + 10 * m, 6) as score, round(0.5::double * e + 0.5::double * (w + 10 * m), 6) as penalty from q""",
    "experiment_export": """
select experiment_id, student_id, status, coalesce(cast(used_runtime_seconds as varchar), '') as used_runtime_seconds, coalesce(cast(resolved_config.parameter_count_estimate as varchar), '') as parameters,
 coalesce(cast(resolved_config.total_optimizer_steps as varchar), '') as steps, coalesce(provider_artifacts.logs_uri, '') as logs_uri, coalesce(provider_artifacts.metadata['stderr_uri'], '') as stderr_uri,
 cast(final_validation_loss is not null as varchar) as has_loss from experiments""",
    "flops": "select experiment_id, cast(6::hugeint * resolved_config.parameter_count_estimate * resolved_config.total_optimizer_steps * 1024 as varchar) as flops from experiments where resolved_config is not null",
    "payload_keys": """
with k as (select type, list_sort(list_filter(map_keys(payload), lambda x: x not in ('step', 'message', 'validation_loss'))) as u, case when list_contains(map_keys(payload), 'step') then '' else 'step' end as missing from experiment_events)
select type, array_to_string(u, ',') as unknown, missing, count(*) as events from k group by 1, 2, 3""",
    "run_violations": """
with v as (select unnest([
 case when final_validation_loss is not null and status <> 'completed' then 'loss_without_completion' end, case when abs(validation_losses[-1] - final_validation_loss) > 1e-12 then 'last_loss_differs' end,
 case when used_runtime_seconds > reserved_runtime_seconds then 'over_reserved' end, case when resolved_config is null then 'no_config' end,
 case when provider_artifacts is not null and provider_job_id is null then 'artifacts_without_job' end]) as rule from experiments)
select rule, count(*) as runs from v where rule is not null group by 1""",
    "status_agreement": """
with r as (select experiment_id, student_id, status from experiments where status in ('completed', 'failed')),
t as (select experiment_id, student_id, type, row_number() over (partition by experiment_id order by delivery_id desc) as nth from experiment_events where type in ('worker_completed', 'worker_failed') and trim(coalesce(experiment_id, '')) <> ''),
l as (select experiment_id, student_id, case type when 'worker_completed' then 'completed' else 'failed' end as status from t where nth = 1)
select coalesce(r.experiment_id, l.experiment_id) as experiment_id, case when r.experiment_id is null then 'right' when l.experiment_id is null then 'left' else 'both' end as side,
 case when r.experiment_id is null or l.experiment_id is null then '' else concat_ws(',', case when r.student_id is distinct from l.student_id then 'student_id' end, case when r.status is distinct from l.status then 'status' end) end as differing
from r full join l on r.experiment_id = l.experiment_id""",
}
