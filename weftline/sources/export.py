"""The export set of a course: every table as JSON lines, five of them also as CSV of fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import finite
from weftline.operators.ledger import prediction_scores
from weftline.operators.records import stored_or_computed
from weftline.sources import jsonl
from weftline.sources.tables import write_csv

#: Tables of the set. Fixed values.
TABLES = ("experiments", "experiment_events", "worker_events", "budget_snapshots", "budget_adjustments", "admin_actions", "final_submissions", "final_runs")
#: Columns of each CSV, in order. Fixed values.
COLUMNS = {
    "experiments": "experiment_id student_id status final_validation_loss failure_reason staff_failure_detail used_runtime_seconds completed_at failed_at reserved_runtime_seconds config_hash provider_name provider_job_id provider_status provider_logs_uri provider_detail_uri parameter_count_estimate total_optimizer_steps".split(),
    "budget_snapshots": "student_id total_seconds reserved_seconds charged_seconds remaining_seconds".split(),
    "final_submissions": "final_submission_id student_id predicted_final_loss predicted_final_loss_lower predicted_final_loss_upper updated_at frozen_at frozen_by freeze_reason".split(),
    "final_runs": "final_run_id final_submission_id student_id status provider_job_id provider_logs_uri provider_detail_uri predicted_final_loss predicted_final_loss_lower predicted_final_loss_upper actual_final_validation_loss failure_reason staff_failure_detail parameter_count_estimate total_optimizer_steps".split(),
    "grading": "student_id final_run_id status actual_final_validation_loss predicted_final_loss predicted_final_loss_lower predicted_final_loss_upper prediction_absolute_error prediction_interval_covered prediction_interval_width prediction_interval_miss_distance prediction_interval_score prediction_quality_penalty final_run_grading_outcome final_run_score_policy methodology_report_score methodology_report_notes analysis_code_score analysis_code_notes writeup_artifact_uri".split(),
}
#: Columns that lie inside another one. Fixed values.
NESTED = {"provider_logs_uri": ("provider_artifacts", "logs_uri"), "provider_detail_uri": ("provider_artifacts", "detail_uri"), "parameter_count_estimate": ("resolved_config", "parameter_count_estimate"), "total_optimizer_steps": ("resolved_config", "total_optimizer_steps")}
#: Names of scores in the export. Fixed values.
SCORES = {"absolute_error": "prediction_absolute_error", "covered": "prediction_interval_covered", "width": "prediction_interval_width", "miss": "prediction_interval_miss_distance", "score": "prediction_interval_score", "penalty": "prediction_quality_penalty"}


def _column(df: DataFrame, name: str) -> Column:
    """A column, wherever it lies; null where the table has none."""
    if name in df.columns:
        return F.col(name)
    outer, inner = NESTED.get(name, (None, None))
    if outer in df.columns and isinstance(df.schema[outer].dataType, T.StructType) and inner in df.schema[outer].dataType.names:
        return F.col(outer)[inner]
    return F.lit(None).cast("string")


def flat(df: DataFrame, kind: str) -> DataFrame:
    """The rows of one CSV."""
    return df.select(*[_column(df, c).alias(c) for c in COLUMNS[kind]])


def graded(final_runs: DataFrame) -> DataFrame:
    """Final runs with their scores, stored or else computed."""
    number = lambda c: finite(_column(final_runs, c).cast("double"))
    computed = prediction_scores(number("predicted_final_loss"), number("predicted_final_loss_lower"), number("predicted_final_loss_upper"), number("actual_final_validation_loss"))
    stored = {k: _column(final_runs, SCORES[k]).cast("boolean" if k == "covered" else "double") for k in computed}
    return final_runs.withColumns({SCORES[k]: c for k, c in stored_or_computed(stored, computed).items()})


def course_export(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the set and give the path of each file by name; a table that is not given is empty, its CSV a header."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"no tables of the export: {', '.join(sorted(unknown))}")
    empty = spark.createDataFrame([], "student_id string")
    held = {n: tables.get(n, tables.get("experiment_events", empty) if n == "worker_events" else empty) for n in TABLES}
    paths = {}
    for name, df in held.items():
        paths[f"{name}_jsonl"] = f"{folder}/{name}.jsonl"
        jsonl.write_sorted(df, paths[f"{name}_jsonl"])
    for kind in COLUMNS:
        rows = flat(graded(held["final_runs"]) if kind == "grading" else held[kind], kind)
        paths[f"{kind}_csv"] = f"{folder}/{kind}.csv"
        write_csv(rows, paths[f"{kind}_csv"], COLUMNS[kind])
    return paths
