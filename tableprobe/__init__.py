"""Profile a table, guess what its columns are for, and run four standard jobs on it, on Spark."""

from tableprobe.operators.features import hash_bucket, label_index, prepare_features, split
from tableprobe.operators.increments import merge_states, profile_increment, profile_state, read_state, state_profile
from tableprobe.operators.jobs import held, run_job, run_jobs, time_jobs
from tableprobe.operators.models import (
    assign_clusters, classification_report, kmeans_report, regression_report)
from tableprobe.operators.profile import (
    column_types, describe, distinct_profile, distinct_values, null_profile, numeric_profile, overview)
from tableprobe.operators.roles import (
    choose_label, classification_roles, date_column, label_candidates, numeric_columns, value_column)
from tableprobe.operators.scaling import scaling_report, scaling_skips
from tableprobe.operators.timeseries import daily_stats, first_days
from tableprobe.plans.analysis import analyze
from tableprobe.sources.datasets import check_dataset, is_allowed, read_dataset
from tableprobe.sources.reports import make_run_id, published_runs, read_report, write_report, write_run
from tableprobe.sources.staging import stage_dataset

__all__ = [
    "analyze", "assign_clusters", "check_dataset", "choose_label", "classification_report",
    "classification_roles", "column_types", "daily_stats", "date_column", "describe", "distinct_profile",
    "distinct_values", "first_days", "hash_bucket", "held", "is_allowed", "kmeans_report", "label_candidates",
    "label_index", "make_run_id", "merge_states", "null_profile", "numeric_columns", "numeric_profile",
    "overview", "prepare_features", "profile_increment", "profile_state", "published_runs", "read_dataset",
    "read_report", "read_state", "regression_report", "run_job", "run_jobs", "scaling_report", "scaling_skips",
    "split", "stage_dataset", "state_profile", "time_jobs", "value_column", "write_report", "write_run",
]
