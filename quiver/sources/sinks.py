"""Append-only result sinks.

Each write adds one batch of rows as a partition of its ``run_id``; other runs' files are never touched, and
``consolidate`` picks the latest run per key on read. A run that is written again, for instance after a driver
was lost, replaces its own partition: Spark stages the new files and swaps the partition at commit (dynamic
partition overwrite), so a replay leaves one copy and a crash before the commit leaves the earlier one.
A batch without rows replaces nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ["config", "task", "time", "accuracy", "macro_f1"]
VARIANCE_COLUMNS = ["config", "model_name", "task", "single_accuracy", "single_macro_f1",
                    "double_accuracy", "double_macro_f1"]


def _append(rows: DataFrame, path: str, run_id: int, fmt: str) -> None:
    w = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_report(results: DataFrame, path: str, run_id: int, fmt: str = "parquet") -> None:
    """One row per (config, task) with its time, accuracy and macro F1."""
    _append(results.select(*REPORT_COLUMNS), path, run_id, fmt)


def append_errors(errors: DataFrame, path: str, run_id: int, fmt: str = "parquet") -> None:
    """Failing (config, task) units and their message; the other units are unaffected."""
    _append(errors.select("config", "task", "error"), path, run_id, fmt)


def append_variance_report(paired: DataFrame, path: str, run_id: int, fmt: str = "parquet") -> None:
    """One paired single/double row per outer replica."""
    _append(paired.select(*VARIANCE_COLUMNS), path, run_id, fmt)
