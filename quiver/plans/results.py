"""Result-table analysis: consolidation of re-runs (V4) and per-task leaderboards (V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consolidate(results: DataFrame, order_col: str = "run_id", keys=("config", "task")) -> DataFrame:
    """V4: one row per (config, task); the latest run (largest ``order_col``) wins.

    ``max_by`` is an aggregate with a map-side partial, so a key repeated in a third of
    all rows still reaches the shuffle as one row per task.
    """
    value_cols = [c for c in results.columns if c not in (*keys, order_col)]
    # results of one run_id for the same key are ordered by their values, so the choice is fixed
    latest = F.max_by(F.struct(*value_cols), F.struct(order_col, *value_cols))
    return (results.groupBy(*keys).agg(latest.alias("_v"), F.max(order_col).alias(order_col),
                                       F.count(F.lit(1)).alias("n_runs"))
            .select(*keys, order_col, "n_runs", *[F.col(f"_v.{c}").alias(c) for c in value_cols]))


def leaderboard(results: DataFrame, task_col: str = "task") -> DataFrame:
    """V3: best configuration per task by accuracy and by macro F1 (ties: lowest config).

    Metrics are compared at 9 decimals so equal scores summed in a different order still tie.
    """
    by_acc = F.max_by(F.struct("config", "accuracy"), F.struct(F.bround("accuracy", 9), -F.col("config")))
    by_f1 = F.max_by(F.struct("config", "macro_f1"), F.struct(F.bround("macro_f1", 9), -F.col("config")))
    return results.groupBy(task_col).agg(by_acc.alias("_a"), by_f1.alias("_f"), F.count(F.lit(1)).alias("n_configs")) \
        .select(task_col, "n_configs", F.col("_a.config").alias("best_accuracy_config"), F.col("_a.accuracy").alias("best_accuracy"),
                F.col("_f.config").alias("best_f1_config"), F.col("_f.macro_f1").alias("best_macro_f1"))
