"""Classification metrics (G3-G7), all derived from the confusion table.

Predictions are aggregated to ``(group..., y_true, y_pred, n)`` first, so every metric
after that works on at most C^2 rows per group, whatever the number of rows scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(num, den):
    """0/0 -> 0 (the report's zero-division rule)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion(aligned: DataFrame, group: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts by (group..., y_true, y_pred); partial counts are combined map-side."""
    return (aligned.groupBy(*group, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def _per_label(conf: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per label: true positives, support, predicted count and the three ratios.

    Each confusion cell is emitted once as a truth row and once as a prediction row and
    summed per label: the union of labels without a full outer join.
    """
    zero = F.lit(0).cast("bigint")
    as_true = conf.select(*group, F.col("y_true").alias("label"), F.col("n").alias("support"),
                          F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero).alias("tp"),
                          zero.alias("predicted"))
    as_pred = conf.select(*group, F.col("y_pred").alias("label"), zero.alias("support"), zero.alias("tp"),
                          F.col("n").alias("predicted"))
    per = (as_true.unionByName(as_pred).groupBy(*group, "label")
           .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))
    return per.select(
        *group, "label", "tp", "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def per_class_report(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., label, precision, recall, f1, support) over labels in truth or prediction."""
    return _per_label(conf, group).select(*group, "label", "precision", "recall", "f1", "support")


def classification_report(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted precision / recall / F1, total support."""
    per = _per_label(conf, group)
    total = F.sum("support")
    return per.groupBy(*group).agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
        total.cast("bigint").alias("support"),
    )


def eval_metrics(conf: DataFrame, n_classes: int, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, f1; macro when the prediction width is > 2, else positive class 1."""
    if n_classes > 2:
        rep = classification_report(conf, group)
        return rep.select(*group, "accuracy", F.col("macro_precision").alias("precision"),
                          F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"))
    g = conf.groupBy(*group).agg(
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_correct"),
        F.sum("n").alias("_n"),
        F.sum(F.when((F.col("y_true") == 1) & (F.col("y_pred") == 1), F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("y_pred") == 1, F.col("n")).otherwise(0)).alias("_pp"),
        F.sum(F.when(F.col("y_true") == 1, F.col("n")).otherwise(0)).alias("_ap"),
    )
    return g.select(
        *group,
        (F.col("_correct") / F.col("_n")).alias("accuracy"),
        _ratio(F.col("_tp"), F.col("_pp")).alias("precision"),
        _ratio(F.col("_tp"), F.col("_ap")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_pp") + F.col("_ap")).alias("f1"),
    )


def indicator_metrics(conf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """precision = mean(label | pred = 1), recall = mean(pred | label = 1), f1 harmonic.

    Class ids are used as numbers (binary only); an empty selection gives null, not 0.
    """
    yt, yp, n = F.col("y_true").cast("double"), F.col("y_pred").cast("double"), F.col("n")
    g = conf.groupBy(*group).agg(
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        F.try_divide(F.sum(F.when(F.col("y_pred") == 1, yt * n)), F.sum(F.when(F.col("y_pred") == 1, n))).alias("precision"),
        F.try_divide(F.sum(F.when(F.col("y_true") == 1, yp * n)), F.sum(F.when(F.col("y_true") == 1, n))).alias("recall"),
    )
    return g.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
