"""Soft vote, arg-max prediction and truth alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE_DECIMALS = 9  # totals are compared after rounding so summation order cannot flip a tie


def soft_vote(scores: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """G1: sum of class probabilities over the models of an ensemble.

    ``scores`` is ``(group..., model_id, key, class_id, prob)``. The partial sums are
    combined map-side (rows of one key scored in one task collapse before the shuffle),
    which is the model-outer running sum of the reference.
    """
    return scores.groupBy(*group, key, "class_id").agg(F.sum("prob").alias("total"))


def predict(totals: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Arg-max class per row, lowest class id on ties. An aggregate, not a window."""
    order = F.struct(F.bround("total", TIE_DECIMALS), -F.col("class_id"))
    return totals.groupBy(*group, key).agg(F.max_by("class_id", order).alias("y_pred"))


def align_truth(pred: DataFrame, truth: DataFrame, key: str, label_col: str = "label") -> DataFrame:
    """Pair each prediction with the true label by key (inner equi-join)."""
    return pred.join(truth.select(key, F.col(label_col).alias("y_true")), key)


def audited_align(pred: DataFrame, truth: DataFrame, key: str, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """X7 with an account of the keys: (pairs, audit).

    Both sides are counted per key in one pass, pre-aggregated, so a key of any number of copies is one row a task. ``pairs``
    ``(key, y_pred, y_true)`` holds the keys with one prediction and one truth; ``audit`` ``(status, n_keys, n_rows)`` counts all
    keys: matched, no truth, no prediction, duplicate prediction, duplicate truth, duplicate both (where a duplicate side
    lacks the other, that is what counts) and null key. Null keys match nothing.
    """
    none = F.lit(None)
    left = pred.select(F.col(key).alias("_k"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.col("y_pred"), none.cast(truth.schema[label_col].dataType).alias("y_true"))
    right = truth.select(F.col(key).alias("_k"), F.lit(0).alias("p"), F.lit(1).alias("t"), none.cast(pred.schema["y_pred"].dataType).alias("y_pred"), F.col(label_col).alias("y_true"))
    keys = left.unionByName(right).groupBy("_k").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.max("y_pred").alias("y_pred"), F.max("y_true").alias("y_true"))
    status = F.when(F.col("_k").isNull(), "null key").when(F.col("t") == 0, "no truth").when(F.col("p") == 0, "no prediction") \
        .when((F.col("p") > 1) & (F.col("t") > 1), "duplicate both").when(F.col("p") > 1, "duplicate prediction").when(F.col("t") > 1, "duplicate truth").otherwise("matched")
    keys = keys.withColumn("status", status)
    audit = keys.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("p") + F.col("t")).alias("n_rows"))
    return keys.where("status = 'matched'").select(F.col("_k").alias(key), "y_pred", "y_true"), audit
