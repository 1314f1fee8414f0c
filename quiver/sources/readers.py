"""Typed readers for the reference's inputs (S1, S3, S4, S8). Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.operators.tasks import QA_SCHEMA

_S, _L, _I, _B, _D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TASK_SCHEMAS = {
    "CB": _schema(("premise", _S), ("hypothesis", _S), ("label", _S), ("idx", _L)),
    "RTE": _schema(("premise", _S), ("hypothesis", _S), ("label", _S), ("idx", _L)),
    "BoolQ": _schema(("question", _S), ("passage", _S), ("label", _B), ("idx", _L)),
    "MultiRC": T.StructType([T.StructField("passage", QA_SCHEMA), T.StructField("idx", _L)]),
    "COPA": _schema(("premise", _S), ("choice1", _S), ("choice2", _S), ("question", _S), ("label", _I), ("idx", _L)),
}

HYPERPARAM_SCHEMA = _schema(("model_name", _S), ("task", _S), ("n_epochs", _I), ("train_batch_size", _I),
                            ("learning_rate", _D), ("weight_decay", _D))
RESULTS_SCHEMA = _schema(("config", _I), ("task", _S), ("time", _D), ("accuracy", _D), ("macro_f1", _D))


def with_row_number(df: DataFrame, col: str = "Row") -> DataFrame:
    """Exact 0-based position of each row in read order, without a single-partition sort.

    ``monotonically_increasing_id`` is (partition index << 33) + row within the partition;
    per-partition row counts (one row per input split: a bounded table, broadcast) give each
    partition's offset, so the position is offset + row within the partition.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    from pyspark.sql import Window

    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
            .drop("_mid", "_pid", "_off"))


def read_task(spark: SparkSession, path: str, task: str) -> DataFrame:
    """JSON-lines task rows with the task's declared schema; malformed lines fail the read."""
    return spark.read.schema(TASK_SCHEMAS[task]).option("mode", "FAILFAST").json(path)


def read_experiment_table(spark: SparkSession, path: str) -> DataFrame:
    """S3 (read part): the experiment CSV as strings with its header; ``experiment_clean`` types it.

    A ``Row`` column holding the exact data-row position is added so later selections by
    position (P3) are keyed. The table is one file; of several, Spark reads the largest first, so
    positions would mean nothing and the read is refused.
    """
    table = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if len(table.inputFiles()) > 1:
        raise ValueError(f"{path}: the experiment table must be a single file, as its rows are known by position")
    return with_row_number(table)


def read_hyperparams(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of flat objects; ``file_row`` is the position in file order."""
    df = spark.read.schema(HYPERPARAM_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return with_row_number(df, "file_row")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The published results CSV (config, task, time, accuracy, macro_f1); ``time`` may be empty."""
    return spark.read.schema(RESULTS_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
