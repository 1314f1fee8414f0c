"""Task dimension, label encoding, text pairing, path parsing and QA flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the reference's task definitions) -------------------------
# Label maps: label text -> class id. An empty map means numeric label text passes through.
LABEL_MAPS: dict[str, dict[str, int]] = {
    "CB": {"neutral": 0, "entailment": 1, "contradiction": 2},
    "RTE": {"entailment": 0, "not_entailment": 1},
    "BoolQ": {"False": 0, "True": 1},
    "MultiRC": {},
    "COPA": {},
}
# Text columns joined into the first / second sequence of a pair.
PAIR_COLUMNS: dict[str, tuple[list[str], list[str]]] = {
    "CB": (["premise"], ["hypothesis"]),
    "RTE": (["premise"], ["hypothesis"]),
    "BoolQ": (["question"], ["passage"]),
    "MultiRC": (["passage"], ["question_answer_concat"]),
    "COPA": (["premise", "choice1"], ["premise", "choice2"]),
}
# Hyperparameter-search objective per task.
SELECTION_METRIC = {"CB": "f1", "MultiRC": "f1", "BoolQ": "accuracy", "RTE": "accuracy", "COPA": "accuracy"}
MAX_SEQ_LENGTH = 256
SEP_ROBERTA = " <s> "  # roberta, distilroberta and gpt2 families
SEP_DEBERTA = " "
# ---------------------------------------------------------------------------------------------


def n_classes(task: str) -> int:
    return 3 if task == "CB" else 2


def task_dim(spark: SparkSession) -> DataFrame:
    """One row per task, the single source of truth for task properties (a fixed, tiny table)."""
    rows = [
        (t, n_classes(t), ",".join(PAIR_COLUMNS[t][0]), ",".join(PAIR_COLUMNS[t][1]), SELECTION_METRIC[t],
         MAX_SEQ_LENGTH, len(LABEL_MAPS[t]) == 0)
        for t in LABEL_MAPS
    ]
    schema = ("task string, n_classes int, seq1_columns string, seq2_columns string, selection_metric string, "
              "max_seq_length int, numeric_labels boolean")
    return spark.createDataFrame(rows, schema)


def _label_text(df: DataFrame, label_col: str) -> Column:
    dtype = df.schema[label_col].dataType
    c = F.col(label_col)
    if isinstance(dtype, T.BooleanType):
        # Python renders booleans as 'True'/'False'; Spark would give 'true'/'false'.
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def label_encode(df: DataFrame, task: str, label_col: str = "label", out_col: str = "label_id",
                 quarantine: bool = False) -> DataFrame:
    """Label -> text -> class id. Strict: an unmapped label raises, like the reference.

    With ``quarantine=True`` the id is null and ``label_error`` explains why (S6 variant).
    """
    text = _label_text(df, label_col)
    mapping = LABEL_MAPS[task]
    if mapping:
        mapped = None
        for name, cid in mapping.items():
            mapped = (F.when(text == name, F.lit(cid)) if mapped is None
                      else mapped.when(text == name, F.lit(cid)))
        mapped = mapped.otherwise(F.lit(None).cast("int"))
    else:
        mapped = text.try_cast("int") if quarantine else text.cast("int")
    error = F.when(mapped.isNull(), F.concat(F.lit(f"unmapped {task} label: "), F.coalesce(text, F.lit("null"))))
    if quarantine:
        return df.withColumn(out_col, mapped).withColumn("label_error", error)
    return df.withColumn(out_col, F.when(error.isNull(), mapped).otherwise(F.raise_error(error)).cast("int"))


def pair_text(df: DataFrame, task: str, sep: str = SEP_ROBERTA) -> DataFrame:
    """P5: the (seq1, seq2) text pair of a task; null in any part gives a null sequence."""
    first, second = PAIR_COLUMNS[task]

    def join(cols: list[str]) -> Column:
        parts: list[Column] = []
        for i, c in enumerate(cols):
            if i:
                parts.append(F.lit(sep))
            parts.append(F.col(c))
        return F.concat(*parts)

    return df.withColumn("seq1", join(first)).withColumn("seq2", join(second))


def task_of_path(path: Column) -> Column:
    """Last '/'-separated component of a path ('' for a trailing slash)."""
    return F.element_at(F.split(path, "/"), -1)


QA_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("questions", T.ArrayType(T.StructType([
        T.StructField("question", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StructType([
            T.StructField("text", T.StringType()),
            T.StructField("label", T.IntegerType()),
        ]))),
    ]))),
])


def flatten_multirc(df: DataFrame, sep: str = " ", passage_col: str = "passage", keep: list[str] | None = None) -> DataFrame:
    """One row per answer: (passage, question + sep + answer, label).

    Inner explodes: a passage without questions, or a question without answers, yields no rows.
    """
    keep = keep or []
    q = df.select(*keep, F.col(f"{passage_col}.text").alias("passage"),
                  F.posexplode(f"{passage_col}.questions").alias("q_pos", "q"))
    a = q.select(*keep, "passage", "q_pos", "q.question", F.posexplode("q.answers").alias("a_pos", "a"))
    return a.select(
        *keep, "q_pos", "a_pos", "passage",
        F.concat(F.col("question"), F.lit(sep), F.col("a.text")).alias("question_answer_concat"),
        F.col("a.label").alias("label"),
    )
