"""Inputs the reference reads from files it does not ship, derived by fixed rules from the driver tables.

* experiment table (the reference's spreadsheet): one row per ``orders`` row;
* nested QA documents (the reference's MultiRC file): built from ``conversations``
  with 1:1 self-joins on (conv_id, turn + k), so no conversation is ever collected;
* weights (the reference's model tensors): ``embeddings`` rows as layers.

Every registered query reads these through Spark, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the hyperparameter rows shipped with the reference (model, task, epochs,
# batch size, learning rate, weight decay), in file order -------------------------------------
DEBERTA_HYPERPARAMS = [
    ("microsoft/deberta-base", "CB", 5, 16, 3.92e-05, 0.1430741527),
    ("microsoft/deberta-base", "BoolQ", 5, 16, 2.49e-05, 0.1430741527),
    ("microsoft/deberta-base", "RTE", 5, 16, 2.49e-05, 0.0354189315),
    ("microsoft/deberta-v3-small", "CB", 5, 16, 3.92798e-05, 0.1217384044),
    ("microsoft/deberta-v3-small", "BoolQ", 5, 16, 2.49e-05, 0.1430741527),
    ("microsoft/deberta-v3-small", "RTE", 5, 16, 4.802e-05, 0.1217384044),
    ("microsoft/deberta-v3-xsmall", "CB", 5, 16, 2.49e-05, 0.1430741527),
    ("microsoft/deberta-v3-xsmall", "BoolQ", 5, 16, 4.802e-05, 0.1217384044),
    ("microsoft/deberta-v3-xsmall", "RTE", 5, 16, 3.927e-05, 0.1739043484),
    ("microsoft/deberta-v3-large", "CB", 5, 16, 2.49e-05, 0.1217384044),
    ("microsoft/deberta-v3-large", "BoolQ", 5, 16, 2.49e-05, 0.1739043484),
    ("microsoft/deberta-v3-large", "RTE", 5, 16, 2.49e-05, 0.0354189315),
]
HP_SCHEMA = ("file_row int, model_name string, task string, n_epochs int, train_batch_size int, "
             "learning_rate double, weight_decay double")
# -------------------------------------------------------------------------------------------------

TASKS3 = ["CB", "BoolQ", "RTE"]
DEBERTA_NAMES = ["microsoft/deberta-base", "microsoft/deberta-v3-small", "microsoft/deberta-v3-xsmall",
                 "microsoft/deberta-v3-large", "microsoft/deberta-v2-xlarge"]  # the last has no hyperparameters
EXPERIMENT_HEADER = ["Configuration Num", "Task", "Path", "Number of Models", "Pruning Factor", "Is Baseline",
                     "Model Type", "Notes", "Comment", "Row"]


def hyperparams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DEBERTA_HYPERPARAMS)], HP_SCHEMA)


def experiment_table(orders: DataFrame) -> DataFrame:
    """The experiment spreadsheet as Spark would read it from CSV (numbers as doubles, nulls present).

    Rule per order: config = orderkey div 4; task by custkey mod 3; model type by order
    status (P picks a deberta size by custkey mod 5); baseline for urgent orders; 1 + custkey mod 13
    models (so pools above 10 and the suffix branch occur); factor = (custkey mod 7) / 10; the run
    stamp is the order date; every 97th order's template lacks the '*'; 'Notes' is null for low-priority
    P orders (row dropped), 'Comment' (9th column, ignored) is null for even custkeys.
    """
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS3]), (F.pmod(ck, F.lit(3)) + 1).cast("int"))
    deberta = F.element_at(F.array(*[F.lit(n) for n in DEBERTA_NAMES]), (F.pmod(ck, F.lit(5)) + 1).cast("int"))
    mtype = (F.when(F.col("o_orderstatus") == "F", F.lit("gpt2"))
             .when(F.col("o_orderstatus") == "O", F.lit("distilgpt2")).otherwise(deberta))
    baseline = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).otherwise(F.lit(0))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy_MM_dd-hh_mm_ss_a"), F.lit("/"))
    head = F.concat(F.lit("/m/"), mtype, F.lit("/"), task)
    path = (F.when(baseline == 1, F.concat(head, F.lit("/baseline/"), stamp))
            .when(F.pmod(ok, F.lit(97)) == 0, F.concat(head, F.lit("/bootstrapped/"), stamp))
            .otherwise(F.concat(head, F.lit("/bootstrapped_*/"), stamp)))
    notes = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(None).cast("string")) \
        .otherwise(F.col("o_orderpriority"))
    comment = F.when(F.pmod(ck, F.lit(2)) == 0, F.lit(None).cast("string")).otherwise(F.lit("ok"))
    cols = [
        F.floor(ok / 4).cast("double"), task, path, (F.pmod(ck, F.lit(13)) + 1).cast("double"),
        F.pmod(ck, F.lit(7)).cast("double") / 10, baseline, mtype, notes, comment, ok,
    ]
    return orders.select(*[c.alias(n) for c, n in zip(cols, EXPERIMENT_HEADER)])


def qa_documents(conv: DataFrame) -> DataFrame:
    """One nested QA document per user turn t: passage = turn t; one question = turn t+1;
    its answers = turns t+2 and t+3 (label 1 when the answer turn is an assistant turn).
    Missing turns give empty arrays, so some documents flatten to no rows."""
    c = conv.select("conv_id", "turn", "role", "text")

    def at(k: int) -> DataFrame:
        return c.select("conv_id", (F.col("turn") - k).alias("turn"),
                        F.col("turn").alias(f"t{k}"), F.col("role").alias(f"role{k}"), F.col("text").alias(f"text{k}"))

    d = c.filter(F.col("role") == "user")
    for k in (1, 2, 3):
        d = d.join(at(k), ["conv_id", "turn"], "left")

    def answer(k: int):
        return F.when(F.col(f"t{k}").isNotNull(),
                      F.struct(F.col(f"text{k}").alias("text"),
                               (F.col(f"role{k}") == "assistant").cast("int").alias("label")))

    answers = F.filter(F.array(answer(2), answer(3)), lambda x: x.isNotNull())
    question = F.when(F.col("t1").isNotNull(), F.struct(F.col("text1").alias("question"), answers.alias("answers")))
    passage = F.struct(F.col("text").alias("text"), F.filter(F.array(question), lambda x: x.isNotNull()).alias("questions"))
    return d.select("conv_id", "turn", passage.alias("passage"))


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """(user turn t, assistant turn t+1, optional turn t+2) as task-shaped text columns."""
    c = conv.select("conv_id", "turn", "role", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r1"), F.col("text").alias("x1"))
    nxt2 = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("x2"))
    p = (c.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"]).filter(F.col("r1") == "assistant")
         .join(nxt2, ["conv_id", "turn"], "left"))
    return p.select("conv_id", "turn",
                    F.col("text").alias("premise"), F.col("x1").alias("hypothesis"),
                    F.col("text").alias("question"), F.col("x1").alias("passage"),
                    F.col("x1").alias("choice1"), F.col("x2").alias("choice2"))


def weights_from_embeddings(emb: DataFrame, n_models: int = 5) -> DataFrame:
    """Weight table: each embedding row is a layer of model vec_id mod n; even ids are
    '.weight' layers, odd ids '.bias' layers; the 64 vector entries are its parameters."""
    kind = F.when(F.pmod(F.col("vec_id"), F.lit(2)) == 0, F.lit(".weight")).otherwise(F.lit(".bias"))
    return emb.select(F.pmod(F.col("vec_id"), F.lit(n_models)).alias("model_id"),
                      F.concat(F.lit("layer_"), F.col("vec_id").cast("string"), kind).alias("layer"),
                      F.posexplode("embedding").alias("pos", "value")) \
        .withColumn("value", F.col("value").cast("double"))


def model_factors(weights: DataFrame) -> DataFrame:
    """Pruning factor per model: (model_id + 1) / 10."""
    return weights.select("model_id").distinct().withColumn(
        "pruning_factor", (F.col("model_id") + 1).cast("double") / 10)
