"""Hyperparameter trials (T7) and best trial per grid cell.

Trials are a grid (epochs x batch) times n seeded random draws of learning rate and
weight decay. The learner of a trial is a softmax classifier trained by mini-batch gradient descent, so that all
four matter: ``epochs`` passes over the training half, steps of ``batch`` rows, ``weight_decay`` on the weights,
and a rate of ``RATE_SCALE`` times ``learning_rate`` (the drawn rates are those of fine-tuned networks; a linear
model needs larger ones). All trials of all tasks train together: an epoch is one scan, in which
every slice of the rows runs its batches and the slices' parameters are averaged (``operators.linear.train_sgd``).
The objective is the task's selection metric: macro F1 for a task of many classes, accuracy for a binary one; a
search of ``GRIDS`` may name its own. ``grid_trials`` has the trials of all searches, keyed by ``family`` and ``trial_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.functions.hashing import u
from quiver.operators import linear, metrics, score
from quiver.plans.centroid_ensemble import train_test
from quiver.session import materialize

# ---- fixed values: the searches of the reference's model families: epochs, batches and draws a cell, what is
# drawn in which range, and the objective if it is not the task's ----------------------------
EPOCHS = [3, 5]
BATCHES = [32, 16]
TRIALS_PER_CELL = 5
LR_RANGE = (1e-5, 5e-5)
WD_RANGE = (5e-3, 2e-1)
GRIDS = {
    "roberta": {"epochs": [3, 5], "batches": [32, 16], "n": 5},
    "distilroberta": {"epochs": [9, 11], "batches": [16, 32], "n": 5},
    "gpt2": {"epochs": [2], "batches": [16, 32], "n": 3},
    "deberta": {"epochs": [5], "batches": [16], "n": 3, "fixed_weight_decay": 0.01, "objective": "accuracy"},  # learning rate only
}
# ---------------------------------------------------------------------------------------------
RATE_SCALE = 4e4
OBJECTIVES = {"embeddings": "macro_f1", "parity": "accuracy"}


def make_trials(spark: SparkSession, epochs: Sequence[int] = tuple(EPOCHS), batches: Sequence[int] = tuple(BATCHES),
                n: int = TRIALS_PER_CELL, seed: str = "trial", fixed_weight_decay: float | None = None) -> DataFrame:
    """``(trial_id, epochs, batch, learning_rate, weight_decay)``; row-local explodes, seeded draws."""
    g = (spark.range(1)
         .select(F.explode(F.array(*[F.lit(e) for e in epochs])).alias("epochs"))
         .select("epochs", F.explode(F.array(*[F.lit(b) for b in batches])).alias("batch"))
         .select("epochs", "batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t")))
    tkey = F.concat_ws(":", F.col("epochs").cast("string"), F.col("batch").cast("string"), F.col("t").cast("string"))
    lo, hi = LR_RANGE
    wlo, whi = WD_RANGE
    return g.select(
        F.concat_ws("-", F.lit("e"), F.col("epochs").cast("string"), F.lit("b"), F.col("batch").cast("string"),
                    F.lit("t"), F.col("t").cast("string")).alias("trial_id"),
        "epochs", "batch",
        (F.lit(lo) + F.lit(hi - lo) * u(F.lit(f"{seed}-lr"), tkey)).alias("learning_rate"),
        (F.lit(wlo) + F.lit(whi - wlo) * u(F.lit(f"{seed}-wd"), tkey) if fixed_weight_decay is None else F.lit(fixed_weight_decay)).alias("weight_decay"))


def grid_trials(spark: SparkSession) -> DataFrame:
    """T7 of every search of ``GRIDS``: the columns of ``make_trials`` and ``family``. Families draw apart from each other."""
    out = None
    for family, grid in GRIDS.items():
        args = {k: v for k, v in grid.items() if k != "objective"}
        own = make_trials(spark, **args, seed="trial" if family == "roberta" else f"trial-{family}").withColumn("family", F.lit(family))
        out = own if out is None else out.unionByName(own)
    return out


def trial_objectives(emb: DataFrame, trials: DataFrame, key: str = "vec_id", tasks: Sequence[str] = tuple(OBJECTIVES)) -> DataFrame:
    """Objective and mean log-loss, on the test half, of every trial of every task: ``(task, metric, trial_id, epochs, batch,
    learning_rate, weight_decay, accuracy, objective, loss)``; trials of several families are keyed by ``family`` too."""
    from quiver.plans.evaluate import TASK_LABELS

    ids = ["family", "trial_id"] if "family" in trials.columns else ["trial_id"]
    labelled = emb.select(key, "embedding", *[F.expr(TASK_LABELS[t]).cast("int").alias(t) for t in tasks])
    train, test = train_test(labelled, key)
    shape = train.agg(F.max(F.size("embedding")).alias("dims"), *[F.max(t).alias(t) for t in tasks]).first()
    classes = {t: (shape[t] or 0) + 1 for t in tasks}
    grid = trials.collect()  # grid-sized
    plan = [linear.Trial(tuple(r[c] for c in ids), t, r["epochs"], r["batch"], RATE_SCALE * r["learning_rate"], r["weight_decay"]) for t in tasks for r in grid]
    found = linear.train_sgd(linear.slices(train, key, "embedding", list(tasks)), plan, classes, shape["dims"] or 0)
    names = T.StructType([T.StructField(c, T.StringType()) for c in ids])
    models = materialize(reduce(DataFrame.unionByName, [m.packed(emb.sparkSession, names).withColumn("task", F.lit(t)) for t, m in found.items()]))
    rows = reduce(DataFrame.unionByName, [test.select(key, "embedding", F.lit(t).alias("task"), F.col(t).alias("label")) for t in tasks])
    conf = materialize(score.confusion_counts(rows, models, key, model_cols=ids))  # trials x classes x classes
    rep = metrics.classification_report(conf, ["task", *ids])
    loss = conf.groupBy("task", *ids).agg((F.sum("loss") / F.sum("n")).alias("loss"))
    by_task = F.create_map(*[F.lit(v) for item in OBJECTIVES.items() for v in item])
    metric = F.element_at(by_task, F.col("task"))
    for family, own in ((f, g["objective"]) for f, g in GRIDS.items() if "family" in ids and "objective" in g):
        metric = F.when(F.col("family") == family, own).otherwise(metric)
    scored = trials.join(rep.join(loss, ["task", *ids]).select("task", *ids, "accuracy", "macro_f1", "loss"), ids).withColumn("metric", metric)
    return scored.select("task", "metric", *trials.columns, "accuracy", F.when(F.col("metric") == "accuracy", F.col("accuracy")).otherwise(F.col("macro_f1")).alias("objective"), "loss")


def best_trial(scored: DataFrame, cell: Sequence[str] = ("task", "epochs", "batch")) -> DataFrame:
    """The best trial of each grid cell by objective (ties: smallest trial id)."""
    best = F.min_by(F.struct("trial_id", "learning_rate", "weight_decay", "objective"),
                    F.struct(-F.bround("objective", 9), F.col("trial_id")))
    return scored.groupBy(*cell).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_trials")).select(
        *cell, "n_trials", "_b.trial_id", "_b.learning_rate", "_b.weight_decay", "_b.objective")
