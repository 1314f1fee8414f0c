"""Evaluate many ensemble configurations in one plan (G8) with errors and times of each unit.

A configuration picks k of the trained replicas (M5), prunes each picked model with its
factor (T5), and soft-votes them over the test half of every task. All configurations of a task
are keyed by (run_id, config) and go through scoring together. A unit, a (run_id, config, task), that cannot be
evaluated gets an error row and the others go on: a configuration that names an untrained model, an unknown
task or a factor outside 0 to 1, and one that picks a model with bad weights (found by one aggregation over the
weights, before they are pruned). A unit's time is measured inside the scoring tasks and added up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators import learn, metrics, prune, sampling, score
from quiver.plans.centroid_ensemble import train_test
from quiver.plans.experiment import config_task_grid
from quiver.session import materialize


def configs_from_nation(nation: DataFrame, tasks: Sequence[str] = ("embeddings", "parity")) -> DataFrame:
    """Config x task grid (X4) by a fixed rule: config = nation key, k = 1 + 3 x region key models
    (k = 13 asks for models 10-12, which are never trained), factor = (key mod 5) / 10."""
    configs = nation.select(F.col("n_nationkey").cast("int").alias("config"), (1 + 3 * F.col("n_regionkey")).cast("int").alias("num_models"),
                            (F.pmod(F.col("n_nationkey"), F.lit(5)).cast("double") / 10).alias("pruning_factor"))
    return config_task_grid(configs, list(tasks)).join(configs, "config").select("config", "task", "num_models", "pruning_factor")


def plan_models(configs: DataFrame, replicas: int, runs: Sequence[int], seed: str) -> tuple[DataFrame, DataFrame]:
    """(valid model picks, errors) of every (run_id, config, task): nothing is trained for it."""
    cfg = configs.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
    row_key = F.concat_ws(":", F.col("run_id").cast("string"), F.col("config").cast("string"), F.col("task"))
    chosen = sampling.choose_models(cfg, "num_models", row_key, seed=seed)
    unit = ["run_id", "config", "task"]
    missing = F.count_if(F.col("model_no") >= replicas)
    errors = (chosen.groupBy(*unit).agg(missing.alias("_missing"), F.count(F.lit(1)).alias("_k")).filter(F.col("_missing") > 0)
              .select(*unit, F.concat(F.lit("missing "), F.col("_missing").cast("string"), F.lit(" of "),
                                      F.col("_k").cast("string"), F.lit(" models")).alias("error")))
    valid = chosen.join(errors.select(*unit), unit, "left_anti").select(*unit, "model_no", "pruning_factor")
    return valid, errors


UNIT = ["run_id", "config", "task"]


def unit_error():
    """Message of a unit whose task or factor is not usable, else null."""
    factor = F.col("pruning_factor")
    return F.when(~F.coalesce(F.col("task").isin(*TASK_LABELS), F.lit(False)), F.concat(F.lit("unknown task "), F.coalesce("task", F.lit("null")))) \
        .when(~F.coalesce(factor.between(0, 1), F.lit(False)), F.concat(F.lit("pruning factor "), F.coalesce(factor.cast("string"), F.lit("null"))))


def bad_models(weights: DataFrame, model: str = "replica") -> DataFrame:
    """(model, problem) of models whose weights are not all finite numbers, or are not as many as most models have in each class."""
    v = F.col("value")
    per_class = weights.groupBy(model, "class_id").agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("odd"), F.count(F.lit(1)).alias("n"))
    usual = per_class.agg(F.mode("n", True)).first()[0]  # weights a class
    return per_class.groupBy(model).agg(F.sum("odd").alias("odd"), F.count_if(F.col("n") != F.lit(usual)).alias("uneven")) \
        .where("odd > 0 OR uneven > 0").select(model, F.when(F.col("odd") > 0, "weights not finite").otherwise("weights missing").alias("problem"))


class Evaluation:
    """Plan errors come from the plan alone; results are trained, pruned and scored on first use."""

    def __init__(self, emb: DataFrame, configs: DataFrame, key: str, replicas: int, runs: Sequence[int], seed: str,
                 weights: Callable[[str, DataFrame], DataFrame] | None) -> None:
        checked = configs.withColumn("error", unit_error())
        units = checked.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
        self._valid, missing = plan_models(checked.where("error IS NULL").drop("error"), replicas, runs, seed)
        self.errors = missing.unionByName(units.where("error IS NOT NULL").select(*UNIT, "error"))
        self._emb, self._key, self._replicas, self._weights = emb, key, replicas, weights

    @cached_property
    def _scored(self) -> tuple[DataFrame, DataFrame]:
        """(confusion cells, errors of bad models), both keyed by unit.

        Configurations share trained replicas, so each distinct (task, replica, factor) is pruned and scored
        once; a configuration's vote is the sum over its picks, carried as the list of its members.
        """
        key, mc, group = self._key, ["model_no", "factor"], ["run_id", "config"]
        tasks = sorted(r[0] for r in self._valid.select("task").distinct().collect())  # the tasks of the plan
        valid = materialize(self._valid.withColumnRenamed("pruning_factor", "factor"))
        cells, errors = [], []
        for task in tasks:
            rows = self._emb.select(key, "embedding", F.expr(TASK_LABELS[task]).cast("int").alias("label"))
            train, test = train_test(rows, key)
            cent = learn.train_centroids(train, sampling.bootstrap_exact(train, key, self._replicas), key)
            cent = materialize(self._weights(task, cent) if self._weights else cent)
            bad = materialize(bad_models(cent))  # at most all replicas
            mine = valid.where(F.col("task") == task)
            picked = mine.join(F.broadcast(bad), mine["model_no"] == bad["replica"])
            message = F.concat(F.lit("model "), F.min("model_no").cast("string"), F.lit(": "), F.min_by("problem", "model_no"))
            failed = materialize(picked.groupBy(*UNIT).agg(message.alias("error")))
            errors.append(failed)
            own = mine.join(failed.select(*UNIT), UNIT, "left_anti")
            pairs = own.select(*mc).distinct()
            weights = pairs.join(cent, pairs["model_no"] == cent["replica"]).select(
                *mc, F.concat(F.lit("class_"), F.col("class_id").cast("string"), F.lit(".weight")).alias("layer"), F.col("dim").alias("pos"), "value")
            weights = materialize(weights)
            pruned = prune.prune_weights(weights, pairs.withColumn("pruning_factor", F.col("factor")), mc)
            values = pruned.select(*mc, F.regexp_extract("layer", r"class_(\d+)\.weight", 1).cast("int").alias("class_id"), F.col("pos").alias("dim"), "value")
            members = own.groupBy(*mc).agg(F.collect_list(F.struct(*group)).alias("members"))  # at most all configurations
            models = materialize(learn.pack_centroids(values, mc).join(members, mc).withColumn("task", F.lit(task)))
            cells.append(score.confusion_counts(test.withColumn("task", F.lit(task)), models, key, model_cols=mc, vote_by=group, members="members"))
        if not cells:
            spark = self._valid.sparkSession
            unit = "run_id int, config int, task string"
            return spark.createDataFrame([], f"{unit}, y_true int, y_pred int, n long, loss double, seconds double"), spark.createDataFrame([], f"{unit}, error string")
        return materialize(reduce(DataFrame.unionByName, cells).select(*UNIT, "y_true", "y_pred", "n", "loss", "seconds")), reduce(DataFrame.unionByName, errors)

    @cached_property
    def all_errors(self) -> DataFrame:
        """(run_id, config, task, error) of every unit that could not be evaluated."""
        return self.errors.unionByName(self._scored[1].select(*UNIT, "error"))

    @cached_property
    def report(self) -> DataFrame:
        """Full classification report per (run_id, config, task) that could be evaluated."""
        return metrics.classification_report(self._scored[0], UNIT)

    @cached_property
    def results(self) -> DataFrame:
        return self.report.select(*UNIT, "accuracy", "macro_f1")

    @cached_property
    def timed(self) -> DataFrame:
        """The results with each unit's ``time``, the seconds that scoring tasks spent on it."""
        return self.results.join(self._scored[0].groupBy(*UNIT).agg(F.sum("seconds").alias("time")), UNIT)


# Labels of the evaluated tasks, derived from the embeddings' label by a fixed rule
TASK_LABELS = {"embeddings": "label", "parity": "label % 2"}


def evaluate(emb: DataFrame, configs: DataFrame, key: str = "vec_id", replicas: int = 10,
             runs: Sequence[int] = (0,), seed: str = "models", weights: Callable[[str, DataFrame], DataFrame] | None = None) -> Evaluation:
    """Evaluate every (run, config, task) of ``configs`` (config, task, num_models, pruning_factor).

    ``weights(task, trained)`` may give other weights (replica, class_id, dim, value) than the trained ones, e.g. stored ones.
    """
    return Evaluation(emb, configs, key, replicas, runs, seed, weights)


def run_and_record(ev: Evaluation, results_path: str, errors_path: str, run_id: int, fmt: str = "parquet") -> DataFrame:
    """Evaluate all configurations, then append the results, each with its own time, and the errors of the units that failed.

    ``time`` is what the scoring tasks spent on the unit: its vote, and its share of the models that it has in common with others.
    """
    from quiver.sources.sinks import append_errors, append_report

    timed = materialize(ev.timed)
    append_report(timed, results_path, run_id, fmt)
    append_errors(ev.all_errors, errors_path, run_id, fmt)
    return timed
