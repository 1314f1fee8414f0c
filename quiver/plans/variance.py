"""Single versus double bootstrap (V1) over the variance table, and its variance summary (V2).

Model i of the single bootstrap is trained on outer sample i; the double bootstrap
resamples that outer sample five times and soft-votes the five inner models. The cases are rows of the experiment
table (S3, P3), their models are keyed by the paths of X3, and each case's learner has the weight decay that X6 finds for its
(model, task). The sums of all 60 samples are added up in one pass over the vectors, by the vectors' own label; a
task's classes join labels, so its class sums are sums of these, and weight decay shrinks a case's centroids after that
(mean = sum(mult * x) / (sum(mult) + 100 * weight decay)). All models of all cases are scored once, and the two kinds are compared
per i with conditional aggregates: no loop over cases or i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators import learn, metrics, sampling, score
from quiver.plans import experiment as X
from quiver.plans.centroid_ensemble import train_test
from quiver.session import materialize

CASE = ["config", "model_name", "task"]
SHRINK_SCALE = 100.0
# Classes of the tasks, by a fixed rule from the embeddings' label
TASK_CLASSES = {"CB": "class_id % 3", "BoolQ": "class_id % 2", "RTE": "class_id div 2 % 2"}


def variance_cases(clean: DataFrame, hp: DataFrame) -> DataFrame:
    """The variance table: the first row of the experiment table for each (model, task) that has hyperparameters."""
    known = X.lookup_hyperparams(clean.where("is_baseline = 0"), hp).where("hp_status = 'ok'")
    first = known.groupBy("model_type", "task").agg(F.min("row_id").alias("row_id"))
    rows = [r["row_id"] for r in first.collect()]  # at most the rows of the hyperparameter table
    return materialize(X.select_rows(known, rows).select("row_id", "config", F.col("model_type").alias("model_name"), "task", "weight_decay", F.col("path").alias("single_path"),
                                                         F.concat(F.lit("/d/"), F.col("model_type"), F.lit("/"), F.col("task")).alias("double_path")))


def _by_task(value: str):
    """An explode of (task, class) from an expression over ``class_id``."""
    return F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.expr(rule.replace("class_id", value)).cast("int").alias("c")) for t, rule in TASK_CLASSES.items()]))


def single_vs_double(emb: DataFrame, cases: DataFrame, key: str = "vec_id", outer: int = 10, inner: int = 5) -> tuple[DataFrame, DataFrame]:
    """Returns (report per (config, model_name, task, kind, i), paired rows per (config, model_name, task, i)); ``cases`` as of :func:`variance_cases`."""
    mc, group = ["kind", "i", "j"], ["kind", "i"]
    train, test = train_test(emb.select(key, "embedding", "label"), key)
    single = sampling.bootstrap_exact(train, key, outer).select(
        F.lit("Single").alias("kind"), F.col("replica").alias("i"), F.lit(0).alias("j"), key, "mult")
    double = sampling.double_bootstrap(train, key, outer, inner).select(F.lit("Double").alias("kind"), "i", "j", key, "mult")
    samples = materialize(single.unionByName(double))
    sums = learn.centroid_sums(train, samples, key, model_cols=mc).select(*mc, "dim", "sx", "sw", _by_task("class_id").alias("t"))
    sums = materialize(sums.groupBy(*mc, F.col("t.task").alias("task"), F.col("t.c").alias("class_id"), "dim").agg(F.sum("sx").alias("sx"), F.sum("sw").alias("sw")))
    paths = X.variance_paths(cases, outer, inner).select("row_id", F.col("case").alias("kind"), "i", F.coalesce("j", F.lit(0)).alias("j"), "path")
    keys = paths.join(cases.select("row_id", "task", "weight_decay"), "row_id")  # models x cases
    value = F.col("sx") / (F.col("sw") + SHRINK_SCALE * F.col("weight_decay"))
    cells = keys.join(sums, [*mc, "task"]).select("task", "row_id", *mc, "class_id", "dim", value.alias("value"))
    models = materialize(learn.pack_centroids(cells, ["task", "row_id", *mc]))
    rows = test.select(key, "embedding", _by_task("label").alias("t")).select(key, "embedding", F.col("t.task").alias("task"), F.col("t.c").alias("label"))
    conf = score.confusion_counts(rows, models, key, model_cols=["row_id", *mc], vote_by=["row_id", *group])
    report = metrics.classification_report(conf, ["task", "row_id", *group])
    report = report.join(cases.select("row_id", "config", "model_name"), "row_id").select(*CASE, *group, *[c for c in report.columns if c not in ("task", "row_id", *group)])

    def pick(kind: str, metric: str):
        return F.max(F.when(F.col("kind") == kind, F.col(metric))).alias(f"{kind.lower()}_{metric}")

    paired = report.groupBy(*CASE, "i").agg(pick("Single", "accuracy"), pick("Single", "macro_f1"),
                                            pick("Double", "accuracy"), pick("Double", "macro_f1"))
    return report, paired


def variance_summary(report: DataFrame) -> DataFrame:
    """V2: mean, sample variance and standard deviation of each kind's accuracy and macro F1."""
    aggs = []
    for m in ("accuracy", "macro_f1"):
        aggs += [F.avg(m).alias(f"mean_{m}"), F.var_samp(m).alias(f"var_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    return report.groupBy(*CASE, "kind").agg(F.count(F.lit(1)).alias("n_models"), *aggs)
