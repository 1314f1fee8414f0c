"""Experiment planning: table cleaning, selection and expansion into model lists.

All configurations are expanded in one plan keyed by (config, task, row) instead of
one driver call per configuration; bad rows are quarantined with an ``error`` column.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.operators.sampling import choose_models

# ---- fixed values: run-stamp suffixes of the extra gpt2 / distilgpt2 models (model numbers >= 10) ----
SUFFIXES = {
    ("distilgpt2", "BoolQ"): "2022_05_10-01_44_54_AM/",
    ("distilgpt2", "CB"): "2022_05_10-01_48_55_AM/",
    ("distilgpt2", "RTE"): "2022_05_10-01_41_57_AM/",
    ("gpt2", "BoolQ"): "2022_05_10-01_35_25_AM/",
    ("gpt2", "CB"): "2022_05_10-01_35_51_AM/",
    ("gpt2", "RTE"): "2022_05_10-01_35_25_AM/",
}
STAMP_LEN = 23  # length of a run-stamp directory such as the suffixes above
# Configurations evaluated by the reference's validation run, as ranges [start, stop).
VALIDATION_CONFIG_RANGES = [(50, 102), (1, 8), (12, 41), (102, 118)]
# Configurations of the later validation run, by number.
VALIDATION_CONFIG_IDS = [8, 50, 51, 52, 53, 54, 110, 111, 112, 114, 115, 116, 117, 16, 17, 20, 21]
# Rows of the variance table read by the reference's variance analysis.
VARIANCE_ROW_INDEX = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
VALIDATION_TASKS = ["CB", "BoolQ", "RTE"]
# ----------------------------------------------------------------------------------------------------

CLEAN_NAMES = ["config", "task", "path", "num_models", "pruning_factor", "is_baseline", "model_type", "notes"]
CLEAN_TYPES = ["int", "string", "string", "int", "double", "int", "string", "string"]


def experiment_clean(raw: DataFrame, row_col: str | None = "Row") -> DataFrame:
    """S3: keep the first 8 columns, drop rows with a null in any of them, type them.

    Numbers arrive as doubles (CSV nulls make pandas read floats); they are cast to
    int like the reference does before comparing. ``row_col`` carries the file row.
    """
    first8 = raw.columns[:8]
    kept = raw.na.drop("any", subset=first8)
    # Numbers may arrive as text such as "8.0": go through double before int (ANSI casts are strict).
    cols = [(F.col(f"`{c}`").cast("double").cast(t) if t == "int" else F.col(f"`{c}`").cast(t)).alias(n)
            for c, n, t in zip(first8, CLEAN_NAMES, CLEAN_TYPES)]
    if row_col:
        cols.append(F.col(f"`{row_col}`").cast("bigint").alias("row_id"))
    return kept.select(*cols)


def select_config(table: DataFrame, config: int, task: str) -> DataFrame:
    """Conjunctive equality, config compared as int."""
    return table.filter((F.col("config").cast("int") == F.lit(config)) & (F.col("task") == F.lit(task)))


def in_ranges(c: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    """OR of half-open ranges: stays a pushdown-friendly predicate however long the id list."""
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | ((c >= F.lit(lo)) & (c < F.lit(hi)))
    return cond


def select_configs(table: DataFrame, ranges: Sequence[tuple[int, int]] = tuple(VALIDATION_CONFIG_RANGES),
                   ids: Sequence[int] | None = None) -> DataFrame:
    """Rows whose config lies in a union of ranges, or in an explicit list of ids."""
    if ids is not None:
        return table.filter(F.col("config").isin(list(ids)))
    return table.filter(in_ranges(F.col("config"), ranges))


def select_rows(table: DataFrame, positions: Sequence[int] = tuple(VARIANCE_ROW_INDEX), row_col: str = "row_id") -> DataFrame:
    """Rows whose file position is in a list (an explicit row key, never input order)."""
    return table.filter(F.col(row_col).isin(list(positions)))


def _suffix(model_type: Column, task: Column) -> Column:
    expr = None
    for (mt, tk), sfx in SUFFIXES.items():
        cond = (model_type == F.lit(mt)) & (task == F.lit(tk))
        expr = F.when(cond, F.lit(sfx)) if expr is None else expr.when(cond, F.lit(sfx))
    return expr


def model_path(template: Column, n: Column, model_type: Column, task: Column) -> tuple[Column, Column]:
    """(path, error). The character at the first '*' becomes n; for n >= 10 the last 23
    characters of the template (its run stamp) are replaced by the (model type, task) suffix."""
    pos = F.instr(template, "*")
    n_str = n.cast("string")
    length = F.length(template)
    replaced = F.concat(F.substr(template, F.lit(1), pos - 1), n_str, F.substr(template, pos + 1))
    keep = F.greatest(length - STAMP_LEN, F.lit(0))
    prefix = F.left(template, keep)
    prefix_r = F.when(pos <= keep, F.concat(F.substr(prefix, F.lit(1), pos - 1), n_str, F.substr(prefix, pos + 1))) \
        .otherwise(prefix)
    sfx = _suffix(model_type, task)
    path = (F.when(pos == 0, F.lit(None).cast("string"))
            .when(n < 10, replaced)
            .otherwise(F.concat(prefix_r, sfx)))
    error = (F.when(pos == 0, F.lit("template has no '*'"))
             .when((n >= 10) & sfx.isNull(), F.concat(F.lit("no run-stamp suffix for "), model_type, F.lit("/"), task)))
    return path, error


def expand_config(clean: DataFrame, seed: str = "models") -> DataFrame:
    """X1 (+M5, X2, X5): one row per model of each experiment row; baselines contribute their path.

    Output ``(row_id, config, task, model_type, model_no, path, pruning_factor, error)``.
    """
    base = clean.filter(F.col("is_baseline") != 0).select(
        "row_id", "config", "task", "model_type", F.lit(None).cast("int").alias("model_no"), "path",
        "pruning_factor", F.lit(None).cast("string").alias("error"))
    row_key = F.concat_ws(":", F.col("config").cast("string"), F.col("task"), F.col("path"))
    boot = choose_models(clean.filter(F.col("is_baseline") == 0), "num_models", row_key, seed=seed)
    path, error = model_path(F.col("path"), F.col("model_no"), F.col("model_type"), F.col("task"))
    boot = boot.select("row_id", "config", "task", "model_type", "model_no", path.alias("path"),
                       "pruning_factor", error.alias("error"))
    return base.unionByName(boot)


def variance_paths(rows: DataFrame, outer: int = 10, inner: int = 5) -> DataFrame:
    """Single-bootstrap path i (every '*' -> i, plus '/') and the five double-bootstrap
    paths base/bootstrapped_i_j/. Row-local explodes, no join."""
    single_base = F.col("single_path")
    i_rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    single = i_rows.select("row_id", F.lit("Single").alias("case"), "i", F.lit(None).cast("int").alias("j"),
                           F.concat(F.replace(single_base, F.lit("*"), F.col("i").cast("string")), F.lit("/")).alias("path"))
    double = i_rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(inner - 1)))).select(
        "row_id", F.lit("Double").alias("case"), "i", "j",
        F.concat(F.col("double_path"), F.lit("/bootstrapped_"), F.col("i").cast("string"), F.lit("_"),
                 F.col("j").cast("string"), F.lit("/")).alias("path"))
    return single.unionByName(double)


def config_task_grid(configs: DataFrame, tasks: Sequence[str] = tuple(VALIDATION_TASKS)) -> DataFrame:
    """Every distinct config with every task (row-local explode of a fixed list, no cross join)."""
    return (configs.select("config").distinct()
            .withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks]))))


def attach_factor(models: DataFrame, factors: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Keyed (not positional) pairing of models with their pruning factor; either side
    missing is flagged rather than silently misaligned."""
    m = models.withColumn("_m", F.lit(True))
    f = factors.select(*keys, "pruning_factor").withColumn("_f", F.lit(True))
    j = m.join(f, list(keys), "full_outer")
    status = (F.when(F.col("_m").isNull(), F.lit("factor without model"))
              .when(F.col("_f").isNull(), F.lit("model without factor")).otherwise(F.lit("ok")))
    return j.withColumn("factor_status", status).drop("_m", "_f")


def lookup_hyperparams(rows: DataFrame, hp: DataFrame, name_col: str = "model_type", task_col: str = "task") -> DataFrame:
    """The first hyperparameter row (file order) equal on (model name, task); misses are
    quarantined with ``hp_status``. Spark broadcasts the table if its measured size allows it."""
    first = hp.groupBy("model_name", "task").agg(
        F.min_by(F.struct("n_epochs", "train_batch_size", "learning_rate", "weight_decay"), "file_row").alias("_hp"))
    first = first.withColumnRenamed("model_name", "_name").withColumnRenamed("task", "_task")
    j = rows.join(first, (F.col(name_col) == F.col("_name")) & (F.col(task_col) == F.col("_task")), "left")
    return j.select(*rows.columns, "_hp.n_epochs", "_hp.train_batch_size", "_hp.learning_rate", "_hp.weight_decay",
                    F.when(F.col("_name").isNull(), F.lit("missing hyperparameters")).otherwise(F.lit("ok"))
                    .alias("hp_status"))
