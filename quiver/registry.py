"""Registered queries: Spark callables ``(spark, sf_dir) -> DataFrame`` and their DuckDB oracle SQL.

Every query reads the driver's tables (or data Spark derives from them) whole. Double
outputs are rounded to 6 decimals; the oracle rounds the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver import oracle as O
from quiver.operators import ensemble, metrics, sampling
from quiver.plans import centroid_ensemble as CE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, decimals: int = O.R) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


# ---- M1-M7 ------------------------------------------------------------------------------

@register("holdout_split", f"SELECT doc_id, split FROM ({O.split_cte('documents', 'doc_id')})")
def q_holdout_split(spark, sf):
    return sampling.holdout_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("dense_position", f"SELECT doc_id, pos FROM ({O.positions_cte('documents', 'doc_id')})")
def q_dense_position(spark, sf):
    return sampling.dense_position(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("bootstrap_exact", f"WITH {O.bootstrap_ctes('embeddings', 'vec_id')} SELECT * FROM samples")
def q_bootstrap_exact(spark, sf):
    return sampling.bootstrap_exact(table(spark, sf, "embeddings"), "vec_id", 10)


def _poisson_sql() -> str:
    h = O.H("'poisson' || CAST(r.replica AS VARCHAR)", "e.vec_id")
    return f"""SELECT replica, vec_id, mult FROM (
  SELECT CAST(replica AS INTEGER) AS replica, vec_id, {O.poisson_sql('_h')} AS mult FROM (
    SELECT r.replica, e.vec_id, {h} AS _h FROM embeddings e CROSS JOIN range(10) r(replica)))
WHERE mult > 0"""


@register("bootstrap_poisson", _poisson_sql())
def q_bootstrap_poisson(spark, sf):
    return sampling.bootstrap_poisson(table(spark, sf, "embeddings"), "vec_id", 10)


@register("double_bootstrap", f"WITH {O.double_bootstrap_ctes('embeddings', 'vec_id')} SELECT * FROM dsamples")
def q_double_bootstrap(spark, sf):
    return sampling.double_bootstrap(table(spark, sf, "embeddings"), "vec_id")


@register("baseline_sample", f"""WITH {O.bootstrap_ctes('embeddings', 'vec_id')}
SELECT 'baseline' AS model_type, 0 AS replica, vec_id, 1 AS mult FROM embeddings
UNION ALL SELECT 'bootstrap', replica, vec_id, mult FROM samples""")
def q_baseline_sample(spark, sf):
    return sampling.baseline_and_bootstrap(table(spark, sf, "embeddings"), "vec_id", 10)


# ---- flagship stages: T1, T4, G1-G5, X7 ----------------------------------------------------

def _flagship(spark, sf) -> CE.EnsembleRun:
    return CE.run(table(spark, sf, "embeddings"))


@register("train_centroids", O.flagship_ctes() + f"SELECT replica, class_id, dim, {O.rnd('value', 'value')} FROM cent")
def q_train_centroids(spark, sf):
    return rounded(_flagship(spark, sf).centroids)


@register("score_models", O.flagship_ctes() +
          f"SELECT 'embeddings' AS task, replica, vec_id, class_id, {O.rnd('prob', 'prob')} FROM probs")
def q_score_models(spark, sf):
    return rounded(_flagship(spark, sf).scores)


@register("soft_vote", O.flagship_ctes() + f"SELECT vec_id, class_id, {O.rnd('total', 'total')} FROM totals")
def q_soft_vote(spark, sf):
    return rounded(_flagship(spark, sf).totals)


@register("predict", O.flagship_ctes() + "SELECT vec_id, y_pred FROM pred")
def q_predict(spark, sf):
    return _flagship(spark, sf).predictions


@register("align_truth", O.flagship_ctes() + "SELECT vec_id, y_pred, y_true FROM aligned")
def q_align_truth(spark, sf):
    return _flagship(spark, sf).aligned


_ALIGNED_SQL = """WITH p AS (SELECT vec_id, CAST(label AS INTEGER) AS y_pred FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, CAST(label AS INTEGER) FROM embeddings WHERE vec_id % 11 = 0),
t AS (SELECT vec_id, CAST(label % 2 AS INTEGER) AS y_true FROM embeddings WHERE vec_id % 13 <> 0 UNION ALL SELECT vec_id, CAST(label % 2 AS INTEGER) FROM embeddings WHERE vec_id % 17 = 0),
k AS (SELECT vec_id, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS t FROM (SELECT vec_id, count(*) AS n FROM p GROUP BY ALL) a FULL JOIN (SELECT vec_id, count(*) AS n FROM t GROUP BY ALL) b USING (vec_id)),
s AS (SELECT vec_id, p + t AS n, CASE WHEN t = 0 THEN 'no truth' WHEN p = 0 THEN 'no prediction' WHEN p > 1 AND t > 1 THEN 'duplicate both' WHEN p > 1 THEN 'duplicate prediction'
  WHEN t > 1 THEN 'duplicate truth' ELSE 'matched' END AS status FROM k)
"""


def _planted_alignment(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Predictions and truths derived from the embeddings with planted gaps (ids divisible by 7, 13) and copies (11, 17)."""
    emb, i = table(spark, sf, "embeddings"), F.col("vec_id")
    with_copies = lambda gap, copy, value, name: emb.select("vec_id", value.cast("int").alias(name)).where(i % gap != 0).unionByName(emb.select("vec_id", value.cast("int").alias(name)).where(i % copy == 0))
    return ensemble.audited_align(with_copies(7, 11, F.col("label"), "y_pred"), with_copies(13, 17, F.col("label") % 2, "y_true"), "vec_id", "y_true")


@register("align_audit", _ALIGNED_SQL + "SELECT status, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY status")
def q_align_audit(spark, sf):
    """X7's account of duplicate and missing keys."""
    return _planted_alignment(spark, sf)[1]


@register("align_matched", _ALIGNED_SQL + "SELECT s.vec_id, p.y_pred, t.y_true FROM s JOIN p USING (vec_id) JOIN t USING (vec_id) WHERE status = 'matched'")
def q_align_matched(spark, sf):
    """X7's pairs of the keys that are unique on both sides."""
    return _planted_alignment(spark, sf)[0]


@register("confusion", O.flagship_ctes() + "SELECT y_true, y_pred, n FROM conf")
def q_confusion(spark, sf):
    return _flagship(spark, sf).confusion


@register("per_class_report", O.flagship_ctes() +
          "SELECT label, " + ", ".join(O.rnd(c, c) for c in ["precision", "recall", "f1"]) + ", support FROM per")
def q_per_class_report(spark, sf):
    return rounded(metrics.per_class_report(_flagship(spark, sf).confusion))


@register("classification_report", O.flagship_ctes() + O.report_select("report", []))
def q_classification_report(spark, sf):
    return rounded(metrics.classification_report(_flagship(spark, sf).confusion))


def flagship_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_classification_report(spark, sf_dir)


# ---- experiment planning: S3, P1-P3, M5, X1-X6 -------------------------------------------------

from quiver.plans import derived as D  # noqa: E402
from quiver.plans import experiment as X  # noqa: E402
from quiver.operators import tasks as TK  # noqa: E402

_EXP = "WITH " + O.experiment_ctes()
_CLEAN_COLS = "config, task, path, num_models, pruning_factor, is_baseline, model_type, notes, row_id"


def _clean(spark, sf) -> DataFrame:
    return X.experiment_clean(D.experiment_table(table(spark, sf, "orders")))


@register("experiment_clean", f"{_EXP} SELECT {_CLEAN_COLS} FROM exp_clean")
def q_experiment_clean(spark, sf):
    return _clean(spark, sf)


@register("config_filter", f"{_EXP} SELECT {_CLEAN_COLS} FROM exp_clean WHERE config = 100 AND task = 'CB'")
def q_config_filter(spark, sf):
    return X.select_config(_clean(spark, sf), 100, "CB")


_RANGES = " OR ".join(f"(config >= {a} AND config < {b})" for a, b in X.VALIDATION_CONFIG_RANGES)


@register("configs_in", f"{_EXP} SELECT {_CLEAN_COLS} FROM exp_clean WHERE {_RANGES}")
def q_configs_in(spark, sf):
    return X.select_configs(_clean(spark, sf))


@register("configs_listed", f"{_EXP} SELECT {_CLEAN_COLS} FROM exp_clean WHERE config IN (8, 50, 51, 52, 53, 54, 110, 111, 112, 114, 115, 116, 117, 16, 17, 20, 21)")
def q_configs_listed(spark, sf):
    return X.select_configs(_clean(spark, sf), ids=X.VALIDATION_CONFIG_IDS)


@register("rows_in", f"{_EXP} SELECT {_CLEAN_COLS} FROM exp_clean WHERE row_id IN ({', '.join(map(str, X.VARIANCE_ROW_INDEX))})")
def q_rows_in(spark, sf):
    return X.select_rows(_clean(spark, sf))


@register("choose_models", f"{_EXP}, {O.chosen_cte()} SELECT row_id, config, task, model_no FROM chosen")
def q_choose_models(spark, sf):
    c = _clean(spark, sf).filter(F.col("is_baseline") == 0)
    row_key = F.concat_ws(":", F.col("config").cast("string"), F.col("task"), F.col("path"))
    from quiver.operators.sampling import choose_models
    return choose_models(c, "num_models", row_key).select("row_id", "config", "task", "model_no")


_MP, _ME = O.model_path_sql("path", "model_no", "model_type", "task")


@register("model_path", f"{_EXP}, {O.chosen_cte()} SELECT row_id, model_no, {_MP} AS model_path, {_ME} AS error FROM chosen")
def q_model_path(spark, sf):
    return (X.expand_config(_clean(spark, sf)).filter(F.col("model_no").isNotNull())
            .select("row_id", "model_no", F.col("path").alias("model_path"), "error"))


_EXPAND_SQL = f"""{_EXP}, {O.chosen_cte()},
expanded AS (
  SELECT row_id, config, task, model_type, CAST(NULL AS INTEGER) AS model_no, path, pruning_factor, CAST(NULL AS VARCHAR) AS error
  FROM exp_clean WHERE is_baseline <> 0
  UNION ALL
  SELECT row_id, config, task, model_type, model_no, {_MP} AS path, pruning_factor, {_ME} AS error FROM chosen)"""


@register("expand_config", _EXPAND_SQL + " SELECT * FROM expanded")
def q_expand_config(spark, sf):
    return X.expand_config(_clean(spark, sf))


@register("variance_paths", f"""{_EXP},
vt AS (SELECT row_id, path AS single_path, '/d/' || model_type || '/' || task AS double_path FROM exp_clean WHERE is_baseline = 0),
vi AS (SELECT vt.*, CAST(i AS INTEGER) AS i FROM vt CROSS JOIN range(10) r(i))
SELECT row_id, 'Single' AS "case", i, CAST(NULL AS INTEGER) AS j, replace(single_path, '*', CAST(i AS VARCHAR)) || '/' AS path FROM vi
UNION ALL
SELECT row_id, 'Double', i, CAST(j AS INTEGER), double_path || '/bootstrapped_' || CAST(i AS VARCHAR) || '_' || CAST(j AS VARCHAR) || '/'
FROM vi CROSS JOIN range(5) r(j)""")
def q_variance_paths(spark, sf):
    rows = _clean(spark, sf).filter(F.col("is_baseline") == 0).select(
        "row_id", F.col("path").alias("single_path"),
        F.concat(F.lit("/d/"), F.col("model_type"), F.lit("/"), F.col("task")).alias("double_path"))
    return X.variance_paths(rows)


@register("config_task_grid", f"""{_EXP} SELECT config, t.task FROM (SELECT DISTINCT config FROM exp_clean)
CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in X.VALIDATION_TASKS)}) t(task)""")
def q_config_task_grid(spark, sf):
    return X.config_task_grid(_clean(spark, sf))


@register("attach_factor", f"""{_EXPAND_SQL},
f AS (SELECT CAST("Row" AS BIGINT) AS row_id, "Pruning Factor" AS pruning_factor FROM exp_raw)
SELECT coalesce(m.row_id, f.row_id) AS row_id, m.model_no, m.path, f.pruning_factor,
  CASE WHEN m.row_id IS NULL THEN 'factor without model' WHEN f.row_id IS NULL THEN 'model without factor' ELSE 'ok' END AS factor_status
FROM (SELECT row_id, model_no, path FROM expanded) m FULL OUTER JOIN f ON m.row_id = f.row_id""")
def q_attach_factor(spark, sf):
    raw = D.experiment_table(table(spark, sf, "orders"))
    factors = raw.select(F.col("Row").cast("bigint").alias("row_id"), F.col("`Pruning Factor`").alias("pruning_factor"))
    models = X.expand_config(X.experiment_clean(raw)).select("row_id", "model_no", "path")
    return X.attach_factor(models, factors).select("row_id", "model_no", "path", "pruning_factor", "factor_status")


@register("lookup_hyperparams", f"""{_EXP}, {O.hp_cte()}
SELECT c.row_id, c.model_type, c.task, h.n_epochs, h.train_batch_size, round(h.learning_rate, 6) AS learning_rate,
  round(h.weight_decay, 6) AS weight_decay,
  CASE WHEN h.model_name IS NULL THEN 'missing hyperparameters' ELSE 'ok' END AS hp_status
FROM exp_clean c LEFT JOIN hp_first h ON h.model_name = c.model_type AND h.task = c.task""")
def q_lookup_hyperparams(spark, sf):
    rows = _clean(spark, sf).select("row_id", "model_type", "task")
    return rounded(X.lookup_hyperparams(rows, D.hyperparams(spark)))


# ---- task operators: S2, P4-P7 -----------------------------------------------------------------

@register("flatten_nested_qa", """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
q AS (SELECT u.conv_id, u.turn, u.text AS passage, c1.text AS question FROM u
      JOIN conversations c1 ON c1.conv_id = u.conv_id AND c1.turn = u.turn + 1),
a AS (SELECT q.*, x.turn AS a_turn, x.text AS atext, CAST(x.role = 'assistant' AS INTEGER) AS label FROM q
      JOIN conversations x ON x.conv_id = q.conv_id AND x.turn IN (q.turn + 2, q.turn + 3))
SELECT conv_id, turn, 0 AS q_pos, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY a_turn) - 1 AS INTEGER) AS a_pos,
  passage, question || ' ' || atext AS question_answer_concat, label FROM a""")
def q_flatten_nested_qa(spark, sf):
    docs = D.qa_documents(table(spark, sf, "conversations"))
    return TK.flatten_multirc(docs, sep=TK.SEP_DEBERTA, keep=["conv_id", "turn"])


_PAIR_TASKS = ["CB", "BoolQ", "COPA"]


@register("pair_text", """WITH p AS (SELECT c.conv_id, c.turn, c.text AS t0, n1.text AS x1, n2.text AS x2
  FROM conversations c JOIN conversations n1 ON n1.conv_id = c.conv_id AND n1.turn = c.turn + 1 AND n1.role = 'assistant'
  LEFT JOIN conversations n2 ON n2.conv_id = c.conv_id AND n2.turn = c.turn + 2 WHERE c.role = 'user')
SELECT conv_id, turn, 'CB' AS task, t0 AS seq1, x1 AS seq2 FROM p
UNION ALL SELECT conv_id, turn, 'BoolQ', t0, x1 FROM p
UNION ALL SELECT conv_id, turn, 'COPA', t0 || ' <s> ' || x1, t0 || ' <s> ' || x2 FROM p""")
def q_pair_text(spark, sf):
    pairs = D.conversation_pairs(table(spark, sf, "conversations"))
    out = None
    for t in _PAIR_TASKS:
        part = TK.pair_text(pairs, t).select("conv_id", "turn", F.lit(t).alias("task"), "seq1", "seq2")
        out = part if out is None else out.unionByName(part)
    return out


def _label_inputs(labels: DataFrame) -> dict[str, DataFrame]:
    q, tx = F.col("quality"), F.col("toxic")
    cb = (F.when((tx == 1) & (q == 1), "contradiction").when(q == 1, "entailment")
          .when(tx == 0, "neutral").otherwise("unknown"))
    return {
        "CB": labels.select("doc_id", cb.alias("label")),
        "RTE": labels.select("doc_id", F.when(q == 1, "entailment").otherwise("not_entailment").alias("label")),
        "BoolQ": labels.select("doc_id", (q == 1).alias("label")),
        "MultiRC": labels.select("doc_id", tx.cast("string").alias("label")),
    }


def _encoded_labels(spark, sf) -> DataFrame:
    out = None
    for t, df in _label_inputs(table(spark, sf, "labels")).items():
        part = TK.label_encode(df, t, quarantine=True).select("doc_id", F.lit(t).alias("task"), "label_id", "label_error")
        out = part if out is None else out.unionByName(part)
    return out


_LABELS_SQL = """enc AS (
  SELECT doc_id, 'CB' AS task, CASE WHEN toxic = 1 AND quality = 1 THEN 2 WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 0 END AS label_id,
    CASE WHEN NOT (quality = 1 OR toxic = 0) THEN 'unmapped CB label: unknown' END AS label_error FROM labels
  UNION ALL SELECT doc_id, 'RTE', CASE WHEN quality = 1 THEN 0 ELSE 1 END, NULL FROM labels
  UNION ALL SELECT doc_id, 'BoolQ', CASE WHEN quality = 1 THEN 1 ELSE 0 END, NULL FROM labels
  UNION ALL SELECT doc_id, 'MultiRC', toxic, NULL FROM labels)"""


@register("label_encode", f"WITH {_LABELS_SQL} SELECT doc_id, task, CAST(label_id AS INTEGER) AS label_id, label_error FROM enc")
def q_label_encode(spark, sf):
    return _encoded_labels(spark, sf)


_TASK_DIM_SQL = """(VALUES ('CB', 3, 'f1'), ('RTE', 2, 'accuracy'), ('BoolQ', 2, 'accuracy'), ('MultiRC', 2, 'f1'), ('COPA', 2, 'accuracy'))
  d(task, n_classes, selection_metric)"""


@register("task_dim", f"""WITH {_LABELS_SQL}
SELECT e.task, CAST(e.label_id AS INTEGER) AS label_id, count(*) AS n, CAST(d.n_classes AS INTEGER) AS n_classes, d.selection_metric
FROM enc e JOIN {_TASK_DIM_SQL} ON d.task = e.task GROUP BY ALL""")
def q_task_dim(spark, sf):
    counts = _encoded_labels(spark, sf).groupBy("task", "label_id").agg(F.count(F.lit(1)).alias("n"))
    dim = TK.task_dim(spark).select("task", "n_classes", "selection_metric")
    return counts.join(F.broadcast(dim), "task").select("task", "label_id", "n", "n_classes", "selection_metric")


@register("task_of_path", "SELECT page_id, string_split(url, '/')[-1] AS task FROM pages")
def q_task_of_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", TK.task_of_path(F.col("url")).alias("task"))


# ---- text path: T2, G6, G7 ----------------------------------------------------------------

from quiver.plans import text_ensemble as TE  # noqa: E402


def _text(spark, sf) -> TE.TextRun:
    return TE.run(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("train_naive_bayes", O.text_ctes() + f"""SELECT m.replica, m.class_id, m.token, {O.rnd('m.loglik', 'loglik')},
  {O.rnd('p.log_prior', 'log_prior')} FROM model m JOIN prior p USING (replica, class_id)""")
def q_train_naive_bayes(spark, sf):
    run = _text(spark, sf)
    return rounded(run.loglik.join(run.prior, ["replica", "class_id"])
                   .select("replica", "class_id", "token", "loglik", "log_prior"))


@register("naive_bayes_predict", O.text_ctes() + "SELECT doc_id, y_pred, y_true FROM aligned")
def q_naive_bayes_predict(spark, sf):
    return _text(spark, sf).aligned


@register("naive_bayes_poisson_predict", O.text_ctes(resample="poisson") + "SELECT doc_id, y_pred, y_true FROM aligned")
def q_naive_bayes_poisson_predict(spark, sf):
    return TE.run(table(spark, sf, "documents"), table(spark, sf, "labels"), resample="poisson").aligned


@register("eval_metrics", O.text_ctes() + O.binary_metrics_select())
def q_eval_metrics(spark, sf):
    return rounded(metrics.eval_metrics(_text(spark, sf).confusion, n_classes=2))


@register("indicator_metrics", O.text_ctes() + O.indicator_select())
def q_indicator_metrics(spark, sf):
    return rounded(metrics.indicator_metrics(_text(spark, sf).confusion))


# ---- pruning: T5, T6 ---------------------------------------------------------------------------

from quiver.operators import prune as PR  # noqa: E402


def _weights(spark, sf):
    w = D.weights_from_embeddings(table(spark, sf, "embeddings"))
    return w, PR.prune_weights(w, D.model_factors(w))


@register("prune_weights", O.prune_ctes() + f"SELECT model_id, layer, pos, {O.rnd('value', 'value')} FROM pruned")
def q_prune_weights(spark, sf):
    return rounded(_weights(spark, sf)[1])


@register("count_weights", O.prune_ctes() + """SELECT b.model_id, b.n_params, b.n_nonzero_before, a.n_nonzero_after FROM
  (SELECT model_id, count(*) AS n_params, count(*) FILTER (WHERE value <> 0) AS n_nonzero_before FROM w GROUP BY ALL) b
  JOIN (SELECT model_id, count(*) FILTER (WHERE value <> 0) AS n_nonzero_after FROM pruned GROUP BY ALL) a USING (model_id)""")
def q_count_weights(spark, sf):
    w, pruned = _weights(spark, sf)
    before = PR.count_weights(w).withColumnRenamed("n_nonzero", "n_nonzero_before")
    after = PR.count_weights(pruned).select("model_id", F.col("n_nonzero").alias("n_nonzero_after"))
    return before.join(after, "model_id").select("model_id", "n_params", "n_nonzero_before", "n_nonzero_after")


# ---- configuration evaluation (G8, S6) and results analysis (V3, V4) ---------------------------

from quiver.plans import evaluate as EV  # noqa: E402
from quiver.plans import results as RS  # noqa: E402
from quiver.plans import variance as VA  # noqa: E402


def _evaluation(spark, sf, runs=(0,)) -> EV.Evaluation:
    return EV.evaluate(table(spark, sf, "embeddings"), EV.configs_from_nation(table(spark, sf, "nation")), runs=runs)


@register("evaluate_config", O.evaluate_ctes() + f"SELECT run_id, config, task, {O.rnd('accuracy', 'accuracy')}, "
          f"{O.rnd('macro_f1', 'macro_f1')} FROM results")
def q_evaluate_config(spark, sf):
    return rounded(_evaluation(spark, sf).results)


def _poisoned_evaluation(spark, sf) -> EV.Evaluation:
    """Units that fail in four ways beside those that do not: untrained models, a task that does not exist, factors out of range
    (every seventh nation), and weights that are not finite (replica 3 of the parity task)."""
    configs = EV.configs_from_nation(table(spark, sf, "nation"), ("embeddings", "parity", "sentiment"))
    configs = configs.withColumn("pruning_factor", F.when(F.col("config") % 7 == 6, 1.5).otherwise(F.col("pruning_factor")))

    def weights(task, trained):
        broken = (F.col("replica") == 3) & (F.col("dim") == 5) & F.lit(task == "parity")
        return trained.withColumn("value", F.when(broken, float("nan")).otherwise(F.col("value")))

    return EV.evaluate(table(spark, sf, "embeddings"), configs, weights=weights)


@register("report_errors", O.errors_sql())
def q_report_errors(spark, sf):
    """An error row for every unit that failed."""
    return _poisoned_evaluation(spark, sf).all_errors


@register("evaluate_isolated", O.evaluate_ctes() + f", bad AS ({O.errors_sql()}) SELECT run_id, config, task, {O.rnd('accuracy', 'accuracy')}, "
          f"{O.rnd('macro_f1', 'macro_f1')} FROM results r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.run_id = r.run_id AND b.config = r.config AND b.task = r.task)")
def q_evaluate_isolated(spark, sf):
    """The units beside failing ones have the results that they have without them."""
    return rounded(_poisoned_evaluation(spark, sf).results)


@register("evaluate_times", O.evaluate_ctes() + "SELECT run_id, config, task, true AS timed FROM results")
def q_evaluate_times(spark, sf):
    """Every unit has a time of its own, measured in the scoring tasks (its value differs from run to run, its presence does not)."""
    return _evaluation(spark, sf).timed.select(*EV.UNIT, (F.col("time") > 0).alias("timed"))


@register("consolidate", O.evaluate_ctes((0, 1)) + ", " + O.consolidated_cte() +
          f" SELECT config, task, run_id, n_runs, {O.rnd('accuracy', 'accuracy')}, {O.rnd('macro_f1', 'macro_f1')} FROM cons")
def q_consolidate(spark, sf):
    return rounded(RS.consolidate(_evaluation(spark, sf, (0, 1)).results))


@register("leaderboard", O.evaluate_ctes((0, 1)) + ", " + O.consolidated_cte() + " " + O.leaderboard_select())
def q_leaderboard(spark, sf):
    return rounded(RS.leaderboard(RS.consolidate(_evaluation(spark, sf, (0, 1)).results)))


# ---- single vs double bootstrap (V1, V2) -------------------------------------------------------

def _variance(spark, sf) -> tuple[DataFrame, DataFrame]:
    return VA.single_vs_double(table(spark, sf, "embeddings"), VA.variance_cases(_clean(spark, sf), D.hyperparams(spark)))


@register("single_vs_double", O.variance_ctes() + f"""SELECT config, model_name, task, i,
  round(max(accuracy) FILTER (WHERE kind = 'Single'), {O.R}) AS single_accuracy,
  round(max(macro_f1) FILTER (WHERE kind = 'Single'), {O.R}) AS single_macro_f1,
  round(max(accuracy) FILTER (WHERE kind = 'Double'), {O.R}) AS double_accuracy,
  round(max(macro_f1) FILTER (WHERE kind = 'Double'), {O.R}) AS double_macro_f1 FROM report GROUP BY config, model_name, task, i""")
def q_single_vs_double(spark, sf):
    return rounded(_variance(spark, sf)[1])


@register("variance_summary", O.variance_ctes() + f"""SELECT config, model_name, task, kind, count(*) AS n_models,
  {O.rnd('avg(accuracy)', 'mean_accuracy')}, {O.rnd('var_samp(accuracy)', 'var_accuracy')}, {O.rnd('stddev_samp(accuracy)', 'std_accuracy')},
  {O.rnd('avg(macro_f1)', 'mean_macro_f1')}, {O.rnd('var_samp(macro_f1)', 'var_macro_f1')}, {O.rnd('stddev_samp(macro_f1)', 'std_macro_f1')}
  FROM report GROUP BY config, model_name, task, kind""")
def q_variance_summary(spark, sf):
    return rounded(VA.variance_summary(_variance(spark, sf)[0]))


# ---- T3: logistic regressions of all replicas and hyperparameter rows in one joint solver -----------------

from quiver.operators import linear as LI  # noqa: E402
from quiver.operators import score as SC  # noqa: E402

_LOGISTIC_REPLICAS = 5
_VARIANT = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("task", T.StringType()), T.StructField("replica", T.IntegerType())])


def _logistic(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, LI.Linear, dict]:
    """(train half, test half, samples, models, penalties): each (model, task) row of the hyperparameter table trains all
    replicas with its own weight decay; the largest number of epochs bounds the scans."""
    train, test = CE.train_test(table(spark, sf, "embeddings"), "vec_id")
    samples = sampling.bootstrap_exact(train, "vec_id", _LOGISTIC_REPLICAS)
    hp = D.hyperparams(spark).collect()  # a small file
    penalties = {(r["model_name"], r["task"]): r["weight_decay"] for r in hp}
    models = LI.train_logistic(train, samples, "vec_id", reg_param=penalties, max_iter=60 * max(r["n_epochs"] for r in hp))
    return train, test, samples, models, penalties


@register("train_logistic", O.logistic_ctes() + """SELECT model_name, task, replica, class_id, dim, round(w[class_id + 1][dim + 1], 4) AS coef, round(w[class_id + 1][65] - list_avg(list_transform(w, lambda c: c[65])), 4) AS intercept
  FROM (SELECT model_name, task, replica, w, class_id, CAST(unnest(range(64)) AS INTEGER) AS dim FROM (SELECT *, CAST(unnest(range(len(w))) AS INTEGER) AS class_id FROM fitted))""")
def q_train_logistic(spark, sf):
    """Coefficients at the optimum; intercepts, which are free up to a common shift, with mean 0 a model."""
    packed = _logistic(spark, sf)[3].packed(spark, _VARIANT)
    shift = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["b"]) / F.size("classes")
    each = packed.select("model_name", "task", "replica", shift.alias("shift"), F.explode("classes").alias("c"))
    return each.select("model_name", "task", "replica", F.col("c.class_id").alias("class_id"), F.posexplode("c.w").alias("dim", "coef"), (F.col("c.b") - F.col("shift")).alias("intercept")) \
        .withColumn("coef", F.round("coef", 4)).withColumn("intercept", F.round("intercept", 4))


@register("train_logistic_moments", f"""WITH {O.split_ctes('label')},
{O.bootstrap_ctes('train', 'vec_id', 5)},
hp AS (SELECT * FROM (VALUES {O.hyperparams_values()}) h(model_name, task, weight_decay)),
cells AS (SELECT s.replica, t.label AS class_id, s.mult, unnest(list_append(CAST(t.embedding AS DOUBLE[]), 1.0)) AS x, CAST(generate_subscripts(list_append(t.embedding, 1.0), 1) - 1 AS INTEGER) AS dim
  FROM samples s JOIN train t USING (vec_id)),
moments AS (SELECT replica, class_id, dim, sum(mult * x) AS fitted FROM cells GROUP BY ALL)
SELECT hp.model_name, hp.task, m.replica, m.class_id, m.dim, round(m.fitted, 4) AS fitted FROM moments m CROSS JOIN hp""")
def q_train_logistic_moments(spark, sf):
    """At the optimum the fitted probabilities' moments, plus the penalty's pull, equal the weighted rows': sum of
    mult * prob * x + weight * penalty * coef, for each class and dimension (the last one is the constant 1)."""
    train, _, samples, models, penalties = _logistic(spark, sf)
    return LI.fitted_moments(train, samples, "vec_id", models, penalties, _VARIANT).withColumn("fitted", F.round("fitted", 4))


@register("logistic_report", O.logistic_ctes() + O.logistic_report_select())
def q_logistic_report(spark, sf):
    """Each (model, task) row's logistic ensemble through vote, arg-max, truth and report (G1-G5), counted in the scoring tasks."""
    _, test, _, models, _ = _logistic(spark, sf)
    group = ["model_name", "task"]
    conf = SC.confusion_counts(test, models.packed(spark, _VARIANT), "vec_id", model_cols=_VARIANT.names, on=[], vote_by=group)
    return rounded(metrics.classification_report(conf, group))


# ---- T7, T8: trial search --------------------------------------------------------------------

from quiver.plans import search as SE  # noqa: E402


def _best(keys: str) -> str:
    return f"""SELECT {keys}, n_trials, trial_id, {O.rnd('learning_rate', 'learning_rate')},
  {O.rnd('weight_decay', 'weight_decay')}, {O.rnd('objective', 'objective')} FROM (
  SELECT *, count(*) OVER (PARTITION BY {keys}) AS n_trials,
    row_number() OVER (PARTITION BY {keys} ORDER BY round_even(objective, 9) DESC, trial_id) AS _r FROM scored) WHERE _r = 1"""


_TRIAL_VALUES = ", ".join(O.rnd(c, c) for c in ["learning_rate", "weight_decay", "accuracy", "objective", "loss"])


@register("trial_objectives", O.search_ctes(["roberta"]) + f"SELECT task, metric, trial_id, epochs, batch, {_TRIAL_VALUES} FROM scored")
def q_trial_objectives(spark, sf):
    return rounded(SE.trial_objectives(table(spark, sf, "embeddings"), SE.make_trials(spark)))


@register("best_trial", O.search_ctes(["roberta"]) + _best("task, epochs, batch"))
def q_best_trial(spark, sf):
    return rounded(SE.best_trial(q_trial_objectives(spark, sf)))


@register("trial_objectives_grids", O.search_ctes() + f"SELECT task, metric, family, trial_id, epochs, batch, {_TRIAL_VALUES} FROM scored")
def q_trial_objectives_grids(spark, sf):
    """The searches of all model families and both tasks, trained together."""
    return rounded(SE.trial_objectives(table(spark, sf, "embeddings"), SE.grid_trials(spark)))


@register("best_trial_grids", O.search_ctes() + _best("family, task, epochs, batch"))
def q_best_trial_grids(spark, sf):
    return rounded(SE.best_trial(SE.trial_objectives(table(spark, sf, "embeddings"), SE.grid_trials(spark)), ("family", "task", "epochs", "batch")))


# ---- sources and sinks: S1, S4, S5, S7, S8, written from driver tables and read back --------------------

from quiver.session import tables_dir  # noqa: E402
from quiver.sources import readers as RD  # noqa: E402
from quiver.sources import sinks as SK  # noqa: E402


def _scratch(spark) -> str:
    import uuid

    return f"{tables_dir(spark)}/{uuid.uuid4().hex}"


_PAIRS_SQL = """SELECT c.conv_id * 1000 + c.turn AS idx, c.text AS premise, n1.text AS hypothesis,
  CASE WHEN c.turn % 2 = 0 THEN 'entailment' END AS label FROM conversations c
  JOIN conversations n1 ON n1.conv_id = c.conv_id AND n1.turn = c.turn + 1 AND n1.role = 'assistant' WHERE c.role = 'user'"""


@register("read_task", _PAIRS_SQL)
def q_read_task(spark, sf):
    """Task rows written as JSON lines and read with the task's declared schema."""
    pairs = D.conversation_pairs(table(spark, sf, "conversations"))
    rows = pairs.select("premise", "hypothesis", F.when(F.col("turn") % 2 == 0, "entailment").alias("label"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"))
    path = _scratch(spark)
    rows.write.json(path)
    return RD.read_task(spark, path, "CB")


@register("read_hyperparams", """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS file_row, n_name AS model_name,
  ['CB', 'BoolQ', 'RTE'][(n_nationkey % 3) + 1] AS task, CAST(1 + n_regionkey AS INTEGER) AS n_epochs, 16 AS train_batch_size,
  round(n_nationkey / 1000.0, 6) AS learning_rate, round(n_regionkey / 100.0, 6) AS weight_decay FROM nation""")
def q_read_hyperparams(spark, sf):
    """A JSON array of flat objects in file order, one small file."""
    task = F.element_at(F.array(F.lit("CB"), F.lit("BoolQ"), F.lit("RTE")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = table(spark, sf, "nation").select("n_nationkey", F.struct(
        F.col("n_name").alias("model_name"), task.alias("task"), (1 + F.col("n_regionkey")).cast("int").alias("n_epochs"), F.lit(16).alias("train_batch_size"),
        (F.col("n_nationkey") / 1000.0).alias("learning_rate"), (F.col("n_regionkey") / 100.0).alias("weight_decay")).alias("h"))
    path = _scratch(spark)
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "h"))).alias("a"))  # one row a nation
    listed.select(F.to_json(F.transform("a", lambda x: x["h"])).alias("value")).write.text(path)
    return rounded(RD.read_hyperparams(spark, path))


def _supplier_results(spark, sf) -> DataFrame:
    """Result rows by a fixed rule: task by supplier key, no time for every seventh."""
    key = F.col("s_suppkey")
    task = F.element_at(F.array(F.lit("CB"), F.lit("BoolQ"), F.lit("RTE")), (key % 3 + 1).cast("int"))
    return table(spark, sf, "supplier").select(key.cast("int").alias("config"), task.alias("task"), F.when(key % 7 != 0, key / 8.0).alias("time"),
                                               (key % 100 / 128.0).alias("accuracy"), (key % 64 / 64.0).alias("macro_f1"))


_RESULTS_SQL = """SELECT CAST(s_suppkey AS INTEGER) AS config, ['CB', 'BoolQ', 'RTE'][(s_suppkey % 3) + 1] AS task,
  round(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey / 8.0 END, 6) AS time, round(s_suppkey % 100 / 128.0, 6) AS accuracy, round(s_suppkey % 64 / 64.0, 6) AS macro_f1"""


@register("append_report", f"{_RESULTS_SQL}, CAST(r AS INTEGER) AS run_id FROM supplier CROSS JOIN range(2) t(r)")
def q_append_report(spark, sf):
    """Two runs appended to one table; the replay of one leaves one copy."""
    path = _scratch(spark)
    for run_id in (0, 1, 0):  # the first run is written again, as after a lost driver
        SK.append_report(_supplier_results(spark, sf), path, run_id)
    return rounded(spark.read.parquet(path).select("config", "task", "time", "accuracy", "macro_f1", "run_id"))


@register("append_report_consolidated", f"""SELECT config, task, 1 AS run_id, 2 AS n_runs, time, accuracy, macro_f1 FROM ({_RESULTS_SQL} FROM supplier)""")
def q_append_report_consolidated(spark, sf):
    """S5 then V4: the later of two appended runs."""
    path = _scratch(spark)
    SK.append_report(_supplier_results(spark, sf).withColumn("accuracy", F.lit(0.0)), path, 0)
    SK.append_report(_supplier_results(spark, sf), path, 1)
    return rounded(RS.consolidate(spark.read.parquet(path)).select("config", "task", "run_id", F.col("n_runs").cast("int").alias("n_runs"), "time", "accuracy", "macro_f1"))


@register("append_variance_report", """SELECT CAST(s_suppkey AS INTEGER) AS config, 'centroid' AS model_name, 'CB' AS task, round(s_suppkey % 10 / 16.0, 6) AS single_accuracy,
  round(s_suppkey % 11 / 16.0, 6) AS single_macro_f1, round(s_suppkey % 12 / 16.0, 6) AS double_accuracy, round(s_suppkey % 13 / 16.0, 6) AS double_macro_f1,
  CAST(r AS INTEGER) AS run_id FROM supplier CROSS JOIN range(2) t(r)""")
def q_append_variance_report(spark, sf):
    """Paired rows of two runs appended."""
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(key.cast("int").alias("config"), F.lit("centroid").alias("model_name"), F.lit("CB").alias("task"),
                                               *[(key % m / 16.0).alias(c) for m, c in ((10, "single_accuracy"), (11, "single_macro_f1"), (12, "double_accuracy"), (13, "double_macro_f1"))])
    path = _scratch(spark)
    for run_id in (0, 1, 1):
        SK.append_variance_report(rows, path, run_id)
    return rounded(spark.read.parquet(path))


@register("read_results", f"{_RESULTS_SQL} FROM supplier")
def q_read_results(spark, sf):
    """A results CSV with empty times and CRLF line ends."""
    path = _scratch(spark)
    _supplier_results(spark, sf).select(*SK.REPORT_COLUMNS).write.csv(path, header=True, lineSep="\r\n")
    return rounded(RD.read_results(spark, path))
